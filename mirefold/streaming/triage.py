"""Triage rows as a stream: each message once, counts by window, diverging campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, identifier: str, event_time: str, late: str = "21 days") -> DataFrame:
    """The first row of each identifier; a copy that comes within `late` of it is dropped, and state older than that is forgotten."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([identifier])


def level_counts(stream: DataFrame, event_time: str, late: str = "60 days", width: str = "1 day") -> DataFrame:
    """(start, level, messages): verdict levels by window of event time. In
    update mode a window's rows come again as they grow (the greatest count
    holds), and state that is `late` behind is dropped.
    """
    counted = stream.withWatermark(event_time, late).groupBy(F.window(event_time, width).alias("w"), F.coalesce("verdict_level", F.lit("none")).alias("level")).agg(F.count("*").alias("messages"))
    return counted.select(F.col("w.start").alias("start"), "level", "messages")


def diverging(stream: DataFrame, event_time: str, key: str, domain: str, late: str = "1 day", width: str = "7 days") -> DataFrame:
    """(start, key, domains): campaigns seen from about two or more sender domains within a window."""
    counted = stream.where(F.col(key) != "").withWatermark(event_time, late).groupBy(F.window(event_time, width).alias("w"), F.col(key).alias("key")).agg(F.approx_count_distinct(domain).alias("domains"))
    return counted.where("domains >= 2").select(F.col("w.start").alias("start"), "key", "domains")

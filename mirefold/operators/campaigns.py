"""Messages that belong together, and what two of them share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirefold.functions import text as tx


def campaign_key(references: Column, in_reply_to: Column, subject: Column, file_hash: Column | None = None) -> Column:
    """thread:..., att:... (one file hash), subj:... or the empty string."""
    root, bare = tx.thread_root(references, in_reply_to), tx.campaign_subject(subject)
    by_file = F.lit(None).cast("string") if file_hash is None else F.concat(F.lit("att:"), F.substring(file_hash, 1, 16))
    return F.coalesce(F.when(root != "", F.concat(F.lit("thread:"), root)), by_file, F.when(bare != "", F.concat(F.lit("subj:"), bare)), F.lit(""))


def divergent(df: DataFrame, key: str, sender: str) -> DataFrame:
    """(key, domains): keys whose messages come from two or more sender domains."""
    rows = df.select(F.col(key), tx.sender_domain(F.col(sender)).alias("d")).where(f"{key} <> '' and d <> ''").distinct()
    return rows.groupBy(key).agg(F.count("*").alias("domains")).where("domains >= 2")


def summaries(df: DataFrame, key: str) -> DataFrame:
    """(key, file_count, levels, max_score): how many messages of each level a campaign has and its highest score.

    levels counts as "level=n" in alphabetical order, joined by a bar. Two aggregations, each
    with partial sums, so that one large campaign is no large task.
    """
    level = F.coalesce("verdict_level", F.lit(""))
    counted = df.groupBy(key, level.alias("level")).agg(F.count("*").alias("n"), F.max(F.coalesce("verdict_score", F.lit(0))).alias("top"))
    levels = F.array_join(F.array_sort(F.collect_list(F.when(F.col("level") != "", F.concat_ws("=", "level", F.col("n").cast("string"))))), "|")
    return counted.groupBy(key).agg(F.sum("n").alias("file_count"), levels.alias("levels"), F.max("top").cast("int").alias("max_score"))


def shared_indicators(messages: DataFrame, indicators: DataFrame, key: str, limit: int = 40) -> DataFrame:
    """(key, shared): "type: value" that all messages of a campaign have, or if there is none,
    that at least two have; the first `limit` in order.

    messages(msg_id, key), indicators(msg_id, ioc_type, value). The counts are per campaign and
    label, so a campaign of any size is spread by its labels.
    """
    labels = indicators.where("value is not null").select("msg_id", F.concat_ws(": ", "ioc_type", "value").alias("label")).distinct()
    members = messages.select(key, "msg_id").distinct()
    sizes = members.groupBy(key).agg(F.count("*").alias("size"))
    counted = members.join(labels, "msg_id").groupBy(key, "label").agg(F.count("*").alias("n")).join(sizes, key)
    # of each kind only the first labels are kept, already in the tasks that count them; then the better kind of a campaign stays
    marked = counted.withColumn("every", (F.col("n") == F.col("size")).cast("int")).where("every = 1 or (size > 1 and n >= 2)")
    first = marked.withColumn("k", F.row_number().over(W.partitionBy(key, "every").orderBy("label"))).where(F.col("k") <= limit)
    ranked = first.withColumn("best", F.max("every").over(W.partitionBy(key))).where("every = best")
    return ranked.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("label")), "|").alias("shared"))


def difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """(key, side): rows of distinct keys that only the left, only the right, or both have."""
    a = left.select(*key).distinct().withColumn("__l", F.lit(1))
    b = right.select(*key).distinct().withColumn("__r", F.lit(1))
    side = F.when(F.col("__r").isNull(), "left").when(F.col("__l").isNull(), "right").otherwise("shared")
    return a.join(b, key, "full_outer").select(*key, side.alias("side"))

"""Messages from parsed files to indicators, findings, signals and one triage row each.

Every step is a table over all messages; nothing is done message by message.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirefold.functions import rewriters
from mirefold.operators import batches, campaigns, headers, indicators, signals
from mirefold.session import written

_NONE = "array<string>"


@dataclass
class Analysis:
    """The tables that an analysis gives: indicators, findings, signals and triage rows, all by path."""

    indicators: DataFrame
    findings: DataFrame
    signals: DataFrame
    triage: DataFrame


def bodies(parsed: DataFrame) -> DataFrame:
    """(path, text): what a message says: its text, what its page shows, the targets of links, and the text of attachments."""
    page = F.coalesce("html", F.lit(""))
    links = F.array_join(F.transform(signals.anchors(page), lambda a: a["href"]), "\n")
    attached = F.array_join(F.transform("attachments", lambda a: F.coalesce(a["text"], F.lit(""))), "\n")
    return parsed.select("path", F.concat_ws("\n", "text", F.when(page != "", signals.visible(page)), links, attached).alias("text"))


def found_indicators(parsed: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """(path, ioc_type, key, value, tags, rewritten, copies, priority): the
    indicators of bodies, headers and attachments, with links unwrapped, hosts
    on the allowlist(domain) tagged, rewriter domains next to others marked as
    noise, and equal ones merged.
    """
    texts = written(bodies(parsed), "bodies")
    urls = indicators.found_in(texts, "path", "text", ("url",)).where(F.lower("value").rlike("^https?://")).select("path", "value").distinct()
    led = written(rewriters.unwrap(urls, "value").where("changed").select("path", "original", "unwrapped"), "links")
    extra = led.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("unwrapped")), "\n").alias("more"))  # as long as the message's links
    whole = texts.join(extra, "path", "left").select("path", F.concat_ws("\n", "text", "more").alias("text"))
    columns = ["path", "ioc_type", "value", "tags"]
    parts = [
        indicators.extracted(whole, "path", "text").select(*columns, F.lit("text").alias("source")),
        indicators.extracted(headers.header_text(parsed), "path", "text").select(*columns, F.lit("header").alias("source")),
        headers.attachment_indicators(parsed).select(*columns, F.lit("attachment").alias("source")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("rewritten_from", F.lit(None).cast("string"))
    marked = written(batches.rewrites_marked(every, "path", led), "indicators")
    if allow is not None:
        host = F.when(F.col("ioc_type").isin("domain", "url", "email", "messenger"), F.when(F.col("ioc_type") == "email", F.substring_index("value", "@", -1)).when(F.col("ioc_type") == "domain", F.col("value")).otherwise(F.regexp_extract(F.lower("value"), r"://(?:[^/?#@]*@)?([^/?#:]+)", 1)))
        tagged = indicators.allowlisted(marked.withColumn("__name", F.coalesce(host, F.lit(""))), "__name", allow)
        marked = tagged.withColumn("tags", F.when(F.col("allowlisted"), F.array_union("tags", F.array(F.lit("allowlisted")))).otherwise(F.col("tags"))).drop("allowlisted", "__name")
    order = F.xxhash64("source", "ioc_type", "value")
    merged = indicators.merged(indicators.noise_marked(marked, "path").withColumn("__order", order), "path", "__order")
    return merged


def analysed(parsed: DataFrame, allow: DataFrame | None = None) -> Analysis:
    """All tables of parsed messages (see sources.mail); broken files keep a triage row with their errors."""
    parsed = written(parsed, "parsed")  # each file is parsed once
    found = written(found_indicators(parsed, allow), "found")
    cards = headers.identity(parsed)
    findings = signals.header_findings(cards.withColumn("references_hdr", F.col("references")), "path")
    wrong = headers.alignment(parsed).select("path", F.lit("dkim_alignment").alias("finding"), F.lit("high").alias("severity"))
    said = signals.signals(parsed, "path", "text", "html")
    best = indicators.top_strings(found.withColumn("__order", F.xxhash64("key")), "path", "__order")
    counts = found.groupBy("path").agg(F.count("*").alias("ioc_count"))
    hashes = F.filter("attachments", lambda a: a["size"] > 0)
    single = F.when(F.size(hashes) == 1, F.get(hashes, F.lit(0))["sha256"])
    base = parsed.select("path", "kind", "source_sha256", "errors", single.alias("__file"))
    key = campaigns.campaign_key(F.col("references"), F.col("in_reply_to"), F.col("subject"), F.col("__file"))
    rows = base.join(cards.select("path", "from_header", "subject", "message_id", "references", "in_reply_to"), "path").join(counts, "path", "left").join(best, "path", "left")
    triage = rows.select("path", "kind", "source_sha256", F.col("from_header").alias("sender"), "subject", "message_id", key.alias("campaign_key"), F.coalesce("ioc_count", F.lit(0)).alias("ioc_count"), F.coalesce("top", F.array().cast(_NONE)).alias("top_iocs"), "errors")
    return Analysis(found, findings.unionByName(wrong).unionByName(headers.more_findings(parsed)), said, triage)

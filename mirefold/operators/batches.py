"""Operators over many messages and their indicators: views, ranks, peers, merges and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirefold.functions import text as tx
from mirefold.operators import indicators

# Indicator types by group, those hidden unless all are wanted, and names of levels in other writings.
GROUPS = {"network": ("ipv4", "ipv6", "ip_port", "domain", "url", "email", "messenger"), "hashes": ("md5", "sha1", "sha256", "cve"), "host": ("filename", "filepath", "unc", "registry", "mutex", "command_line"), "crypto": ("bitcoin", "monero")}
HOST_LEFTOVERS = ("registry", "mutex", "command_line")
LEVEL_NAMES = {
    "benign": "benign", "unknown": "unknown", "suspicious": "suspicious", "malicious": "malicious", "безопасный": "benign", "неясный": "unknown", "подозрительный": "suspicious",
    "вредоносный": "malicious", "безопасно": "benign", "ок": "benign", "ok": "benign", "фишинг": "malicious", "malware": "malicious",
}
SUSPICIOUS_OR_WORSE = ("suspicious", "malicious")


def selected_types(groups: tuple[str, ...] = ("network", "hashes", "host"), everything: bool = False) -> list[str]:
    """The types of the chosen groups, without leftovers of host forensics unless everything is wanted."""
    return [t for g in groups for t in GROUPS[g] if everything or t not in HOST_LEFTOVERS]


def level_of(c: Column) -> Column:
    """The level that a written level means, null where it means none."""
    table = F.create_map(*[F.lit(x) for pair in LEVEL_NAMES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(c)))


def distinct_ignoring_case(items: Column) -> Column:
    """The items of an array without nulls, each once apart from case; the first writing stays, in order."""
    kept = F.filter(items, lambda x: x.isNotNull())
    low = F.transform(kept, F.lower)
    return F.filter(kept, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def file_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def ranked(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place of each row within its group. Ranks are exact for groups of any size; a group's rows are sorted by one task, on disk where they need to be."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order)))


def display_order(df: DataFrame, group: str, order: str) -> DataFrame:
    """Indicators of a message in the order they are shown: unwrapped ones, hashes, the rest; then by type and value."""
    return ranked(df, group, [indicators.tier(), F.col("ioc_type"), F.lower("value"), F.col(order)])


def hidden_counts(df: DataFrame, group: str) -> DataFrame:
    """(group, total, private, rewriter, allowlisted, shown): how many indicators each filter hides; one aggregation."""
    private, noise, allowed = indicators.has("private"), indicators.has("url_rewriter") | indicators.has("noise_candidate"), indicators.has("allowlisted")
    return df.groupBy(group).agg(F.count("*").alias("total"), F.count_if(private).alias("private"), F.count_if(noise).alias("rewriter"), F.count_if(allowed).alias("allowlisted"), F.count_if(~private & ~noise & ~allowed).alias("shown"))


def batch_view(triage: DataFrame, least: str = "", search: str = "") -> DataFrame:
    """Rows of a batch at or over a level whose path, subject, sender or reason holds a text."""
    out = triage
    if least == "suspicious":
        out = out.where(F.col("verdict_level").isin(*SUSPICIOUS_OR_WORSE))
    elif least == "malicious":
        out = out.where("verdict_level = 'malicious'")
    if q := search.strip().lower():
        out = out.where(F.lower(F.concat_ws(" ", "path", "subject", "sender", "top_reason")).contains(q))
    return out


def broken() -> Column:
    """Whether a row stands for a file that could not be read: errors, no indicator, no known kind."""
    return (F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0) & (F.coalesce("ioc_count", F.lit(0)) == 0) & (F.coalesce("kind", F.lit("unknown")) == "unknown")


def peers(triage: DataFrame, key: str, path: str, row_id: str, most: int = 20) -> DataFrame:
    """(row_id, peer_count, peers): how many other messages share a row's
    campaign key, and the first `most` of their paths in order.

    A campaign's first paths are kept once for all of its rows, so a campaign
    of a third of all rows costs as much as it has rows.
    """
    rows = triage.where(F.coalesce(F.col(key), F.lit("")) != "").select(F.col(row_id), F.col(key).alias("__key"), F.col(path).alias("__path"))
    sizes = rows.groupBy("__key").agg(F.count("*").alias("__n"))
    cut = F.row_number().over(W.partitionBy("__key").orderBy("__path"))
    paths = rows.where("__path is not null").select("__key", "__path").distinct().withColumn("__k", cut).where(F.col("__k") <= most + 1)
    first = paths.groupBy("__key").agg(F.array_sort(F.collect_list("__path")).alias("__first"))
    joined = rows.join(sizes, "__key").join(first, "__key", "left")
    others = F.slice(F.filter(F.coalesce("__first", F.array().cast("array<string>")), lambda p: F.col("__path").isNull() | (p != F.col("__path"))), 1, most)
    return joined.select(row_id, (F.col("__n") - 1).alias("peer_count"), others.alias("peers"))


def first_distinct(df: DataFrame, group: str, value: str, order: str, most: int) -> DataFrame:
    """(group, values): the first `most` different values of a group by the order of their first rows."""
    firsts = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(group, value).agg(F.min(order).alias("__o"))
    kept = firsts.withColumn("__k", F.row_number().over(W.partitionBy(group).orderBy("__o", value))).where(F.col("__k") <= most)
    return kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__k", value))).alias("__v")).select(group, F.transform("__v", lambda x: x[value]).alias("values"))


def merged_batch(triage: DataFrame, batch: str, order: str, most: int = 500, listed: int = 40) -> DataFrame:
    """(batch, files, subjects, senders, levels, max_score): a batch as one card; its first subjects and senders joined, up to `most` characters."""
    joined = lambda c: first_distinct(triage, batch, c, order, listed).select(batch, F.substring(F.array_join("values", "; "), 1, most).alias(f"{c}s"))
    card = triage.groupBy(batch).agg(F.count("*").alias("files"), F.max(F.coalesce("verdict_score", F.lit(0))).alias("max_score"), F.count_if(F.col("verdict_level").isin(*SUSPICIOUS_OR_WORSE)).alias("suspicious_or_worse"))
    return card.join(joined("subject"), batch, "left").join(joined("sender"), batch, "left")


def matched_paths(left: DataFrame, left_path: str, right: DataFrame, right_path: str, right_id: str) -> DataFrame:
    """left with the right_id of its peer: the row of the same path apart from
    case and slashes (the least id of several), else the only row of that file name.
    """
    norm = lambda c: F.lower(F.translate(c, "\\", "/"))
    r = right.where(F.col(right_path).isNotNull()).select(norm(F.col(right_path)).alias("__p"), F.col(right_id).alias("__id"))
    by_path = r.groupBy("__p").agg(F.min("__id").alias("__by_path"))
    by_name = r.groupBy(F.substring_index("__p", "/", -1).alias("__n")).agg(F.min("__id").alias("__by_name"), F.count("*").alias("__c")).where("__c = 1").drop("__c")
    rows = left.withColumn("__p", norm(F.col(left_path))).withColumn("__n", F.substring_index("__p", "/", -1))
    return rows.join(by_path, "__p", "left").join(by_name, "__n", "left").withColumn(right_id, F.coalesce("__by_path", "__by_name")).drop("__p", "__n", "__by_path", "__by_name")


def rewrites_marked(df: DataFrame, group: str, rewrites: DataFrame) -> DataFrame:
    """Indicators with where they were rewritten: those whose value a rewritten
    link of their message led to get the tag unwrapped and the links in
    `rewritten_from`; domains of rewriters of the message get url_rewriter.

    rewrites(group, original, unwrapped).
    """
    none = F.array().cast("array<string>")
    found = rewrites.where("unwrapped <> original").groupBy(group, F.col("unwrapped").alias("value")).agg(F.array_join(F.array_sort(F.collect_set("original")), " | ").alias("__from"))
    hosts = rewrites.where("unwrapped <> original").select(group, tx.url_host(F.col("original")).alias("value")).distinct().withColumn("__rewriter", F.lit(True))
    rows = df.join(found, [group, "value"], "left").join(hosts, [group, "value"], "left")
    tags = F.concat(F.coalesce("tags", none), F.when(F.col("__from").isNotNull(), F.array(F.lit("unwrapped"))).otherwise(none), F.when(F.col("__rewriter") & (F.col("ioc_type") == "domain"), F.array(F.lit("url_rewriter"))).otherwise(none))
    return rows.withColumn("tags", F.array_distinct(tags)).withColumn("rewritten_from", F.coalesce("__from", "rewritten_from")).drop("__from", "__rewriter")


def allowlisted_addresses(df: DataFrame, value: str, addresses: list[str]) -> DataFrame:
    """df with `allowlisted`: whether an address (its port aside) is in a list of at most 10,000, entries of which may hold *."""
    if len(addresses) > 10_000:
        raise ValueError("the list of addresses must stay small enough for one expression")
    ip = F.when(F.col(value).rlike(r"^[0-9.]+:[0-9]+$"), F.substring_index(value, ":", 1)).otherwise(F.lower(value))
    plain, wild = [a.lower() for a in addresses if "*" not in a], [a.lower() for a in addresses if "*" in a]
    hit = ip.isin(*plain) if plain else F.lit(False)
    if wild:
        hit = hit | ip.rlike("^(?:" + "|".join("".join(".*" if c == "*" else "\\" + c if not c.isalnum() else c for c in w) for w in wild) + r")\z")
    return df.withColumn("allowlisted", F.coalesce(hit, F.lit(False)))


def divergent_messages(df: DataFrame, key: str, sender: str) -> DataFrame:
    """The rows whose campaign has messages from two or more sender domains."""
    from mirefold.operators.campaigns import divergent

    return df.join(divergent(df, key, sender).select(key), key, "left_semi")


def best_findings(findings: DataFrame, message: str, severity: str, finding: str) -> DataFrame:
    """(message, severity, finding, times): of each severity of a message the first finding by name, and how many there are."""
    return findings.groupBy(message, severity).agg(F.min(finding).alias(finding), F.count("*").alias("times"))


def first_reasons(df: DataFrame, message: str, reason: str, order: str, most: int = 12) -> DataFrame:
    """(message, reasons): the first `most` different reasons of a message in order."""
    return first_distinct(df, message, reason, order, most).withColumnRenamed("values", "reasons")


def is_raw_address(host: Column) -> Column:
    """Whether a host is an IPv4 or IPv6 address."""
    v6 = next(p for n, _, p, _ in indicators.PATTERNS if n == "ipv6")
    return F.coalesce(host.rlike(f"^{tx.IPV4}$") | F.translate(host, "[]", "").rlike(f"^{v6}$"), F.lit(False))


def scrubbed(c: Column) -> Column:
    """Control characters but tabs and line ends as blanks."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")


def shortened(c: Column, most: int) -> Column:
    """A text of at most `most` characters, cut in its middle."""
    head = (most - 1 + 1) // 2
    tail = most - 1 - head
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("…"), F.right(c, F.lit(tail)) if tail else F.lit("")))

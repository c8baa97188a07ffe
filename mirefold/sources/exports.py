"""Reports and SIEM formats as text columns, and writers for them.

Every format is a projection (CSV, CEF, STIX, MISP, ECS, OpenCTI) that runs
where the rows are; writers leave one file a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirefold.functions.text import join_visible

# Severity of a level in CEF.
CEF_SEVERITY = {"benign": 1, "unknown": 3, "suspicious": 6, "malicious": 9}
# Types in MISP, and in STIX patterns.
MISP_TYPES = {"url": "url", "domain": "domain", "ipv4": "ip-dst", "ipv6": "ip-dst", "email": "email-src", "md5": "md5", "sha1": "sha1", "sha256": "sha256", "filename": "filename"}
STIX_PATHS = {"url": "url:value", "domain": "domain-name:value", "ipv4": "ipv4-addr:value", "ipv6": "ipv6-addr:value", "email": "email-addr:value", "md5": "file:hashes.MD5", "sha1": "file:hashes.'SHA-1'", "sha256": "file:hashes.'SHA-256'"}
OPENCTI_TYPES = {"url": "Url", "domain": "Domain-Name", "ipv4": "IPv4-Addr", "ipv6": "IPv6-Addr", "md5": "StixFile", "sha1": "StixFile", "sha256": "StixFile", "email": "Email-Addr"}
VENDOR, PRODUCT = "Mirefold", "MailTriage"


def _map(c: Column, values: dict) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in values.items()])


def flat(messages: DataFrame, indicators: DataFrame, on: str = "msg_id") -> DataFrame:
    """One row an indicator with its message's verdict; a message without any has one row with an empty indicator."""
    ioc = indicators.select(on, "ioc_type", "value", "source", "context", "rewritten_from", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|").alias("tags"))
    rows = messages.join(ioc, on, "left")
    empty = ["ioc_type", "value", "source", "context", "rewritten_from", "tags"]
    return rows.select(on, *[F.coalesce(c, F.lit("")).alias(c) for c in empty], *[c for c in messages.columns if c != on])


def batch_rows(triage: DataFrame, more: str = "+") -> DataFrame:
    """One row a message for a batch report: at most 8 indicators and 5 errors are written out."""
    none = F.array().cast("array<string>")
    return triage.select(
        F.col("path").alias("file"), "kind", F.coalesce("verdict_level", F.lit("")).alias("verdict"), F.coalesce(F.col("verdict_score").cast("string"), F.lit("")).alias("score"), "ioc_count",
        F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("sender", F.lit("")).alias("sender"), F.coalesce("message_id", F.lit("")).alias("message_id"),
        join_visible(F.coalesce("top_iocs", none), 8, more).alias("top_iocs"), F.coalesce("top_reason", F.lit("")).alias("top_reason"), join_visible(F.coalesce("errors", none), 5, more).alias("errors"),
    )


def cef_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("\\", "\\\\"), ("=", "\\="), ("\n", " "), ("\r", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cef_severity(level: Column) -> Column:
    return F.coalesce(_map(level, CEF_SEVERITY), F.lit(3))


def cef_verdict(level: Column, score: Column, reason: Column, subject: Column, sender: Column, path: Column, message_id: Column) -> Column:
    e = cef_escape
    return F.concat(
        F.lit(f"CEF:0|{VENDOR}|{PRODUCT}|1.0|verdict|"), e(F.coalesce(level, F.lit("none"))), F.lit("|"), cef_severity(level).cast("string"), F.lit("|msg="), e(reason), F.lit(" cs1="), e(subject),
        F.lit(" cs1Label=Subject suser="), e(sender), F.lit(" filePath="), e(path), F.lit(" cn1="), F.coalesce(score.cast("string"), F.lit("")), F.lit(" cn1Label=Score cs2="), e(message_id), F.lit(" cs2Label=MessageId"),
    )


def cef_indicator(kind: Column, value: Column, tags: Column, level: Column) -> Column:
    e = cef_escape
    field = F.when(kind == "url", "request=").when(kind.isin("ipv4", "ipv6", "ip_port"), "src=").when(kind == "domain", "dhost=").when(kind.isin("md5", "sha1", "sha256"), "fileHash=").otherwise("cs5=")
    label = F.when(field == "cs5=", " cs5Label=Value ").otherwise(" ")
    ext = F.concat(field, e(value), label, F.lit("cs3="), e(kind), F.lit(" cs3Label=IocType cs4="), e(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), "|")), F.lit(" cs4Label=Tags"))
    return F.concat(F.lit(f"CEF:0|{VENDOR}|{PRODUCT}|1.0|ioc|"), e(kind), F.lit("|"), cef_severity(level).cast("string"), F.lit("|"), ext)


def stix_pattern(kind: Column, value: Column) -> Column:
    """The STIX pattern of an indicator, null for types without one."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("["), _map(kind, STIX_PATHS), F.lit(" = '"), escaped, F.lit("']"))


def misp_rows(indicators: DataFrame) -> DataFrame:
    """MISP attributes; types that MISP doesn't know are left out."""
    kind = _map(F.col("ioc_type"), MISP_TYPES)
    category = F.when(kind.isin("md5", "sha1", "sha256", "filename", "email-src"), "Payload delivery").otherwise("Network activity")
    tags = F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 6), "|")
    return indicators.where(F.col("ioc_type").isin(*MISP_TYPES)).select("ioc_id", category.alias("category"), kind.alias("type"), "value", tags.alias("comment"), F.lit("1").alias("to_ids"))


def ecs_indicator(kind: Column, value: Column, tags: Column, context: Column) -> Column:
    """An indicator as a JSON object of the Elastic Common Schema."""
    typed = F.struct(
        F.struct(kind.alias("type"), F.coalesce(context, F.lit("")).alias("description"), F.when(~kind.isin("url", "domain", "ipv4", "ipv6", "ip_port", "md5", "sha1", "sha256", "email"), value).alias("name")).alias("indicator"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        F.when(kind == "url", F.struct(value.alias("full"))).alias("url"),
        F.when(kind == "domain", F.struct(F.struct(value.alias("name")).alias("question"))).alias("dns"),
        F.when(kind.isin("ipv4", "ipv6", "ip_port"), value).alias("ip"),
        F.when(kind.isin("md5", "sha1", "sha256"), F.create_map(kind, value)).alias("hash"),
        F.when(kind == "email", F.struct(value.alias("address"))).alias("email"),
    )
    return F.to_json(typed)


def opencti_type(kind: Column) -> Column:
    return F.coalesce(_map(kind, OPENCTI_TYPES), F.lit("Text"))


def report_json(messages: DataFrame, indicators: DataFrame, on: str = "msg_id", order: str = "ord", per_part: int = 1000) -> DataFrame:
    """(on, part_no, report): JSON reports of a message with its indicators in order.

    A report holds the indicators of per_part places (`order` counts from 1), so a message with
    very many becomes several parts; one without any has part 0 with an empty list.
    """
    part = F.floor((F.coalesce(order, F.lit(1)) - 1) / per_part).cast("int")
    items = indicators.groupBy(on, part.alias("part_no")).agg(F.array_sort(F.collect_list(F.struct(order, "ioc_type", "value", "source", "context", "rewritten_from", "tags"))).alias("iocs"))
    others = [c for c in messages.columns if c != on]
    number = F.coalesce("part_no", F.lit(0)).alias("part_no")
    return messages.join(items, on, "left").select(on, number, F.to_json(F.struct(*others, number, F.coalesce("iocs", F.array().cast(items.schema["iocs"].dataType)).alias("iocs"))).alias("report"))


def stix_objects(indicators: DataFrame, level: Column | None = None) -> DataFrame:
    """(ioc_id, object): STIX 2.1 indicator objects as JSON; types without a pattern are left out."""
    none = F.array().cast("array<string>")
    labels = F.concat(F.array(level if level is not None else F.lit("unknown")), F.slice(F.coalesce("tags", none), 1, 8))
    fields = F.struct(
        F.lit("indicator").alias("type"), F.concat(F.lit("indicator--"), F.col("ioc_id").cast("string")).alias("id"), F.lit("2.1").alias("spec_version"), F.concat_ws(":", "ioc_type", F.substring("value", 1, 80)).alias("name"),
        stix_pattern(F.col("ioc_type"), F.col("value")).alias("pattern"), F.lit("stix").alias("pattern_type"), F.lit("1970-01-01T00:00:00.000Z").alias("valid_from"), labels.alias("labels"), F.coalesce("context", F.lit("")).alias("description"),
    )
    return indicators.where(F.col("ioc_type").isin(*STIX_PATHS) & F.col("value").isNotNull()).select("ioc_id", F.to_json(fields).alias("object"))


def opencti_objects(indicators: DataFrame) -> DataFrame:
    """(ioc_id, object): OpenCTI observables as JSON."""
    kind, value = F.col("ioc_type"), F.col("value")
    hashes = F.when(kind.isin("md5", "sha1", "sha256"), F.create_map(F.upper(kind), value))
    fields = F.struct(kind.alias("type"), value.alias("value"), F.coalesce("context", F.lit("")).alias("x_opencti_description"), F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 8).alias("labels"), opencti_type(kind).alias("entity_type"), hashes.alias("hashes"))
    return indicators.where("ioc_type is not null").select("ioc_id", F.to_json(fields).alias("object"))


#: Lines of a ticket: what stands before a value, and the value's name; a line without a value is left out.
TICKET = (("Verdict: ", "verdict"), ("Score: ", "score"), ("Campaign: ", "campaign"), ("Reason: ", "reason"), ("File: ", "file"), ("From: ", "from"), ("Subject: ", "subject"), ("Message-ID: ", "message_id"), ("Indicators:\n  ", "iocs"), ("Errors:\n  ", "errors"))


def ticket_values(triage: DataFrame, most: int = 40) -> DataFrame:
    """triage with `values`: a map of what a ticket may say of a message; indicators are defanged, at most `most` are listed."""
    from mirefold.functions.text import defang

    none = F.array().cast("array<string>")
    iocs = F.coalesce("top_iocs", none)
    listed = F.array_join(F.transform(F.slice(iocs, 1, most), defang), "\n  ")
    more = F.when(F.size(iocs) > most, F.concat(F.lit("\n  and "), (F.size(iocs) - most).cast("string"), F.lit(" more"))).otherwise("")
    text = {
        "verdict": F.col("verdict_level"), "score": F.col("verdict_score").cast("string"), "campaign": F.col("campaign_key"), "reason": F.col("top_reason"), "file": F.substring_index(F.translate("path", "\\", "/"), "/", -1),
        "from": F.col("sender"), "subject": F.col("subject"), "message_id": F.col("message_id"), "iocs": F.concat(listed, more), "errors": F.array_join(F.slice(F.coalesce("errors", none), 1, 5), "\n  "),
    }
    return triage.withColumn("values", F.create_map(*[x for k, v in text.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))]))


def tickets(template: str | None = None) -> Column:
    """The text of a ticket from `values`: a template in which {name} stands for a value, or the built-in lines."""
    if template is None:
        lines = [F.when(F.col("values")[name] != "", F.concat(F.lit(label), F.col("values")[name])) for label, name in TICKET]
        return F.concat_ws("\n", *lines)
    out = F.lit(template)
    for _, name in TICKET:
        out = F.replace(out, F.lit("{" + name + "}"), F.col("values")[name])
    return out


def campaign_pack(triage: DataFrame, key: str, order: str) -> DataFrame:
    """(place, line): JSON lines of a batch: first what it is, then a line a message in order. Only the counts pass through one task."""
    mails = triage.select(F.col(order).cast("long").alias("place"), F.to_json(F.struct(F.lit("mail").alias("type"), F.coalesce(F.col(key), F.lit("")).alias("campaign_key"), *[F.col(c) for c in ("path", "verdict_level", "verdict_score", "subject", "sender", "ioc_count")])).alias("line"))
    counts = triage.agg(F.count("*").alias("mail_count"), F.count_distinct(F.nullif(F.col(key), F.lit(""))).alias("campaign_count"))
    meta = counts.select(F.lit(-1).cast("long").alias("place"), F.to_json(F.struct(F.lit("campaign_pack_meta").alias("type"), "mail_count", "campaign_count")).alias("line"))
    return meta.unionByName(mails)


def write_lines(lines: DataFrame, column: str, path: str) -> None:
    """One text line a row (CEF, NDJSON)."""
    lines.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)

"""What a parsed message's headers say: its identity card, its signatures and its addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirefold.functions import text as tx
from mirefold.sources.mail import auth_results, header

# Fields of the identity card and their headers; headers whose text may hold indicators.
CARD = {
    "from_header": "From", "return_path": "Return-Path", "reply_to": "Reply-To", "subject": "Subject", "message_id": "Message-ID", "date": "Date", "in_reply_to": "In-Reply-To",
    "references": "References", "auto_submitted": "Auto-Submitted", "list_id": "List-Id", "list_unsubscribe": "List-Unsubscribe", "precedence": "Precedence",
}
SPOKEN = ("Subject", "From", "Reply-To", "Return-Path", "Sender", "Resent-From", "To", "Cc", "List-Unsubscribe")


def values_of(name: str) -> Column:
    """All values of a header, in order."""
    return F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def identity(parsed: DataFrame) -> DataFrame:
    """path and the 17 fields of the identity card; absent headers are empty."""
    rows = auth_results(parsed)
    received = values_of("Received")
    return rows.select("path", *[F.coalesce(header(h), F.lit("")).alias(n) for n, h in CARD.items()], *[F.coalesce(c, F.lit("")).alias(c) for c in ("spf", "dkim", "dmarc")], F.size(received).alias("received_hops"), F.substring(F.coalesce(F.get(received, F.lit(0)), F.lit("")), 1, 300).alias("first_received"))


def header_text(parsed: DataFrame) -> DataFrame:
    """(path, text): the header values that may hold indicators, one a line, as "Name: value"."""
    lines = F.filter("headers", lambda h: F.lower(h["name"]).isin(*[n.lower() for n in SPOKEN]))
    return parsed.select("path", F.array_join(F.transform(lines, lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n").alias("text"))


def signing_domains() -> Column:
    """The domains (d=) of a message's DKIM signatures."""
    found = F.flatten(F.transform(values_of("DKIM-Signature"), lambda v: F.regexp_extract_all(F.concat(F.lit(";"), F.lower(v)), F.lit(r";\s*d\s*=\s*([a-z0-9.-]+)"), F.lit(1))))
    return F.array_distinct(F.transform(found, lambda d: F.regexp_replace(d, r"^\.+|\.+$", "")))


def alignment(parsed: DataFrame) -> DataFrame:
    """(path, signed, sender): messages whose DKIM domain isn't the sender's.

    The results headers decide where they name both domains (header.d or
    header.i, and header.from); else the signatures against the address of From.
    """
    results = F.transform(values_of("Authentication-Results"), F.lower)
    named = lambda key, v: F.regexp_extract_all(v, F.lit(rf"header\.{key}\s*=\s*(?:[^\s;@]*@)?([a-z0-9.-]+)"), F.lit(1))
    pairs = F.transform(results, lambda v: F.struct(F.concat(named("d", v), named("i", v)).alias("d"), named("from", v).alias("f")))
    unrelated = lambda d, fs: ~F.exists(fs, lambda f: tx.related(d, f))
    wrong = F.flatten(F.transform(F.filter("__pairs", lambda p: (F.size(p["d"]) > 0) & (F.size(p["f"]) > 0)), lambda p: F.transform(F.filter(p["d"], lambda d: unrelated(d, p["f"])), lambda d: F.struct(d.alias("signed"), F.get(p["f"], F.lit(0)).alias("sender")))))
    has_pair = F.exists("__pairs", lambda p: (F.size(p["d"]) > 0) & (F.size(p["f"]) > 0))
    sender = F.regexp_extract(F.lower(F.coalesce(header("From"), F.lit(""))), r"@([^@>\s()]+)", 1)
    own = F.transform(F.filter(signing_domains(), lambda d: (F.col("__sender") != "") & ~tx.related(d, F.col("__sender"))), lambda d: F.struct(d.alias("signed"), F.col("__sender").alias("sender")))
    rows = parsed.withColumn("__pairs", pairs).withColumn("__sender", sender).withColumn("__wrong", F.when(has_pair, wrong).otherwise(own))
    return rows.where(F.size("__wrong") > 0).select("path", F.get("__wrong", F.lit(0))["signed"].alias("signed"), F.get("__wrong", F.lit(0))["sender"].alias("sender"))


def more_findings(parsed: DataFrame) -> DataFrame:
    """(path, finding, severity) of headers that the identity card doesn't keep: another Sender or Resent-From, a broken chain of ARC, no results of authentication."""
    rows = auth_results(parsed)
    domain = lambda name: F.coalesce(F.regexp_extract(F.lower(header(name)), r"@([^@>\s()]+)", 1), F.lit(""))
    sender = domain("From")
    apart = lambda name: (domain(name) != "") & (sender != "") & ~tx.related(sender, domain(name))
    results, seals, said = (F.transform(values_of(n), F.lower) for n in ("ARC-Authentication-Results", "ARC-Seal", "Authentication-Results"))
    failed = lambda v: F.exists(v, lambda x: x.rlike(r"(?:spf|dkim|dmarc)\s*=\s*fail"))
    arc, broken = F.size(results) + F.size(seals) > 0, failed(results) | F.exists(seals, lambda x: x.rlike(r"\bcv\s*=\s*fail\b"))
    trusted = (F.coalesce(header("List-Id"), F.lit("")) != "") | (F.coalesce(F.col("dmarc"), F.lit("")) == "pass")
    found = {
        "sender_mismatch": F.when(apart("Sender"), F.when(trusted, "info").otherwise("high")),
        "resent_from": F.when(apart("Resent-From"), "medium"),
        "arc_failed": F.when(arc & broken, "high"),
        "arc": F.when(arc & ~broken, "info"),
        "no_arc": F.when(~arc & failed(said), "low"),
        "no_auth_header": F.when(F.size(said) == 0, "low"),
    }
    each = F.array(*[F.struct(F.lit(n).alias("finding"), s.alias("severity")) for n, s in found.items()])
    return rows.select("path", F.explode(each).alias("f")).select("path", "f.finding", "f.severity").where("severity is not null")


def unsubscribe_hosts(c: Column) -> Column:
    """Hosts of the web and mail addresses in List-Unsubscribe."""
    web = F.regexp_extract_all(F.lower(c), F.lit(r"https?://([^\s/:?#>]+)"), F.lit(1))
    mail = F.regexp_extract_all(F.lower(c), F.lit(r"mailto:[^@\s>]+@([^\s?>]+)"), F.lit(1))
    return F.array_distinct(F.concat(web, mail))


def originating_hop(parsed: DataFrame) -> DataFrame:
    """(path, hop): the Received line nearest to the sender."""
    return parsed.select("path", F.element_at(values_of("Received"), -1).alias("hop")).where("hop is not null")


def attachment_indicators(parsed: DataFrame) -> DataFrame:
    """(path, ioc_type, value, tags): the name and, unless the file is empty, the hashes of each attachment, names of members and targets."""
    each = parsed.select("path", F.explode("attachments").alias("a"))
    tag = F.concat(F.lit("file:"), F.col("a.filename"))
    item = lambda kind, value, *tags: F.struct(F.lit(kind).alias("ioc_type"), value.alias("value"), F.array(*[F.lit(t) for t in tags], tag).alias("tags"))
    own = F.array(item("filename", F.col("a.filename")), *[F.when(F.col("a.size") > 0, item(h, F.col(f"a.{h}"), "attachment_hash")) for h in ("md5", "sha1", "sha256")])
    members = F.transform("a.entries", lambda e: item("filename", e, "archive_member"))
    targets = F.transform(F.filter("a.targets", lambda t: F.lower(t).rlike("^https?://")), lambda t: item("url", t, "attachment_link"))
    return each.select("path", F.explode(F.array_compact(F.concat(own, members, targets))).alias("i")).select("path", "i.*").where("value <> ''")

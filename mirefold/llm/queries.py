"""The queries of the training-text problems over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirefold.llm.garbled import Restorer, learn, restored, well_formed_texts
from mirefold.llm.mixing import mixed
from mirefold.llm.newtext import new_lines
from mirefold.llm.packing import packed
from mirefold.llm.pieces import split_texts
from mirefold.llm.radix import collapse, copies
from mirefold.llm.variants import normalised
from mirefold.operators.timestamps import instants
from mirefold.plans.training import message_key
from mirefold.session import table

_ENCLOSURES = r"""[\s\p{Z}"'`´＂＇\p{Pi}\p{Pf}\p{Ps}\p{Pe}<>＜＞]"""


def canonical_type(column: Column) -> Column:
    """Letters and digits alone, without case."""
    return F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]", "")


def canonical_value(column: Column) -> Column:
    """Without case, white space, quotes and brackets, and without other punctuation at either end."""
    inner = F.regexp_replace(F.lower(column), _ENCLOSURES, "")
    return F.regexp_replace(inner, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")


def raw_part(name: str) -> Column:
    """A field of a serialised record: an XML attribute, a JSON member, or name=value / name: value."""
    line = F.trim(F.col("line"))
    others = "|".join(x for x in ("type", "value", "origin") if x != name)
    quoted = F.regexp_extract(line, rf'(?is)^[{{<].*?[\s,{{"]{name}"?\s*[=:]\s*"((?:[^"\\]|\\.)*)"', 1)
    plain = F.regexp_extract(line, rf"(?is)(?:^|[;|\r\n])\s*{name}\s*[=:]\s*(.*?)\s*(?:[;|\r\n]+\s*(?:{others})\s*[=:]|$)", 1)
    unescaped = F.when(line.startswith("{"), F.regexp_replace(quoted, r"\\(.)", "$1")).otherwise(
        F.replace(F.replace(F.replace(F.replace(F.replace(quoted, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    )
    return F.when(line.rlike(r"^[{<]"), unescaped).otherwise(plain)


def indicator_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, id, key) of ioc and ioc_raw: the content of a row as canonical bytes."""
    ioc = table(spark, folder, "ioc").select(F.lit("ioc").alias("tbl"), F.col("ioc_id").alias("id"), F.concat_ws("\x01", F.lit("i"), canonical_type(F.col("ioc_type")), F.when(F.col("value").isNotNull(), canonical_value(F.col("value")))).alias("k"), "value")
    raw = table(spark, folder, "ioc_raw").select(F.lit("ioc_raw").alias("tbl"), F.col("raw_id").alias("id"), F.concat_ws("\x01", F.lit("r"), canonical_type(raw_part("type")), canonical_value(raw_part("value")), canonical_value(raw_part("origin"))).alias("k"), F.col("line").alias("value"))
    return ioc.unionByName(raw).where("value is not null").select("tbl", "id", F.encode("k", "UTF-8").alias("key"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that are a copy of a row with a smaller id in the same table."""
    keyed = indicator_keys(spark, folder)
    return copies(keyed, ["tbl", "id"]).select("tbl", F.col("id").alias("row_id"), "first_id")


def p4_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Each content once, with the number of its copies."""
    counts = collapse(indicator_keys(spark, folder))
    tbl = F.when(F.substring("key", 1, 1) == F.lit(b"i"), "ioc").otherwise("ioc_raw")
    return counts.select(tbl.alias("tbl"), "first_id", "copies")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or part of one, with its container."""
    limit = table(spark, folder, "size_limit").where("purpose = 'container'").first()
    return packed(table(spark, folder, "documents"), "doc_id", "text", limit["max_tokens"])


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents used, how often, and the shares reached."""
    targets = [(r["source"], r["weight"], r["max_repeats"]) for r in table(spark, folder, "mix_target").collect()]  # one row a source, a fixed table
    return mixed(table(spark, folder, "documents"), "doc_id", "text", "source", targets)


def p10_pieces(spark: SparkSession, folder: str, with_text: bool = True) -> DataFrame:
    """All pieces of all documents."""
    limit = table(spark, folder, "size_limit").where("purpose = 'piece'").first()
    return split_texts(table(spark, folder, "documents"), "doc_id", "text", limit["max_tokens"], limit["overlap_tokens"], with_text)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be cut."""
    return p10_pieces(spark, folder).where("piece_no = 1 and n_pieces > 1").select("doc_id")


def _garbled_fields(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    mail = table(spark, folder, "mail").select(F.col("mail_id").alias("row_id"), "subject", "text")
    senders = table(spark, folder, "mail_identity").select(F.col("ident_id").alias("row_id"), "from_header")
    return mail, senders


def _restorer(spark: SparkSession, folder: str) -> Restorer:
    mail, senders = _garbled_fields(spark, folder)
    texts = mail.unionByName(senders, allowMissingColumns=True)
    return learn(texts, {c: F.col(c) for c in ("subject", "text", "from_header")})


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The fields that were decoded wrongly, with what could be restored."""
    mail, senders = _garbled_fields(spark, folder)
    model = _restorer(spark, folder)
    in_mail = restored(mail, "row_id", {"subject": F.col("subject"), "text": F.col("text")}, model)
    in_senders = restored(senders, "row_id", {"from_header": F.col("from_header")}, model)
    return in_mail.select(F.lit("mail").alias("tbl"), "*").unionByName(in_senders.select(F.lit("mail_identity").alias("tbl"), "*"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_restored(spark, folder).select("tbl", "row_id", "field_name")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each mail that its sender newly wrote."""
    mail = table(spark, folder, "mail").select("mail_id", "text", "sender")
    links = table(spark, folder, "mail_identity").select(F.col("ident_id").alias("mail_id"), "subject", "in_reply_to", F.col("references_hdr").alias("references"), "date_hdr", F.unix_micros("ingested_at").alias("ingested"), "site_id", message_key("message_id").alias("message"))
    site = table(spark, folder, "site").select("site_id", "tz_name", "day_order")
    dated = instants(links.select("mail_id", "site_id", "date_hdr").join(site, "site_id", "left"), "date_hdr", "day_order", "tz_name", keep=["mail_id"])
    joined = mail.join(links.drop("date_hdr", "site_id"), "mail_id", "left").join(dated, "mail_id", "left")
    return new_lines(joined.withColumn("sent", F.coalesce("utc_us", "ingested")), clean=well_formed_texts)


def _with_variants(spark: SparkSession, folder: str, name: str, row_id: str, column: str) -> DataFrame:
    rows = table(spark, folder, name).select(F.col(row_id).alias("row_id"), F.col(column).alias("v"))
    return normalised(rows, "v", only_changed=True).select(F.lit(name).alias("tbl"), "row_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose text contains variant characters, without those decoded wrongly."""
    headers = _garbled_fields(spark, folder)[1]
    wrong = restored(headers, "row_id", {"from_header": F.col("from_header")}, _restorer(spark, folder)).select("row_id")
    senders = _with_variants(spark, folder, "mail_identity", "ident_id", "from_header").join(wrong, "row_id", "left_anti").select("tbl", "row_id")
    return senders.unionByName(_with_variants(spark, folder, "ioc", "ioc_id", "value")).unionByName(_with_variants(spark, folder, "lookalike_hit", "hit_id", "value"))


def p7_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators and hits whose text contains variant characters."""
    return _with_variants(spark, folder, "ioc", "ioc_id", "value").unionByName(_with_variants(spark, folder, "lookalike_hit", "hit_id", "value"))


def p8_whole(spark: SparkSession, folder: str) -> DataFrame:
    """How many tokens of each document the containers hold."""
    return p8_containers(spark, folder).groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"))


def p10_whole(spark: SparkSession, folder: str) -> DataFrame:
    """How many tokens of each document the pieces hold besides their overlaps."""
    return p10_pieces(spark, folder, with_text=False).groupBy("doc_id").agg(F.sum(F.col("n_tokens") - F.col("overlap_tokens")).alias("tokens"))


def p8_fit(spark: SparkSession, folder: str) -> DataFrame:
    """How many tokens the containers hold in all, how many are overfull, and
    whether there are no more than the tokens need plus one a group.
    """
    limit = table(spark, folder, "size_limit").where("purpose = 'container'").first()["max_tokens"]
    full = p8_containers(spark, folder).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    out = full.agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > limit).alias("overfull"), F.count("*").alias("containers"), F.count_distinct(F.shiftright("container_id", 32)).alias("groups"))
    return out.select("tokens", "overfull", (F.col("containers") <= F.ceil(F.col("tokens") / limit) + F.col("groups")).alias("tight"))


def p8_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that had to be divided, and the tokens of their parts."""
    return p8_containers(spark, folder).groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("tokens")).where("parts > 1").select("doc_id", "tokens")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Per source whether its tokens are its weight's share of the mixture
    (each source may miss its own by half a text, hence the sum too), whether
    the share that was reported is true, and whether no text is used more
    often than allowed.
    """
    documents = table(spark, folder, "documents").select("source", F.octet_length("text").alias("n")).where("n > 0")
    largest = documents.groupBy("source").agg(F.max("n").alias("largest"))
    target = table(spark, folder, "mix_target").where("weight > 0 and max_repeats > 0").join(largest, "source")
    used = p9_mix(spark, folder).groupBy("source").agg(F.max("copies").alias("most"), F.max("actual_share").alias("share"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    told = target.join(used, "source", "left").fillna(0)
    whole = W.partitionBy(F.lit(0))  # as many rows as targets
    told = told.withColumn("total", F.sum("tokens").over(whole)).withColumn("slack", F.max("largest").over(whole))
    near = F.abs(F.col("tokens") - F.col("weight") * F.col("total")) <= 0.005 * F.col("total") + 5 * F.col("slack")
    return told.select("source", near.alias("near"), (F.abs(F.col("share") - F.col("tokens") / F.col("total")) < 1e-9).alias("reported"), (F.col("most") <= F.col("max_repeats")).alias("within"))


def p10_joined(spark: SparkSession, folder: str) -> DataFrame:
    """What the pieces of a text are without their overlaps, one after the other, and whether all keep to the limits."""
    limit = table(spark, folder, "size_limit").where("purpose = 'piece'").first()
    body = F.encode("piece_text", "UTF-8")
    pieces = p10_pieces(spark, folder).select("doc_id", "piece_no", body.alias("whole"), F.expr("substring(encode(piece_text, 'UTF-8'), overlap_tokens + 1)").alias("own"), "overlap_tokens")
    fits = (F.octet_length("whole") <= limit["max_tokens"]) & (F.col("overlap_tokens") <= limit["overlap_tokens"])
    each = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "own"))).alias("p"), F.bool_and(fits).alias("fits"))  # as long as the text
    return each.select("doc_id", F.sha2(F.concat_ws("", F.transform("p", lambda x: F.decode(x["own"], "UTF-8"))), 256).alias("text_sha256"), "fits")


QUERIES = {"p4_found": p4_found, "p4_copies": p4_copies, "p5_found": p5_found, "p6_found": p6_found, "p6_restored": p6_restored, "p7_found": p7_found, "p8_containers": p8_containers, "p9_mix": p9_mix, "p10_found": p10_found, "p10_pieces": p10_pieces, "p7_indicators": p7_indicators, "p8_whole": p8_whole, "p10_whole": p10_whole, "p8_fit": p8_fit, "p8_parts": p8_parts, "p9_shares": p9_shares, "p10_joined": p10_joined}

_DUCK_KEYS = r"""
with src as (
  select 'ioc' as tbl, ioc_id as id, ioc_type as t, value as v, '' as o from ioc
  union all
  select 'ioc_raw', raw_id,
    case when l ~ '^[{<].*' then regexp_extract(l, '^[{<].*?[\s,{"]type"?\s*[=:]\s*"((?:[^"\\]|\\.)*)"', 1, 'is') else regexp_extract(l, '(?:^|[;|\r\n])\s*type\s*[=:]\s*(.*?)\s*(?:[;|\r\n]+\s*(?:value|origin)\s*[=:]|$)', 1, 'is') end,
    case when l ~ '^[{<].*' then regexp_extract(l, '^[{<].*?[\s,{"]value"?\s*[=:]\s*"((?:[^"\\]|\\.)*)"', 1, 'is') else regexp_extract(l, '(?:^|[;|\r\n])\s*value\s*[=:]\s*(.*?)\s*(?:[;|\r\n]+\s*(?:type|origin)\s*[=:]|$)', 1, 'is') end,
    case when l ~ '^[{<].*' then regexp_extract(l, '^[{<].*?[\s,{"]origin"?\s*[=:]\s*"((?:[^"\\]|\\.)*)"', 1, 'is') else regexp_extract(l, '(?:^|[;|\r\n])\s*origin\s*[=:]\s*(.*?)\s*(?:[;|\r\n]+\s*(?:type|value)\s*[=:]|$)', 1, 'is') end
  from (select raw_id, trim(line) as l from ioc_raw)),
k as (
  select tbl, id, regexp_replace(lower(t), '[^\p{L}\p{N}]', '', 'g') as t,
    regexp_replace(regexp_replace(lower(case when tbl = 'ioc_raw' then replace(v, '\\', '\') else v end), '[\s\p{Z}"''`´＂＇\p{Pi}\p{Pf}\p{Ps}\p{Pe}<>＜＞]', '', 'g'), '^[\p{P}\p{S}]+|[\p{P}\p{S}]+$', '', 'g') as v,
    regexp_replace(regexp_replace(lower(o), '[\s\p{Z}"''`´＂＇\p{Pi}\p{Pf}\p{Ps}\p{Pe}<>＜＞]', '', 'g'), '^[\p{P}\p{S}]+|[\p{P}\p{S}]+$', '', 'g') as o
  from src where v is not null)
"""
_WHOLE = "select doc_id, cast(sum(strlen(text)) as bigint) as tokens from documents where text is not null group by 1"
_VARIANT = "|".join(
    (
        r"[\x{FF01}-\x{FF5E}\x{1D400}-\x{1D7FF}]",
        r"[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]",
        r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]",
        r"\p{L}[\x{0300}-\x{036F}]",
        r"\p{Latin}[\p{Cyrillic}\p{Greek}]|\p{Cyrillic}[\p{Latin}\p{Greek}]|\p{Greek}[\p{Latin}\p{Cyrillic}]",
    )
)
SQL = {
    "p7_indicators": f"select 'ioc' as tbl, ioc_id as row_id from ioc where regexp_matches(value, '{_VARIANT}') union all select 'lookalike_hit', hit_id from lookalike_hit where regexp_matches(value, '{_VARIANT}')",
    "p8_whole": _WHOLE,
    "p8_fit": "select cast(sum(strlen(text)) as bigint) as tokens, cast(0 as bigint) as overfull, true as tight from documents",
    "p8_parts": "with c as (select max_tokens as m from size_limit where purpose = 'container') select doc_id, cast(strlen(text) as bigint) as tokens from documents, c where strlen(text) > m",
    "p9_shares": "select t.source, true as near, true as reported, true as within from mix_target t where t.weight > 0 and t.max_repeats > 0 and exists (select 1 from documents d where d.source = t.source and strlen(d.text) > 0)",
    "p10_joined": "select doc_id, sha256(text) as text_sha256, true as fits from documents where text is not null",
    "p10_whole": _WHOLE,
    "p4_found": _DUCK_KEYS + "select tbl, id as row_id, first_id from (select *, min(id) over (partition by tbl, t, v, o) as first_id from k) where id <> first_id",
    "p4_copies": _DUCK_KEYS + "select tbl, min(id) as first_id, count(*) as copies from k group by tbl, t, v, o",
    "p10_found": "select doc_id from documents where strlen(text) > (select max_tokens from size_limit where purpose = 'piece')",
}

"""The queries of the general training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirefold.operators.packed import split_packed
from mirefold.operators.quotient import redelivered
from mirefold.operators.timestamps import instants
from mirefold.plans.training_sql import dates_sql
from mirefold.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every readable date of the three fields as one instant."""
    mail = table(spark, folder, "mail_identity")
    received = F.when(F.instr("first_received", ";") > 0, F.substring_index("first_received", ";", -1))
    fields = mail.select(
        F.lit("mail_identity").alias("tbl"), F.col("ident_id").alias("row_id"), "site_id",
        F.explode(F.array(
            F.struct(F.lit("date_hdr").alias("field_name"), F.col("date_hdr").alias("v")),
            F.struct(F.lit("first_received").alias("field_name"), received.alias("v")),
        )).alias("f"),
    ).select("tbl", "row_id", "site_id", "f.field_name", "f.v")
    feedback = table(spark, folder, "feedback").select(F.lit("feedback").alias("tbl"), F.col("feedback_id").alias("row_id"), "site_id", F.lit("recorded_at").alias("field_name"), F.col("recorded_at").alias("v"))
    site = table(spark, folder, "site").select("site_id", "tz_name", "day_order")
    dated = fields.unionByName(feedback).where("v is not null").join(site, "site_id", "left")
    return instants(dated, "v", "day_order", "tz_name", keep=["tbl", "row_id", "field_name"])


def message_key(column: str):
    """An identifier apart from letter case, surrounding white space and angle brackets; null where blank."""
    inner = F.lower(F.regexp_replace(column, r"^[\s<>]+|[\s<>]+$", ""))
    return F.when(inner != "", inner)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of triage and mail_identity that repeat a message."""
    path = F.lower(F.translate("path", "\\", "/"))
    by_path = F.when(F.trim(path) != "", F.concat(F.lit("path "), path))
    triage = table(spark, folder, "triage").select(F.lit("triage").alias("tbl"), F.col("triage_id").alias("row_id"), F.coalesce(F.concat(F.lit("id "), message_key("message_id")), by_path).alias("k"), "ingested_at")
    mail = table(spark, folder, "mail_identity").select(F.lit("mail_identity").alias("tbl"), F.col("ident_id").alias("row_id"), F.concat(F.lit("id "), message_key("message_id")).alias("k"), "ingested_at")
    return redelivered(triage.unionByName(mail), "k", "ingested_at", "row_id", group="tbl")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the fields that pack several, with its place."""
    mail = split_packed(table(spark, folder, "mail_identity"), "ident_id", {"references_hdr": F.col("references_hdr")})
    ioc = split_packed(table(spark, folder, "ioc"), "ioc_id", {"rewritten_from": F.col("rewritten_from"), "tags": F.col("tags")})
    columns = ["row_id", "field_name", "pos", "value"]
    return mail.select(F.lit("mail_identity").alias("tbl"), *columns).unionByName(ioc.select(F.lit("ioc").alias("tbl"), *columns))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found}
SQL: dict[str, str] = {
    "p1_found": dates_sql(),
    "p2_found": r"""
with k as (
  select 'triage' as tbl, triage_id as row_id, ingested_at,
         coalesce('id ' || nullif(lower(regexp_replace(message_id, '^[\s<>]+|[\s<>]+$', '', 'g')), ''),
                  case when trim(path) <> '' then 'path ' || lower(replace(path, chr(92), '/')) end) as k
  from triage
  union all
  select 'mail_identity', ident_id, ingested_at, 'id ' || nullif(lower(regexp_replace(message_id, '^[\s<>]+|[\s<>]+$', '', 'g')), '')
  from mail_identity)
select tbl, row_id from (
  select *, row_number() over (partition by tbl, k order by ingested_at nulls last, row_id) as n from k where k is not null)
where n > 1""",
    "p3_found": r"""
with f as (
  select 'mail_identity' as tbl, ident_id as row_id, 'references_hdr' as field_name, [references_hdr] as v from mail_identity
  union all select 'ioc', ioc_id, 'rewritten_from', [rewritten_from] from ioc
  union all select 'ioc', ioc_id, 'tags', tags from ioc),
e as (
  select tbl, row_id, field_name, list_transform(v, lambda x: regexp_extract_all(x, '"(?:[^"]|"")*"(?:@[^\s,;|"<>]+)?|<(?:"[^"]*")?[^<>"]*>|[^\s,;|"<>]+')) as parts
  from f where v is not null),
p as (
  select tbl, row_id, field_name, flatten(list_filter(parts, lambda x: x is not null)) as flat
  from e where len(list_filter(parts, lambda x: len(x) > 1)) > 0),
u as (select tbl, row_id, field_name, unnest(flat) as raw, generate_subscripts(flat, 1) as pos from p)
select tbl, row_id, field_name, cast(pos as integer) as pos,
       regexp_replace(trim(case when raw like '"%"' then replace(substr(raw, 2, length(raw) - 2), '""', '"') else raw end), '^<([^<>]*)>$', '\1') as value
from u""",
}

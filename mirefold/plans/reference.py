"""Queries of the triage operators over the test tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirefold.functions import rewriters
from mirefold.functions import text as tx
from mirefold.operators import campaigns, indicators, lookalikes, scoring
from mirefold.operators import signals as signal_rules
from mirefold.operators.packed import split_packed
from mirefold.session import shared_folder, table
from mirefold.sources import exports
from mirefold.sources import mail as mail_source
from mirefold.streaming import triage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RAW_IPV4 = tx.IPV4


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- indicators in text ---------------------------------------------------------------------

_TEXTS = """t as (select 'mail ' || mail_id as id, text from mail union all select 'documents ' || doc_id, text from documents
 union all select 'ioc ' || ioc_id, value from ioc union all select 'ioc_raw ' || raw_id, line from ioc_raw)"""
_PATTERN = {name: (kind, pattern, alphabet) for name, kind, pattern, alphabet in indicators.PATTERNS}


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) of everything that may hold indicators: mails, documents, indicator values and serialised indicators."""
    part = lambda name, row_id, text: table(spark, folder, name).select(F.concat_ws(" ", F.lit(name), F.col(row_id).cast("string")).alias("id"), F.col(text).alias("text"))
    return part("mail", "mail_id", "text").unionByName(part("documents", "doc_id", "text")).unionByName(part("ioc", "ioc_id", "value")).unionByName(part("ioc_raw", "raw_id", "line"))


def _found_sql(*kinds: str) -> str:
    values = {"cve": "upper(raw)", "md5": "lower(raw)", "sha1": "lower(raw)", "sha256": "lower(raw)", "messenger": "case when regexp_matches(raw, '(?i)^https?://') then raw else 'https://' || raw end"}
    where = {"filepath": "length(value) >= 6", "ipv6": "length(value) > 2", **dict.fromkeys(indicators.HASHES, "regexp_matches(value, '[0-9]') and regexp_matches(value, '[a-f]')")}
    parts = []
    for k in kinds:
        kind, pattern, alphabet = _PATTERN[k]
        p = pattern.replace("'", "''")
        found = f"regexp_extract_all(text, '{p}', 1)" if kind == "find" else f"list_filter(regexp_extract_all(text, '{alphabet}+'), lambda x: regexp_full_match(x, '{p}'))"
        parts.append(f"select id, '{k}' as ioc_type, value, count(*) as n from (select id, {values.get(k, 'raw')} as value from (select id, unnest({found}) as raw from t)) where {where.get(k, 'true')} group by all")
    return f"with {_TEXTS} " + " union all ".join(parts)


def _types(*kinds: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return indicators.found_in(_texts(spark, folder), "id", "text", kinds).groupBy("id", "ioc_type", "value").agg(F.count("*").alias("n"))

    return run


for _name, _kinds in {"ioc_url": ("url", "messenger"), "ioc_email": ("email",), "ioc_addresses": ("ipv4", "ipv6"), "ioc_hashes": indicators.HASHES, "ioc_host_artifacts": ("cve", "registry", "mutex", "filepath", "unc", "monero")}.items():
    QUERIES[_name], SQL[_name] = _types(*_kinds), _found_sql(*_kinds)


@query()
def ioc_extracted(spark: SparkSession, folder: str) -> DataFrame:
    """All indicators of all texts, each once a text."""
    return indicators.extracted(_texts(spark, folder), "id", "text").select("id", "ioc_type", "key", "value", F.array_join("tags", "|").alias("tags"), "context", "copies")


@query()
def ioc_wallets(spark: SparkSession, folder: str) -> DataFrame:
    """Bitcoin addresses whose checksum holds, in the tables and in two samples."""
    samples = spark.createDataFrame([("sample 0", "pay to 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa or bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"), ("sample 1", "not to 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb")], "id string, text string")
    return indicators.wallets_in(_texts(spark, folder).unionByName(samples), "id", "text")


@query("""select raw_id, ip, a in (10, 127, 0) or (a = 169 and b = 254) or (a = 192 and b = 168) or (a = 172 and b between 16 and 31) or (a = 100 and b between 64 and 127) as private
from (select ioc_id as raw_id, split_part(value, ':', 1) as ip, cast(split_part(value, '.', 1) as integer) as a, cast(split_part(value, '.', 2) as integer) as b
      from ioc where regexp_full_match(value, '(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)(?::\\d+)?'))""".replace("\\\\", "\\"))
def ioc_private_ipv4(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the written IPv4 addresses belong to private or shared networks."""
    rows = table(spark, folder, "ioc").where(F.col("value").rlike(rf"^{tx.IPV4}(?::\d+)?\z")).select(F.col("ioc_id").alias("raw_id"), F.substring_index("value", ":", 1).alias("ip"))
    return rows.select("raw_id", "ip", tx.is_private_ipv4(F.col("ip")).alias("private"))


@query("""select mail_id, host, count(*) as n from (
  select mail_id, lower(split_part(unnest(regexp_extract_all(text, '(?i)\\b([a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,})\\b', 1)), '@', -1)) as host from mail) where host <> '' group by all""".replace("\\\\", "\\"))
def ioc_domains_of_emails(spark: SparkSession, folder: str) -> DataFrame:
    """Domains that the addresses in a text name."""
    found = indicators.found_in(table(spark, folder, "mail").select("mail_id", "text"), "mail_id", "text", ("email",))
    return indicators.derived_hosts(found, "mail_id").groupBy("mail_id", F.col("value").alias("host")).agg(F.count("*").alias("n"))


@query("select coalesce(ioc_type, '') as ioc_type, count(*) as n, count(distinct msg_id) as mails from ioc group by 1")
def ioc_counts_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ioc").groupBy(F.coalesce("ioc_type", F.lit("")).alias("ioc_type")).agg(F.count("*").alias("n"), F.count_distinct("msg_id").alias("mails"))


# --- strings, hosts and URLs ------------------------------------------------------------------


@query("select ioc_id, replace(replace(regexp_replace(value, '\\bhttp([sS]?://)', 'hxxp\\1', 'g'), '.', '[.]'), '[[.]]', '[.]') as defanged from ioc where value is not null".replace("\\\\", "\\"))
def ioc_defanged(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ioc").where("value is not null").select("ioc_id", tx.defang(F.col("value")).alias("defanged"))


def _refang_sql() -> str:
    out = "value"
    for written, meant in tx.FANGS:
        pattern = "".join("\\" + c if not c.isalnum() else c for c in written)
        out = f"regexp_replace({out}, '{pattern}', '{meant}', 'gi')"
    out = rf"regexp_replace({out}, '(?i)\b([a-z0-9\-]+)\s+dot\s+([a-z0-9\-]+)\s+dot\s+([a-z]{{2,24}})\b', '\1.\2.\3', 'g')"
    return rf"select ioc_id, regexp_replace({out}, '(?i)\b([a-z0-9\-]+)\s+dot\s+([a-z]{{2,24}})\b', '\1.\2', 'g') as value from ioc where value is not null"


@query(_refang_sql())
def ioc_refanged(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ioc").where("value is not null").select("ioc_id", tx.refang(F.col("value")).alias("value"))


_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?)?([^?#]*)(\?[^#]*)?"
_DUCK_URL = rf"""u as (select ioc_id, regexp_extract(trim(value, ' '), '{_URL}', 1) as scheme, lower(regexp_replace(regexp_extract(trim(value, ' '), '{_URL}', 3), '[\[\]]', '', 'g')) as host,
  regexp_extract(trim(value, ' '), '{_URL}', 4) as port, regexp_extract(trim(value, ' '), '{_URL}', 5) as path, regexp_extract(trim(value, ' '), '{_URL}', 6) as query
  from ioc where value ilike '%://%')"""


@query(rf"""with {_DUCK_URL}
select ioc_id, host, lower(case when scheme = '' then 'http' else scheme end) || '://' || regexp_replace(host, '^www\.', '') || case when regexp_matches(port, '^0*$') then '' else ':' || regexp_replace(port, '^0+', '') end
  || case when path = '/' then path else regexp_replace(path, '/+$', '') end || case when query = '?' then '' else query end as url_key from u""")
def url_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Host and comparable form of every indicator that is a URL."""
    rows = table(spark, folder, "ioc").where(F.col("value").contains("://"))
    return rows.select("ioc_id", tx.url_host(F.col("value")).alias("host"), tx.url_key(F.col("value")).alias("url_key"))


@query("""with h as (select ioc_id, lower(host) as host, list_filter(string_split(lower(trim(host)), '.'), lambda x: trim(x) <> '') as l from ioc where host is not null)
select ioc_id, reg, split_part(reg, '.', 1) as label, case when contains(reg, '.') then substr(reg, instr(reg, '.') + 1) else '' end as zone, regexp_replace(regexp_replace(host, '\\.+$', ''), '^www\\.', '') as domain_key
from (select ioc_id, host, case when len(l) >= 3 and array_to_string(l[-2:], '.') in ('co.uk', 'com.br', 'com.au', 'com.tr') then array_to_string(l[-3:], '.') when len(l) >= 2 then array_to_string(l[-2:], '.') else lower(trim(host)) end as reg from h)""".replace("\\\\", "\\"))
def host_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Registrable name, label and zone of every known host."""
    rows = table(spark, folder, "ioc").where("host is not null")
    h = F.col("host")
    return rows.select("ioc_id", tx.registrable(h).alias("reg"), tx.first_label(h).alias("label"), tx.zone_of(h).alias("zone"), tx.domain_key(h).alias("domain_key"))


@query(r"""with s as (select ioc_id, regexp_replace(rewritten_from, '[.,;:!?)]+$', '') as u from ioc where regexp_full_match(rewritten_from, 'https?://[^\s,;|"]+')),
t as (select ioc_id, u, regexp_extract(u, '[?&]u=([^&#]*)', 1) as p from s),
d as (select ioc_id, u, regexp_replace(url_decode(url_decode(p)), '[.,;:!?)]+$', '') as target from t)
select ioc_id, u as original, case when starts_with(target, 'http') then target else u end as unwrapped, coalesce(starts_with(target, 'http'), false) as changed from d""")
def url_unwrapped(spark: SparkSession, folder: str) -> DataFrame:
    """Where rewritten links lead."""
    rows = table(spark, folder, "ioc").where(F.col("rewritten_from").rlike(r'^https?://[^\s,;|"]+$')).select("ioc_id", "rewritten_from")
    return rewriters.unwrap(rows, "rewritten_from", hops=1).select("ioc_id", "original", "unwrapped", "changed")


@query()
def url_unwrap_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Targets of rewritten links through up to five rewriters, with the chain."""
    rows = table(spark, folder, "ioc")
    packed = split_packed(rows, "ioc_id", {"rewritten_from": F.col("rewritten_from")}).select(F.col("row_id").alias("ioc_id"), "pos", "value")
    single = rows.where(F.trim("rewritten_from") != "").join(packed.select("ioc_id").distinct(), "ioc_id", "left_anti")
    bare = F.regexp_replace("rewritten_from", r"""^[\s"'<]+|[\s"'>]+$""", "")
    every = packed.unionByName(single.select("ioc_id", F.lit(1).alias("pos"), bare.alias("value")))
    return rewriters.unwrap(every, "value").select("ioc_id", "pos", "unwrapped", F.array_join("chain", ">").alias("chain"))


@query(r"""select ident_id, case when instr(inner_, '@') > 0 then regexp_replace(split_part(inner_, '@', -1), '^>+|>+$', '', 'g') else '' end as domain from (
 select ident_id, case when regexp_matches(low, '(?s)<.*>') then split_part(split_part(substr(low, instr(low, '<') + 1), '>', 1), '<', -1) else low end as inner_ from (select ident_id, lower(trim(from_header)) as low from mail_identity where from_header is not null))""")
def sender_domains(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mail_identity").where("from_header is not null").select("ident_id", tx.sender_domain(F.col("from_header")).alias("domain"))


_SUBJECT = rf"substr(regexp_replace(lower(trim(regexp_replace(trim(subject), '(?i)^(?:\s*(?:{tx.GATEWAY_TAG}|{tx.REPLY_TAG})){{0,6}}', ''))), '\s+', ' ', 'g'), 1, 80)"


@query(f"select ident_id, {_SUBJECT} as subject_key from mail_identity where subject is not null")
def subject_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mail_identity").where("subject is not null").select("ident_id", tx.campaign_subject(F.col("subject")).alias("subject_key"))


@query("""select ident_id, return_path is not null and (a = b or ends_with(a, '.' || b) or ends_with(b, '.' || a)) and a <> '' and b <> '' as same from (
 select ident_id, return_path, regexp_extract(lower(from_header), '@([^@>\\s()]+)', 1) as a, regexp_extract(lower(return_path), '@([^@>\\s()]+)', 1) as b from mail_identity where return_path is not null and from_header is not null)""".replace("\\\\", "\\"))
def return_path_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the return path belongs to the sender's domain."""
    rows = table(spark, folder, "mail_identity").where("return_path is not null and from_header is not null")
    domain = lambda c: F.regexp_extract(F.lower(c), r"@([^@>\s()]+)", 1)
    return rows.select("ident_id", tx.related(domain(F.col("from_header")), domain(F.col("return_path"))).alias("same"))


# --- merging, filtering, ranking --------------------------------------------------------------

_PRIO = "(case when coalesce(list_contains({t}, 'from_url'), false) and not coalesce(list_contains({t}, 'url_rewriter'), false) then 20 else 0 end + case when coalesce(list_contains({t}, 'unwrapped'), false) then 50 else 0 end + case when coalesce(list_contains({t}, 'url_rewriter'), false) then -30 else 0 end + case when coalesce(list_contains({t}, 'allowlisted'), false) then -10 else 0 end + case when coalesce(list_contains({t}, 'private'), false) then -5 else 0 end)"
_P = _PRIO.format(t="tags")


@query(rf"""with {_DUCK_URL.replace("where value ilike '%://%'", "where ioc_type = 'url' and value is not null")},
k as (select ioc_id, lower(case when scheme = '' then 'http' else scheme end) || '://' || regexp_replace(host, '^www\.', '') || case when regexp_matches(port, '^0*$') then '' else ':' || regexp_replace(port, '^0+', '') end
  || case when path = '/' then path else regexp_replace(path, '/+$', '') end || case when query = '?' then '' else query end as url_key from u),
r as (select msg_id, ioc_type, value, tags, ioc_id, coalesce(url_key, lower(value)) as key, {_P} as p from ioc left join k using (ioc_id) where value is not null and ioc_type is not null),
t as (select msg_id, ioc_type, key, tag, min((-p, ioc_id)) as first from (select msg_id, ioc_type, key, p, ioc_id, unnest(tags) as tag from r) group by all),
u2 as (select msg_id, ioc_type, key, count(*) as tags from t group by all)
select r.msg_id, r.ioc_type, r.key, arg_min(r.value, (-r.p, r.ioc_id)) as value, count(*) as copies, coalesce(any_value(u2.tags), 0) as tags from r left join u2 using (msg_id, ioc_type, key) group by all""")
def ioc_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators of a message, merged by value, URLs by their comparable form."""
    out = indicators.merged(table(spark, folder, "ioc").where("ioc_type is not null"), "msg_id", "ioc_id")
    return out.select("msg_id", "ioc_type", "key", "value", F.col("copies").cast("long").alias("copies"), F.size(F.filter("tags", lambda x: x.isNotNull())).cast("long").alias("tags"))


@query(f"select ioc_id, {_P} as priority, case when coalesce(list_contains(tags, 'unwrapped'), false) then 0 when ioc_type in ('md5', 'sha1', 'sha256') or coalesce(list_contains(tags, 'attachment_hash'), false) then 1 else 2 end as tier from ioc")
def ioc_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ioc").select("ioc_id", indicators.priority().alias("priority"), indicators.tier().alias("tier"))


_HAS = "coalesce(list_contains(tags, '{}'), false)"


@query(f"""select ioc_id from ioc where not {_HAS.format('private')} and not ({_HAS.format('url_rewriter')} or {_HAS.format('noise_candidate')}) and not {_HAS.format('allowlisted')}
  and (ioc_type <> 'filename' or coalesce(list_has_any(tags, ['double_extension', 'dangerous_extension', 'archive_dangerous_member', 'nested_email', 'qr']), false))""")
def ioc_actionable(spark: SparkSession, folder: str) -> DataFrame:
    return indicators.filtered(table(spark, folder, "ioc"), actionable=True).select("ioc_id")


@query("""select ioc_id from ioc where ioc_type in ('url', 'domain') and contains(lower(value) || ' ' || ioc_type || ' ' || lower(coalesce(array_to_string(tags, ' '), '')) || ' ' || lower(coalesce(context, '')), 'login')""")
def ioc_search(spark: SparkSession, folder: str) -> DataFrame:
    return indicators.filtered(table(spark, folder, "ioc"), types=["url", "domain"], search="login").select("ioc_id")


@query(f"""with r as (select msg_id, ioc_type || ':' || value as s, min((case when {_HAS.format('allowlisted')} or {_HAS.format('url_rewriter')} or {_HAS.format('private')} then 1 else 0 end, -{_P}, ioc_id)) as b from ioc where value is not null and ioc_type is not null group by all),
k as (select msg_id, s, row_number() over (partition by msg_id order by b) as n from r)
select msg_id, string_agg(s, ' || ' order by n) as top from k where n <= 5 group by 1""")
def ioc_top(spark: SparkSession, folder: str) -> DataFrame:
    """The five strongest indicators of each message."""
    out = indicators.top_strings(table(spark, folder, "ioc").where("ioc_type is not null"), "msg_id", "ioc_id")
    return out.select("msg_id", F.array_join("top", " || ").alias("top"))


@query("""with a(domain) as (values ('example.net'), ('lumoraline.example'), ('test')), h as (select ioc_id, lower(host) as host from ioc where host is not null)
select ioc_id, exists(select 1 from a where host = domain or ends_with(host, '.' || domain)) as allowlisted from h""")
def ioc_allowlisted(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators whose host is on, or under, an allowlisted domain."""
    allow = spark.createDataFrame([("example.net",), ("lumoraline.example",), ("test",)], "domain string")
    return indicators.allowlisted(table(spark, folder, "ioc").where("host is not null").select("ioc_id", "host"), "host", allow).select("ioc_id", "allowlisted")


@query(f"""with real as (select distinct msg_id from ioc where ioc_type = 'domain' and ({_HAS.format('unwrapped')} or {_HAS.format('from_url')}))
select ioc_id from ioc where ioc_type = 'domain' and {_HAS.format('url_rewriter')} and msg_id in (select msg_id from real)""")
def ioc_noise(spark: SparkSession, folder: str) -> DataFrame:
    """Rewriter domains next to a domain that was unwrapped."""
    rows = indicators.noise_marked(table(spark, folder, "ioc").select("ioc_id", "msg_id", "ioc_type", "tags"), "msg_id")
    return rows.where(indicators.has("noise_candidate") & indicators.has("url_rewriter") & (F.col("ioc_type") == "domain")).select("ioc_id")


# --- look-alikes ------------------------------------------------------------------------------


def _fold(c: str) -> str:
    quoted = lambda x: x.replace("'", "''")
    return f"translate(lower(translate({c}, '{quoted(lookalikes.STYLED_FROM)}', '{quoted(lookalikes.STYLED_TO)}')), '{lookalikes.FOLD_FROM}', '{lookalikes.FOLD_TO}')"


_REG = "case when len(l) >= 3 and array_to_string(l[-2:], '.') in ('co.uk', 'com.br', 'com.au', 'com.tr') then array_to_string(l[-3:], '.') when len(l) >= 2 then array_to_string(l[-2:], '.') else lower(trim(host)) end"
_VENDOR = ", ".join(f"'{v}'" for v in lookalikes.VENDOR_NAMES)


@query(f"""with b as (select domain as brand, array_to_string(string_split(domain, '.')[-2:], '.') as breg, string_split(domain, '.')[-2] as label from brand),
h as (select distinct host, list_filter(string_split(lower(trim(host)), '.'), lambda x: trim(x) <> '') as l from (select lower(regexp_replace(value, '^\\.+|\\.+$', '', 'g')) as host from lookalike_hit where value is not null) where contains(host, '.')),
r as (select host, {_REG} as reg from h), n as (select host, reg, {_fold('reg')} as norm from r),
f as (select host, reg, norm, split_part(reg, '.', 1) as seen, split_part(norm, '.', 1) as nlabel, case when contains(norm, '.') then substr(norm, instr(norm, '.') + 1) else '' end as zone, brand, breg, label, split_part(breg, '.', -1) as bzone from n, b where reg <> breg),
d as (select *, zone <> '' and zone <> bzone as foreign_, case when zone <> '' and zone <> bzone then nlabel else norm end as l, case when zone <> '' and zone <> bzone then label else breg end as r from f),
e as (select * replace (regexp_replace(l, '[^\\x00-\\x7F]', '?', 'g') as l) from d),
k as (select host, brand, levenshtein(l, r) as d, case when norm = breg or (foreign_ and nlabel = label and seen <> label) then 'homoglyph'
  when length(label) >= 5 and contains(replace(norm, '-', ''), label) and not contains(reg, breg) and contains(norm, label) and not ends_with(reg, breg) then
    case when not (seen in ({_VENDOR}) or reg in ('yandex.net', 'office.net', 'github.io') or seen = label) then 'brand_spoof' end
  when levenshtein(l, r) between 1 and 2 and abs(length(l) - length(r)) <= 2 then 'levenshtein' end as kind from e)
select host, brand, kind, cast(case when kind = 'levenshtein' then d else 0 end as integer) as distance from k where kind is not null
union all select host, '', 'idn', 0 from h where regexp_matches(host, '[^\\x00-\\x7F]|(?:^|\\.)xn--')""".replace("\\\\", "\\"))
def lookalike_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts that resemble one of the brands as they are written."""
    brands = [r["domain"] for r in table(spark, folder, "brand").orderBy("ord").collect()]  # a fixed table of 20 rows
    return lookalikes.brand_hits(table(spark, folder, "lookalike_hit").select("value"), "value", brands, decode=False).fillna(0, ["distance"])


@query()
def lookalike_hosts_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Hosts that resemble one of the brands by the letters that Punycode stands for."""
    brands = [r["domain"] for r in table(spark, folder, "brand").orderBy("ord").collect()]  # a fixed table of 20 rows
    return lookalikes.brand_hits(table(spark, folder, "lookalike_hit").select("value").unionByName(table(spark, folder, "ioc").select(F.col("host").alias("value"))), "value", brands).fillna(0, ["distance"])


@query()
def display_spoofs(spark: SparkSession, folder: str) -> DataFrame:
    """Display names, of the table and of samples, that hold a brand's name, from another address."""
    brands = [r["domain"] for r in table(spark, folder, "brand").orderBy("ord").collect()]  # a fixed table of 20 rows
    samples = spark.createDataFrame([(-1, "Nordabanko Support <x@evil.example>"), (-2, "Nordabanko <x@nordabanko.example>"), (-3, '"Velmarapay Docs" <x@evil.example>')], "ident_id long, from_header string")
    senders = table(spark, folder, "mail_identity").select("ident_id", "from_header").unionByName(samples)
    return lookalikes.display_spoofs(senders, "ident_id", "from_header", lookalikes.names_of(brands))


@query("select brand, kind, count(*) as n, count(distinct msg_id) as mails from lookalike_hit group by all")
def lookalike_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lookalike_hit").groupBy("brand", "kind").agg(F.count("*").alias("n"), F.count_distinct("msg_id").alias("mails"))


# --- campaigns, batches, differences ----------------------------------------------------------

_ROOT = r"coalesce(nullif(lower(regexp_replace(regexp_extract(trim(references_hdr), '^(\S+)', 1), '^[<>]+|[<>]+$', '', 'g')), ''), nullif(lower(regexp_replace(regexp_extract(trim(in_reply_to), '^(\S+)', 1), '^[<>]+|[<>]+$', '', 'g')), ''))"
_KEY = f"coalesce('thread:' || {_ROOT}, 'subj:' || nullif({_SUBJECT}, ''), '')"


@query(f"select ident_id, {_KEY} as campaign_key from mail_identity")
def campaign_keys(spark: SparkSession, folder: str) -> DataFrame:
    key = campaigns.campaign_key(F.col("references_hdr"), F.col("in_reply_to"), F.col("subject"))
    return table(spark, folder, "mail_identity").select("ident_id", key.alias("campaign_key"))


@query(f"""with k as (select {_KEY} as key, ident_id, case when instr(inner_, '@') > 0 then regexp_replace(split_part(inner_, '@', -1), '^>+|>+$', '', 'g') else '' end as d from (
  select *, case when regexp_matches(low, '(?s)<.*>') then split_part(split_part(substr(low, instr(low, '<') + 1), '>', 1), '<', -1) else low end as inner_ from (select *, lower(trim(from_header)) as low from mail_identity)))
select key, count(distinct d) as domains from k where key <> '' and d <> '' group by 1 having count(distinct d) >= 2""")
def campaigns_diverging(spark: SparkSession, folder: str) -> DataFrame:
    """Campaigns with several sender domains."""
    key = campaigns.campaign_key(F.col("references_hdr"), F.col("in_reply_to"), F.col("subject"))
    return campaigns.divergent(table(spark, folder, "mail_identity").select(key.alias("key"), "from_header"), "key", "from_header")




@query("""with t as (select coalesce(nullif(campaign_key, ''), split_part(replace(path, chr(92), '/'), '/', -1)) as key, coalesce(verdict_level, '') as l, coalesce(verdict_score, 0) as s from triage),
c as (select key, l, count(*) as n, max(s) as m from t group by all)
select key, cast(sum(n) as bigint) as file_count, coalesce(string_agg(l || '=' || n, '|' order by l || '=' || n) filter (l <> ''), '') as levels, max(m) as max_score from c group by 1""")
def campaign_summaries(spark: SparkSession, folder: str) -> DataFrame:
    key = F.coalesce(F.nullif("campaign_key", F.lit("")), F.substring_index(F.translate("path", "\\", "/"), "/", -1))
    return campaigns.summaries(table(spark, folder, "triage").select(key.alias("key"), "verdict_level", "verdict_score"), "key")


@query("""with m as (select distinct campaign_key as key, msg_id from triage where campaign_key <> ''), l as (select distinct msg_id, ioc_type || ': ' || value as label from ioc where value is not null),
s as (select key, count(distinct msg_id) as size from m group by 1), c as (select m.key, label, count(*) as n from m join l using (msg_id) group by all),
j as (select c.*, s.size, max(case when n = size then 1 else 0 end) over (partition by c.key) as every from c join s using (key)),
k as (select key, label, row_number() over (partition by key order by label) as r from j where case when every = 1 then n = size else size > 1 and n >= 2 end)
select key, string_agg(label, '|' order by label) as shared from k where r <= 40 group by 1""")
def campaign_shared(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators that the messages of a campaign share."""
    messages = table(spark, folder, "triage").where("campaign_key <> ''").select(F.col("campaign_key").alias("key"), "msg_id")
    return campaigns.shared_indicators(messages, table(spark, folder, "ioc").select("msg_id", "ioc_type", "value"), "key")


@query("""with a as (select distinct ioc_type, lower(value) as v from ioc where source = 'text' and value is not null), b as (select distinct ioc_type, lower(value) as v from ioc where source = 'attachment' and value is not null)
select coalesce(a.ioc_type, b.ioc_type) as ioc_type, coalesce(a.v, b.v) as v, case when b.v is null then 'left' when a.v is null then 'right' else 'shared' end as side from a full outer join b on a.ioc_type = b.ioc_type and a.v = b.v""")
def ioc_text_against_attachment(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators found only in texts, only in attachments, or in both."""
    rows = table(spark, folder, "ioc").where("value is not null").select("ioc_type", F.lower("value").alias("v"), "source")
    return campaigns.difference(rows.where("source = 'text'"), rows.where("source = 'attachment'"), ["ioc_type", "v"])


@query("select coalesce(lower(trim(segment)), '') as segment, coalesce(lower(trim(observed_level)), '') as level, count(*) as events from feedback group by 1, 2")
def feedback_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """How many events of each segment got which level."""
    return scoring.calibration(table(spark, folder, "feedback"), "segment", "observed_level")


@query("select path as file, kind, coalesce(verdict_level, '') as verdict, coalesce(cast(verdict_score as varchar), '') as score, ioc_count, coalesce(subject, '') as subject, coalesce(sender, '') as sender, coalesce(message_id, '') as message_id, case when len(coalesce(top_iocs, [])) <= 8 then array_to_string(coalesce(top_iocs, []), '|') else array_to_string(top_iocs[1:8], '|') || '|+' || (len(top_iocs) - 8) end as top_iocs, coalesce(top_reason, '') as top_reason, case when len(coalesce(errors, [])) <= 5 then array_to_string(coalesce(errors, []), '|') else array_to_string(errors[1:5], '|') || '|+' || (len(errors) - 5) end as errors from triage")
def batch_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row a message for a batch report."""
    return exports.batch_rows(table(spark, folder, "triage"))


# --- scores and feedback ----------------------------------------------------------------------

_CONTRIB = "select msg_id, source as category, ioc_id, cast(ioc_id * 7 % 23 as integer) + 1 as points from ioc where source is not null"


@query(f"""with c as ({_CONTRIB}), w as (select *, sum(points) over (partition by msg_id, category) as t, count(*) over (partition by msg_id, category) as n, row_number() over (partition by msg_id, category order by ioc_id) as k from c),
e as (select *, case when t > 40 then greatest(cast(round_even(points * 40.0 / t, 0) as integer), 0) end as each_ from w)
select ioc_id, cast(case when t <= 40 then points when k = n then 40 - coalesce(sum(each_) over (partition by msg_id, category order by ioc_id rows between unbounded preceding and 1 preceding), 0) else each_ end as integer) as capped_points from e""")
def score_capped(spark: SparkSession, folder: str) -> DataFrame:
    """Points by message and category under a cap of 40."""
    return scoring.capped(_contributions(spark, folder), ["msg_id", "category"], "ioc_id", "points", 40).select("ioc_id", "capped_points")


def _contributions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ioc").where("source is not null").select("msg_id", F.col("source").alias("category"), "ioc_id", ((F.col("ioc_id") * 7 % 23).cast("int") + 1).alias("points"))


@query(f"""with c as (select msg_id, ioc_id, case when ioc_id % 3 = 0 then -points else points end as points from ({_CONTRIB})),
s as (select msg_id, sum(points) as s, sum(greatest(points, 0)) as risk, sum(greatest(-points, 0)) as mit from c group by 1), l as (select *, cast(greatest(0, least(100, s)) as integer) as score from s),
v as (select *, case when score >= 60 then 'malicious' when score >= 30 then 'suspicious' when score >= 10 then 'unknown' else 'benign' end as level, least(abs(score - 10), abs(score - 30), abs(score - 60)) as d from l)
select msg_id, score, level, case when d <= 5 or (risk > 0 and mit > 0 and abs(risk - mit) <= 8) then 'low' when d >= 12 and (risk >= 20 or level in ('benign', 'malicious')) then 'high' else 'medium' end as confidence from v""")
def score_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Scores, levels and how settled they are."""
    rows = _contributions(spark, folder).withColumn("points", F.when(F.col("ioc_id") % 3 == 0, -F.col("points")).otherwise(F.col("points")))
    return scoring.verdicts(rows, "msg_id", "points")


@query("select coalesce(kind, '') as kind, count(*) as n, count(distinct source_sha256) as files from feedback group by 1")
def feedback_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "feedback").groupBy(F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("source_sha256").alias("files"))


_WEIGHTS = (("qr_lure", "weight_qr_lure"), ("qr_lure", "weight_qr_credential"), ("qr_lure", "weight_qr_present"), ("display_spoof", "weight_display_spoof"), ("display_spoof", "weight_lookalike"), ("display_spoof", "weight_spf_lookalike"), ("bec", "weight_bec_payment"), ("shortener", "weight_url_shortener"), ("cloud_lure", "weight_cloud_lure"), ("messenger", "weight_messenger_only"), ("messenger", "weight_messenger_lure"))
_WEIGHTS = ", ".join(f"('{a}', '{b}')" for a, weights in scoring.SEGMENT_WEIGHTS.items() for b in weights)


@query(f"""with w(segment, weight_key) as (values {_WEIGHTS}), d as (select weight_key, sum(case when lower(kind) = 'fn' then 2 else -2 end) as d from feedback f join w on lower(trim(f.segment)) = w.segment where lower(kind) in ('fp', 'fn') group by 1)
select weight_key, cast(greatest(-10, least(10, d)) as integer) as delta from d where d <> 0""")
def feedback_weights(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.weight_changes(table(spark, folder, "feedback"), scoring.segment_weights(spark))


@query("""with c as (select count(*) filter (lower(kind) = 'fp') as fp, count(*) filter (lower(kind) = 'fn') as fn, count(*) filter (lower(kind) = 'confirm') as ok,
  count(*) filter (lower(kind) = 'fp' and lower(trim(segment)) = 'display_spoof') as spoof, count(*) filter (lower(kind) = 'fp' and lower(trim(segment)) in ('safelinks', 'rewrite')) as links from feedback),
r as (select *, fp / greatest(1, fp + fn) as rate from c where fp + fn + ok >= 3 and fp + fn > 0),
h as (select *, rate >= 0.55 and fp >= 2 as hp, rate >= 0.35 and rate < 0.55 and fp >= 2 as sp, 1 - rate >= 0.55 and fn >= 2 as hn, 1 - rate >= 0.35 and 1 - rate < 0.55 and fn >= 2 as sn from r),
s as (select *, case when hp then 35 when sp then 33 end as sus, case when hp then 24 when sp then 26 end as disp, case when hp then 26 end as look from h)
select setting, cast(value as integer) as value from (
 select 'threshold_suspicious' as setting, case when hn then greatest(18, coalesce(sus, 30) - 5) when sn then greatest(22, coalesce(sus, 30) - 3) else sus end as value from s
 union all select 'threshold_malicious', case when hn then greatest(45, case when hp then 65 else 60 end - 5) when hp then 65 end from s
 union all select 'cap_headers', case when hp then 40 end from s
 union all select 'cap_lookalike', case when spoof >= 2 then least(coalesce(look, 30), 24) else look end from s
 union all select 'cap_display_spoof', case when spoof >= 2 then least(coalesce(disp, 28), 22) else disp end from s
 union all select 'cap_content', case when hn then 45 end from s
 union all select 'cap_urls', case when links >= 2 then 22 end from s) where value is not null""")
def feedback_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.threshold_changes(table(spark, folder, "feedback"))


@query("select count(*) as events, count(*) filter (expected_level = observed_level) as \"right\", round(avg(abs(score - case expected_level when 'benign' then 5 when 'unknown' then 20 when 'suspicious' then 45 when 'malicious' then 80 end)), 6) as mean_deviation from feedback")
def feedback_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.accuracy(table(spark, folder, "feedback"), "expected_level", "observed_level", "score", {"benign": 5.0, "unknown": 20.0, "suspicious": 45.0, "malicious": 80.0})


# --- exports and files ------------------------------------------------------------------------


@query("""select t.msg_id, coalesce(i.ioc_type, '') as ioc_type, coalesce(i.value, '') as value, coalesce(i.source, '') as source, coalesce(i.context, '') as context, coalesce(i.rewritten_from, '') as rewritten_from, coalesce(array_to_string(i.tags, '|'), '') as tags, t.triage_id, t.verdict_level, t.verdict_score
from triage t left join ioc i using (msg_id)""")
def export_flat(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators with their message's verdict; messages without any keep an empty row."""
    return exports.flat(table(spark, folder, "triage").select("msg_id", "triage_id", "verdict_level", "verdict_score"), table(spark, folder, "ioc"))


def _duck_cef(c: str) -> str:
    return f"replace(replace(replace(replace(coalesce({c}, ''), chr(92), chr(92) || chr(92)), '=', chr(92) || '='), chr(10), ' '), chr(13), ' ')"


@query(f"""select ioc_id, 'CEF:0|{exports.VENDOR}|{exports.PRODUCT}|1.0|ioc|' || {_duck_cef('ioc_type')} || '|3|' || case when ioc_type = 'url' then 'request=' when ioc_type in ('ipv4', 'ipv6', 'ip_port') then 'src=' when ioc_type = 'domain' then 'dhost=' when ioc_type in ('md5', 'sha1', 'sha256') then 'fileHash=' else 'cs5=' end
 || {_duck_cef('value')} || case when ioc_type in ('url', 'ipv4', 'ipv6', 'ip_port', 'domain', 'md5', 'sha1', 'sha256') then ' ' else ' cs5Label=Value ' end || 'cs3=' || {_duck_cef('ioc_type')} || ' cs3Label=IocType cs4=' || {_duck_cef("array_to_string(coalesce(tags, []), '|')")} || ' cs4Label=Tags' as line from ioc where ioc_type is not null""")
def export_cef(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ioc").where("ioc_type is not null")
    return rows.select("ioc_id", exports.cef_indicator(F.col("ioc_type"), F.col("value"), F.col("tags"), F.lit("unknown")).alias("line"))


@query("""select ioc_id, '[' || case ioc_type when 'url' then 'url:value' when 'domain' then 'domain-name:value' when 'ipv4' then 'ipv4-addr:value' when 'ipv6' then 'ipv6-addr:value' when 'email' then 'email-addr:value' when 'md5' then 'file:hashes.MD5' when 'sha1' then 'file:hashes.''SHA-1''' when 'sha256' then 'file:hashes.''SHA-256''' end
 || ' = ''' || replace(replace(value, chr(92), chr(92) || chr(92)), '''', chr(92) || '''') || ''']' as pattern from ioc where ioc_type in ('url', 'domain', 'ipv4', 'ipv6', 'email', 'md5', 'sha1', 'sha256')""")
def export_stix(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ioc").where(F.col("ioc_type").isin(*exports.STIX_PATHS))
    return rows.select("ioc_id", exports.stix_pattern(F.col("ioc_type"), F.col("value")).alias("pattern"))


@query("""select ioc_id, case when ioc_type in ('md5', 'sha1', 'sha256', 'filename', 'email') then 'Payload delivery' else 'Network activity' end as category,
 case ioc_type when 'ipv4' then 'ip-dst' when 'ipv6' then 'ip-dst' when 'email' then 'email-src' else ioc_type end as type, value, array_to_string(coalesce(tags, [])[1:6], '|') as comment, '1' as to_ids
from ioc where ioc_type in ('url', 'domain', 'ipv4', 'ipv6', 'email', 'md5', 'sha1', 'sha256', 'filename')""")
def export_misp(spark: SparkSession, folder: str) -> DataFrame:
    return exports.misp_rows(table(spark, folder, "ioc"))


_ECS = "case when ioc_type {} then value end"


@query(f"""select ioc_id, ioc_type as type, coalesce(context, '') as description, {_ECS.format("= 'url'")} as url, {_ECS.format("= 'domain'")} as dns, {_ECS.format("in ('ipv4', 'ipv6', 'ip_port')")} as ip, {_ECS.format("= 'email'")} as email,
 {_ECS.format("in ('md5', 'sha1', 'sha256')")} as hash, {_ECS.format("not in ('url', 'domain', 'ipv4', 'ipv6', 'ip_port', 'md5', 'sha1', 'sha256', 'email')")} as name, array_to_string(coalesce(tags, []), '|') as tags,
 case ioc_type when 'url' then 'Url' when 'domain' then 'Domain-Name' when 'ipv4' then 'IPv4-Addr' when 'ipv6' then 'IPv6-Addr' when 'md5' then 'StixFile' when 'sha1' then 'StixFile' when 'sha256' then 'StixFile' when 'email' then 'Email-Addr' else 'Text' end as entity_type
from ioc where ioc_type is not null""")
def export_ecs(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators as JSON of the Elastic schema, read again field by field."""
    rows = table(spark, folder, "ioc").where("ioc_type is not null")
    written = rows.select("ioc_id", exports.ecs_indicator(F.col("ioc_type"), F.col("value"), F.col("tags"), F.col("context")).alias("j"), exports.opencti_type(F.col("ioc_type")).alias("entity_type"))
    schema = "indicator struct<type:string,description:string,name:string>, tags array<string>, url struct<full:string>, dns struct<question:struct<name:string>>, ip string, hash map<string,string>, email struct<address:string>"
    j = written.withColumn("j", F.from_json("j", schema))
    return j.select("ioc_id", "j.indicator.type", "j.indicator.description", F.col("j.url.full").alias("url"), F.col("j.dns.question.name").alias("dns"), "j.ip", F.col("j.email.address").alias("email"), F.get(F.map_values("j.hash"), F.lit(0)).alias("hash"), F.col("j.indicator.name").alias("name"), F.array_join("j.tags", "|").alias("tags"), "entity_type")


@query("""with p as (select msg_id, cast(floor((coalesce(ord, 1) - 1) / 1000) as integer) as part_no, count(*) as iocs, sum(length(coalesce(value, ''))) as chars from ioc group by all)
select t.msg_id, t.triage_id, coalesce(p.part_no, 0) as part_no, t.path, t.verdict_level as level, coalesce(p.iocs, 0) as iocs, cast(coalesce(p.chars, 0) as bigint) as chars from triage t left join p using (msg_id)""")
def export_reports(spark: SparkSession, folder: str) -> DataFrame:
    """JSON reports of messages with their indicators, read again."""
    messages = table(spark, folder, "triage").select("msg_id", "triage_id", "path", "verdict_level", "verdict_score", "subject", "sender")
    reports = exports.report_json(messages, table(spark, folder, "ioc"))
    j = reports.withColumn("j", F.from_json("report", "triage_id long, path string, verdict_level string, iocs array<struct<value:string>>"))
    chars = F.aggregate("j.iocs", F.lit(0).cast("long"), lambda a, x: a + F.length(F.coalesce(x["value"], F.lit(""))))
    return j.select("msg_id", "j.triage_id", "part_no", "j.path", F.col("j.verdict_level").alias("level"), F.size("j.iocs").cast("long").alias("iocs"), chars.alias("chars"))


@query(r"""select 'm' || m.mail_id as path, sha256(coalesce(m.text, '')) as text_sha256, length(coalesce(m.text, '')) as chars, coalesce(trim(regexp_replace(i.message_id, '\s*[\r\n]+\s*', ' ', 'g'), ' '), '') as message_id,
 coalesce(regexp_replace(regexp_replace(m.subject, '\s*[\r\n]+\s*', ' ', 'g'), '^[ \t]+|[ \t]+$', '', 'g'), '') as subject from mail m join mail_identity i on m.mail_id = i.ident_id""")
def files_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Messages written as files, their headers encoded as they are, and parsed again."""
    mail = table(spark, folder, "mail").select(F.col("mail_id").alias("id"), "text", "recipients", "sender", "subject")
    head = table(spark, folder, "mail_identity").select(F.col("ident_id").alias("id"), "message_id", "in_reply_to", F.col("date_hdr").alias("date"))
    rows = mail.join(head, "id").withColumn("path", F.concat(F.lit("m"), F.col("id").cast("string"), F.lit(".eml")))
    parsed = mail_source.parse_files(mail_source.composed(rows))
    return parsed.select(F.regexp_replace("path", r"\.eml$", "").alias("path"), F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("chars"), F.coalesce(F.trim(mail_source.header("Message-ID")), F.lit("")).alias("message_id"), F.coalesce(mail_source.header("Subject"), F.lit("")).alias("subject"))


@query(r"""select mail_id, len(list_filter(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1), lambda x: x <> '')) as links,
 regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style|head|title)[^>]*>.*?</(?:script|style|head|title)\s*>', '', 'g'), '<[^>]*>', '', 'g'), '[^A-Za-z0-9]', '', 'g') as letters from mail where html is not null and html <> ''""")
def html_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links of each HTML body and the ASCII letters of what it shows."""
    rows = mail_source.pages(table(spark, folder, "mail").where("html is not null and html <> ''"), "mail_id", "html")
    return rows.select("mail_id", F.size("links").cast("long").alias("links"), F.regexp_replace("visible", "[^A-Za-z0-9]", "").alias("letters"))


# --- signals and headers ----------------------------------------------------------------------

#: Messages of our own with the wording and markup of each signal, beside the tables.
SAMPLES = (
    ("Please verify your account now, your password will expire. Enter your password here: https://bit.ly/x1", None),
    ("Password policy: see the handbook. Account numbers did not change.", None),
    ("Срочно оплатите счёт. Изменились реквизиты: новый счёт BY20OLMP31350000001000000933 для оплаты.", None),
    ("We have changed our bank details. New bank account 4111 1111 1111 1111, wire transfer of funds today.", None),
    ("Do not reply to this mail, call me back at once.", None),
    ("Press Win + R and run powershell -enc aGVsbG8=", None),
    ("The archive is password protected, password: 1234. Пароль от архива: 77", None),
    ("The password is sent via Telegram. Скачайте файл в телеграм", "<p>Scan the QR code</p><img src='cid:1'>"),
    ("Write to me in WhatsApp: telegram @some_name", "<form action=x><input type=password></form>"),
    ("Download the document from Google Drive https://drive.google.com/file/d/1", "<a href='https://evil.example/x'>bank.example.com</a>"),
    ("https://user.name@host.example/x and file://server/x\nAuthentication-Results: mx; spf=pass", "<div style='display: none'>hidden</div>"),
    (None, "<img src='cid:logo'><a href='https://shop.example/a'>x</a>"), (None, "<img src='https://img.example/a.png'>"), ("https://t.me/some_chat", None), (None, None),
)
_SQL_SIGNALS = [*(k for k, _, _ in signal_rules.RULES), "payment_tokens", "messenger_only", "cid_phishing", "image_only_body"]


def _sql_text(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


def _signal_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    squeeze = lambda c: f"regexp_replace(lower({c}), '[ \\t\\x0B\\f\\r\\x{{A0}}]+', ' ', 'g')".replace("\\\\", "\\")
    shown = "page"
    for tag in ("script", "style", "head", "title"):
        shown = f"regexp_replace({shown}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', ' ', 'g')"
    shown = f"regexp_replace(regexp_replace({shown}, '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(?:br|/?p|/?div|/?tr|/?li|/?h[1-3])(?:\\s[^>]*)?/?>', chr(10), 'g')"
    shown = f"regexp_replace({shown}, '<[^>]*>', ' ', 'g')".replace("\\\\", "\\")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        shown = f"replace({shown}, '{entity}', '{char}')"
    where = {"text": "seen", "raw": "raw", "html": "source"}
    tests = {k: " and ".join(f"regexp_matches({where[w]}, '{quoted(p)}')" for p in patterns) for k, w, patterns in signal_rules.RULES}
    chats = ", ".join(f"'{h}'" for h in (*signal_rules.MESSENGERS, *signal_rules.SHORTENERS))
    tests["payment_tokens"] = f"({tests['payment_change']}) and (regexp_matches(plain, '{signal_rules.IBAN}') or regexp_matches(plain, '{signal_rules.CARD}'))"
    tests["messenger_only"] = f"({tests['messenger_link']}) and len(list_filter(links, lambda x: x not in ({chats}))) = 0"
    tests["cid_phishing"] = f"({tests['cid_image']}) and len(links) > 0 and letters <= 40"
    tests["image_only_body"] = f"regexp_matches(source, '<img[\\s/]') and not ({tests['cid_phishing']}) and trim(txt, ' ') = '' and letters <= 40".replace("\\\\", "\\")
    samples = ", ".join(f"('sample {i}', {_sql_text(t)}, {_sql_text(h)})" for i, (t, h) in enumerate(SAMPLES))
    return f"""with m as (select 'mail ' || mail_id as id, text, html from mail union all select 'documents ' || doc_id, text, null from documents union all select * from (values {samples})),
a as (select id, coalesce(text, '') as txt, coalesce(html, '') as page from m), b as (select *, case when page = '' then '' else {shown} end as shown from a),
c as (select *, txt || chr(10) || shown as plain, {squeeze("txt || chr(10) || shown")} as seen, {squeeze("page")} as source, {squeeze("txt || chr(10) || page")} as raw, length(regexp_replace(shown, '[^\\p{{L}}]', '', 'g')) as letters from b),
d as (select *, regexp_extract_all(raw, 'https?://(?:www\\.)?([^\\s/:?#"''<>)\\]]+)', 1) as links from c)
""".replace("\\\\", "\\") + " union all ".join(f"select id, '{k}' as kind from d where {t}" for k, t in tests.items())


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    mail = table(spark, folder, "mail").select(F.concat_ws(" ", F.lit("mail"), F.col("mail_id").cast("string")).alias("id"), "text", "html")
    documents = table(spark, folder, "documents").select(F.concat_ws(" ", F.lit("documents"), F.col("doc_id").cast("string")).alias("id"), "text", F.lit(None).cast("string").alias("html"))
    samples = spark.createDataFrame([(f"sample {i}", t, h) for i, (t, h) in enumerate(SAMPLES)], "id string, text string, html string")
    return mail.unionByName(documents).unionByName(samples)


@query(_signal_sql())
def content_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of wording and markup."""
    return signal_rules.signals(_messages(spark, folder), "id", "text", "html", _SQL_SIGNALS)


@query()
def content_signals_all(spark: SparkSession, folder: str) -> DataFrame:
    """All signals, links that lead elsewhere than they say among them."""
    return signal_rules.signals(_messages(spark, folder), "id", "text", "html")


@query(rf"""with d as (select *, coalesce(regexp_extract(lower(from_header), '@([^@>\s()]+)', 1), '') as s, coalesce(regexp_extract(lower(reply_to), '@([^@>\s()]+)', 1), '') as rt, coalesce(regexp_extract(lower(return_path), '@([^@>\s()]+)', 1), '') as rp,
  coalesce(regexp_extract(lower(in_reply_to), '@([^@>\s()]+)', 1), '') as ir, coalesce(regexp_extract(lower(message_id), '@([^@>\s()]+)', 1), '') as mi, coalesce(regexp_extract(lower(references_hdr), '@([^@>\s()]+)', 1), '') as rf,
  regexp_matches(regexp_replace(trim(coalesce(subject, ''), ' '), '(?i)^(?:{tx.GATEWAY_TAG}){{0,6}}', ''), '(?i)^(?:re(?:\[\d+\])?|ответ|отв|на)\s*:') as re from mail_identity),
f as (
 select ident_id, 'reply_to_mismatch' as finding, 'high' as severity from d where rt <> '' and s <> '' and not (s = rt or ends_with(s, '.' || rt) or ends_with(rt, '.' || s))
 union all select ident_id, 'return_path_mismatch', 'medium' from d where rp <> '' and s <> '' and not (s = rp or ends_with(s, '.' || rp) or ends_with(rp, '.' || s))
 union all select ident_id, 'reply_chain_anomaly', 'high' from d where s <> '' and ((ir <> '' and not (s = ir or ends_with(s, '.' || ir) or ends_with(ir, '.' || s))) or (rf <> '' and not (s = rf or ends_with(s, '.' || rf) or ends_with(rf, '.' || s))))
 union all select ident_id, 'message_id_domain', 'low' from d where mi <> '' and s <> '' and not (s = mi or ends_with(s, '.' || mi) or ends_with(mi, '.' || s))
 union all select ident_id, 'orphan_reply', 'high' from d where re and trim(coalesce(in_reply_to, ''), ' ') = '' and trim(coalesce(references_hdr, ''), ' ') = ''
 union all select ident_id, 'no_auth_results', 'low' from d where trim(coalesce(spf, ''), ' ') = '' and trim(coalesce(dkim, ''), ' ') = '' and trim(coalesce(dmarc, ''), ' ') = ''
 union all select ident_id, 'no_received', 'medium' from d where coalesce(received_hops, 0) = 0
 union all select ident_id, 'one_received', 'medium' from d where received_hops = 1
 union all select ident_id, 'spf', case lower(trim(spf)) when 'fail' then 'high' when 'softfail' then 'medium' when 'permerror' then 'medium' when 'temperror' then 'medium' when 'none' then 'low' when 'pass' then 'info' end from d
 union all select ident_id, 'dkim', case lower(trim(dkim)) when 'fail' then 'high' when 'softfail' then 'medium' when 'permerror' then 'medium' when 'temperror' then 'medium' when 'none' then 'low' when 'pass' then 'info' end from d
 union all select ident_id, 'dmarc', case lower(trim(dmarc)) when 'fail' then 'critical' when 'softfail' then 'medium' when 'permerror' then 'medium' when 'temperror' then 'medium' when 'none' then 'low' when 'pass' then 'info' end from d)
select * from f where severity is not null""")
def header_findings(spark: SparkSession, folder: str) -> DataFrame:
    """What the header fields of each message give away."""
    return signal_rules.header_findings(table(spark, folder, "mail_identity"), "ident_id")


# --- streams ----------------------------------------------------------------------------------


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file in the folder or a folder of files."""
    files = table(spark, folder, name)
    reader = spark.readStream.schema(files.schema)
    if all(f.rpartition("/")[0].endswith(f"/{name}.parquet") for f in files.inputFiles()):
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@query("select strftime(ingested_at, '%Y-%m-%d') as day, coalesce(verdict_level, 'none') as level, count(*) as messages from triage where ingested_at is not null group by all")
def stream_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict levels by day, counted by a stream over the triage rows that are there."""
    rows = _stream(spark, folder, "triage")
    place = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    counted = triage.level_counts(rows.where("ingested_at is not null"), "ingested_at")
    query_ = counted.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{place}/out/batch={n}")).trigger(availableNow=True).start()
    query_.awaitTermination()
    seen = spark.read.schema("start timestamp, level string, messages long").parquet(f"{place}/out")
    return seen.groupBy(F.date_format("start", "yyyy-MM-dd").alias("day"), "level").agg(F.max("messages").alias("messages"))


@query()
def stream_diverging(spark: SparkSession, folder: str) -> DataFrame:
    """Campaigns that several sender domains write within a week, by a stream over the triage rows that are there."""
    rows = _stream(spark, folder, "triage").where("ingested_at is not null").withColumn("domain", tx.sender_domain(F.col("sender")))
    place = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    found = triage.diverging(rows.where("domain <> ''"), "ingested_at", "campaign_key", "domain", late="60 days")
    query_ = found.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{place}/out/batch={n}")).trigger(availableNow=True).start()
    query_.awaitTermination()
    seen = spark.read.schema("start timestamp, key string, domains long").parquet(f"{place}/out")
    return seen.groupBy(F.date_format("start", "yyyy-MM-dd").alias("week"), "key").agg(F.max("domains").alias("domains"))


@query("select lower(message_id) as id, count(*) as n from (select distinct lower(trim(message_id)) as message_id from triage where ingested_at is not null and trim(message_id) <> '') group by 1")
def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """Each identifier once, by a stream over the triage rows that are there."""
    rows = _stream(spark, folder, "triage")
    place = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    first = triage.once(rows.where("ingested_at is not null").withColumn("id", F.lower(F.trim("message_id"))).where("id <> ''"), "id", "ingested_at", "60 days")
    query_ = first.select("id").writeStream.outputMode("append").option("checkpointLocation", f"{place}/state").format("parquet").option("path", f"{place}/out").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema("id string").parquet(f"{place}/out").groupBy("id").agg(F.count("*").alias("n"))

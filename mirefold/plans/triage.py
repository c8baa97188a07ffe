"""Queries over batches of messages: views, ranks, peers, look-ups, cards and hand-off formats, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirefold.functions import rewriters
from mirefold.functions import text as tx
from mirefold.operators import batches, headers, indicators, pipeline, signals
from mirefold.plans import reference
from mirefold.session import table, written
from mirefold.sources import config, exports
from mirefold.sources import mail as mail_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HAS = "coalesce(list_contains(tags, '{}'), false)"
_TIER = f"case when {_HAS.format('unwrapped')} then 0 when ioc_type in ('md5', 'sha1', 'sha256') or {_HAS.format('attachment_hash')} then 1 else 2 end"
_NOISE = f"({_HAS.format('url_rewriter')} or {_HAS.format('noise_candidate')})"
_PATH = "lower(replace({}, chr(92), '/'))"


@query(f"select ioc_id, row_number() over (partition by msg_id order by {_TIER} nulls first, ioc_type nulls first, lower(value) nulls first, ioc_id) as rank from ioc")
def ioc_display_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each indicator in its message's list."""
    return batches.display_order(table(spark, folder, "ioc").select("ioc_id", "msg_id", "ioc_type", "value", "tags"), "msg_id", "ioc_id").select("ioc_id", "rank")


@query(f"select msg_id, count(*) as total, count(*) filter ({_HAS.format('private')}) as private, count(*) filter {_NOISE} as rewriter, count(*) filter ({_HAS.format('allowlisted')}) as allowlisted, count(*) filter (not {_HAS.format('private')} and not {_NOISE} and not {_HAS.format('allowlisted')}) as shown from ioc group by 1")
def ioc_hidden(spark: SparkSession, folder: str) -> DataFrame:
    """How many indicators of each message each filter hides."""
    return batches.hidden_counts(table(spark, folder, "ioc"), "msg_id")


_TYPES = ", ".join(f"'{t}'" for t in batches.selected_types())


@query(f"select ioc_id, ioc_type from ioc where ioc_type in ({_TYPES}) and not {_HAS.format('private')}")
def ioc_default_view(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators of the types that a mail triage shows."""
    return indicators.filtered(table(spark, folder, "ioc"), types=batches.selected_types(), hide_private=True).select("ioc_id", "ioc_type")


@query("""select triage_id, row_number() over (order by coalesce(verdict_score, -1) desc, triage_id) as place from triage
where verdict_level in ('suspicious', 'malicious') and contains(lower(concat_ws(' ', path, subject, sender, top_reason)), 're')""")
def batch_visible(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a batch that a search and a level leave, by score: a report, ordered as a whole."""
    shown = batches.batch_view(table(spark, folder, "triage"), "suspicious", "re").select("triage_id", F.coalesce("verdict_score", F.lit(-1)).alias("score"))
    by_score = shown.groupBy("score").agg(F.count("*").alias("n"))  # at most 102 scores
    before = by_score.alias("a").join(F.broadcast(by_score.alias("b")), F.col("b.score") > F.col("a.score"), "left").groupBy(F.col("a.score").alias("score")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return batches.ranked(shown, "score", [F.col("triage_id")]).join(F.broadcast(before), "score").select("triage_id", (F.col("before") + F.col("rank")).alias("place"))


@query("select triage_id, len(coalesce(errors, [])) > 0 and coalesce(ioc_count, 0) = 0 and coalesce(kind, 'unknown') = 'unknown' as broken from triage")
def batch_broken(spark: SparkSession, folder: str) -> DataFrame:
    """Which rows stand for files that could not be read."""
    return table(spark, folder, "triage").select("triage_id", batches.broken().alias("broken"))


@query("""with t as (select triage_id, campaign_key as k, path from triage where coalesce(campaign_key, '') <> ''), n as (select k, count(*) as n from t group by 1),
d as (select distinct k, path from t where path is not null), r as (select k, path, row_number() over (partition by k order by path) as i from d), f as (select k, list(path order by path) as l from r where i <= 21 group by 1)
select triage_id, n - 1 as peer_count, array_to_string(list_filter(coalesce(l, []), lambda x: path is null or x <> path)[1:20], ' || ') as peers from t join n using (k) left join f using (k)""")
def campaign_peers(spark: SparkSession, folder: str) -> DataFrame:
    """How many other messages share a message's campaign, and the first of their paths."""
    out = batches.peers(table(spark, folder, "triage"), "campaign_key", "path", "triage_id")
    return out.select("triage_id", "peer_count", F.array_join("peers", " || ").alias("peers"))


@query("""with k as (select triage_id, campaign_key, case when instr(inner_, '@') > 0 then regexp_replace(split_part(inner_, '@', -1), '^>+|>+$', '', 'g') else '' end as d from (
 select triage_id, campaign_key, case when regexp_matches(low, '(?s)<.*>') then split_part(split_part(substr(low, instr(low, '<') + 1), '>', 1), '<', -1) else low end as inner_ from (select *, lower(trim(sender, ' ')) as low from triage)))
select triage_id from triage where campaign_key in (select campaign_key from k where campaign_key <> '' and d <> '' group by 1 having count(distinct d) >= 2)""")
def campaign_divergent_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of campaigns that several sender domains write."""
    return batches.divergent_messages(table(spark, folder, "triage").select("triage_id", "campaign_key", "sender"), "campaign_key", "sender").select("triage_id")


def _first_sql(c: str) -> str:
    return f"""(select batch_id, substr(string_agg({c}, '; ' order by k), 1, 500) as {c}s from (select batch_id, {c}, row_number() over (partition by batch_id order by o, {c}) as k from (select batch_id, {c}, min(triage_id) as o from triage where coalesce({c}, '') <> '' group by 1, 2)) where k <= 40 group by 1)"""


@query(f"""select b.batch_id, files, max_score, suspicious_or_worse, s.subjects, f.senders from (select batch_id, count(*) as files, max(coalesce(verdict_score, 0)) as max_score, count(*) filter (verdict_level in ('suspicious', 'malicious')) as suspicious_or_worse from triage where batch_id is not null group by 1) b
left join {_first_sql("subject")} s using (batch_id) left join {_first_sql("sender")} f using (batch_id)""")
def batch_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Each batch as one card."""
    return batches.merged_batch(table(spark, folder, "triage").where("batch_id is not null"), "batch_id", "triage_id")


@query(f"""with r as (select {_PATH.format('path')} as p, triage_id from triage where path is not null), a as (select p, min(triage_id) as x from r group by 1), b as (select split_part(p, '/', -1) as n, min(triage_id) as y from r group by 1 having count(*) = 1)
select feedback_id, coalesce(x, y) as triage_id from feedback left join a on {_PATH.format('source_path')} = a.p left join b on split_part({_PATH.format('source_path')}, '/', -1) = b.n""")
def feedback_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The message that each feedback event is about, by path or else by a unique file name."""
    return batches.matched_paths(table(spark, folder, "feedback").select("feedback_id", "source_path"), "source_path", table(spark, folder, "triage").select("path", "triage_id"), "path", "triage_id").select("feedback_id", "triage_id")


@query(f"""with w as (select distinct msg_id, rewritten_from as o, value as u from ioc where regexp_full_match(rewritten_from, 'https?://[^\\s,;|"]+') and value is not null and value <> rewritten_from),
f as (select msg_id, u as value, string_agg(distinct o, ' | ' order by o) as src from w group by 1, 2), h as (select distinct msg_id, lower(regexp_extract(o, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as value from w)
select i.ioc_id, f.src is not null or {_HAS.format('unwrapped')} as unwrapped, (h.value is not null and coalesce(ioc_type = 'domain', false)) or {_HAS.format('url_rewriter')} as rewriter, coalesce(f.src, i.rewritten_from) as rewritten_from
from ioc i left join f on i.msg_id = f.msg_id and i.value = f.value left join h on i.msg_id = h.msg_id and i.value = h.value""".replace("\\\\", "\\"))
def ioc_rewrites_marked(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators marked by the rewritten links of their message."""
    rows = table(spark, folder, "ioc")
    known = rows.where(F.col("rewritten_from").rlike(r'^https?://[^\s,;|"]+\z') & F.col("value").isNotNull()).select("msg_id", F.col("rewritten_from").alias("original"), F.col("value").alias("unwrapped"))
    out = batches.rewrites_marked(rows.select("ioc_id", "msg_id", "ioc_type", "value", "tags", "rewritten_from"), "msg_id", known)
    return out.select("ioc_id", indicators.has("unwrapped").alias("unwrapped"), indicators.has("url_rewriter").alias("rewriter"), "rewritten_from")


@query(r"""select ioc_id, coalesce(regexp_full_match(ip, '10\..*') or ip in ('192.168.0.1', '::1'), false) as allowlisted from (select ioc_id, case when regexp_full_match(value, '[0-9.]+:[0-9]+') then split_part(value, ':', 1) else lower(value) end as ip from ioc where ioc_type in ('ipv4', 'ipv6', 'ip_port'))""")
def ioc_allowed_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses on a list of plain entries and patterns."""
    rows = table(spark, folder, "ioc").where(F.col("ioc_type").isin("ipv4", "ipv6", "ip_port")).select("ioc_id", "value")
    return batches.allowlisted_addresses(rows, "value", ["10.*", "192.168.0.1", "::1"]).select("ioc_id", "allowlisted")


@query(f"select ident_id, severity, min(finding) as finding, count(*) as times from ({reference.SQL['header_findings']}) group by 1, 2")
def findings_best(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of each message by severity."""
    return batches.best_findings(signals.header_findings(table(spark, folder, "mail_identity"), "ident_id"), "ident_id", "severity", "finding")


@query("""select msg_id, array_to_string(list(s order by k)[1:12], ' || ') as types from (select msg_id, s, row_number() over (partition by msg_id order by o, s) as k from (select msg_id, ioc_type as s, min(ioc_id) as o from ioc where coalesce(ioc_type, '') <> '' group by 1, 2)) where k <= 12 group by 1""")
def types_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first types of a message's indicators, each once."""
    out = batches.first_reasons(table(spark, folder, "ioc"), "msg_id", "ioc_type", "ioc_id")
    return out.select("msg_id", F.array_join("reasons", " || ").alias("types"))


@query("select triage_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), ' || ') as items from (select triage_id, list_filter(list_concat(top_iocs, list_transform(top_iocs, lambda z: upper(z))), lambda x: x is not null) as l from triage where top_iocs is not null)")
def items_once(spark: SparkSession, folder: str) -> DataFrame:
    """Lists with every item written twice, reduced to their first writings."""
    rows = table(spark, folder, "triage").where("top_iocs is not null")
    doubled = F.concat("top_iocs", F.transform("top_iocs", lambda x: F.upper(x)))
    return rows.select("triage_id", F.array_join(batches.distinct_ignoring_case(doubled), " || ").alias("items"))


_LEVELS = " ".join(f"when '{k}' then '{v}'" for k, v in batches.LEVEL_NAMES.items())


@query(f"select feedback_id, case lower(trim(expected_level, ' ')) {_LEVELS} end as level from feedback where expected_level is not null")
def levels_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "feedback").where("expected_level is not null").select("feedback_id", batches.level_of(F.col("expected_level")).alias("level"))


@query(f"select ioc_id, regexp_full_match(host, '{tx.IPV4}') as raw, {' or '.join(f'''ends_with(host, '{z}')''' for z in tx.SUSPICIOUS_ZONES)} as suspicious from ioc where host is not null and not contains(host, ':')")
def hosts_judged(spark: SparkSession, folder: str) -> DataFrame:
    """Which hosts are bare addresses or in an often abused zone."""
    rows = table(spark, folder, "ioc").where("host is not null and not contains(host, ':')")
    return rows.select("ioc_id", batches.is_raw_address(F.col("host")).alias("raw"), tx.suspicious_zone(F.col("host")).alias("suspicious"))


@query(r"select mail_id, case when length(s) <= 40 then s else substr(s, 1, 20) || '…' || right(s, 19) end as subject from (select mail_id, regexp_replace(subject, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g') as s from mail where subject is not null)")
def subjects_shortened(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mail").where("subject is not null").select("mail_id", batches.shortened(batches.scrubbed(F.col("subject")), 40).alias("subject"))


# --- hand-off formats -------------------------------------------------------------------------


@query("""select ioc_id, 'indicator--' || ioc_id as id, ioc_type || ':' || substr(value, 1, 80) as name, array_to_string(list_concat(['unknown'], coalesce(tags, [])[1:8]), '|') as labels, coalesce(context, '') as description
from ioc where ioc_type in ('url', 'domain', 'ipv4', 'ipv6', 'email', 'md5', 'sha1', 'sha256') and value is not null""")
def export_stix_objects(spark: SparkSession, folder: str) -> DataFrame:
    """STIX indicator objects, read again."""
    objects = exports.stix_objects(table(spark, folder, "ioc")).withColumn("j", F.from_json("object", "id string, name string, labels array<string>, description string"))
    return objects.select("ioc_id", "j.id", "j.name", F.array_join("j.labels", "|").alias("labels"), "j.description")


@query("""select ioc_id, value, case ioc_type when 'url' then 'Url' when 'domain' then 'Domain-Name' when 'ipv4' then 'IPv4-Addr' when 'ipv6' then 'IPv6-Addr' when 'md5' then 'StixFile' when 'sha1' then 'StixFile' when 'sha256' then 'StixFile' when 'email' then 'Email-Addr' else 'Text' end as entity_type,
 case when ioc_type in ('md5', 'sha1', 'sha256') then upper(ioc_type) end as hash from ioc where ioc_type is not null""")
def export_opencti(spark: SparkSession, folder: str) -> DataFrame:
    """OpenCTI observables, read again."""
    objects = exports.opencti_objects(table(spark, folder, "ioc")).withColumn("j", F.from_json("object", "value string, entity_type string, hashes map<string,string>"))
    return objects.select("ioc_id", "j.value", "j.entity_type", F.get(F.map_keys("j.hashes"), F.lit(0)).alias("hash"))


def _cef(c: str) -> str:
    return reference._duck_cef(c)


@query(f"""select triage_id, 'CEF:0|{exports.VENDOR}|{exports.PRODUCT}|1.0|verdict|' || {_cef("coalesce(verdict_level, 'none')")} || '|' || case verdict_level when 'benign' then '1' when 'suspicious' then '6' when 'malicious' then '9' else '3' end || '|msg=' || {_cef('top_reason')} || ' cs1=' || {_cef('subject')} || ' cs1Label=Subject suser=' || {_cef('sender')}
 || ' filePath=' || {_cef('path')} || ' cn1=' || coalesce(cast(verdict_score as varchar), '') || ' cn1Label=Score cs2=' || {_cef('message_id')} || ' cs2Label=MessageId' as line from triage""")
def export_cef_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """A CEF line for the verdict of each message."""
    c = F.col
    return table(spark, folder, "triage").select("triage_id", exports.cef_verdict(c("verdict_level"), c("verdict_score"), c("top_reason"), c("subject"), c("sender"), c("path"), c("message_id")).alias("line"))


_DEFANGED = "replace(replace(regexp_replace(x, '\\bhttp([sS]?://)', 'hxxp\\1', 'g'), '.', '[.]'), '[[.]]', '[.]')"
_TICKET_SQL = {
    "verdict": "verdict_level", "score": "cast(verdict_score as varchar)", "campaign": "campaign_key", "reason": "top_reason", "file": "split_part(replace(path, chr(92), '/'), '/', -1)", "from": "sender", "subject": "subject",
    "message_id": "message_id", "iocs": f"array_to_string(list_transform(top_iocs[1:40], lambda x: {_DEFANGED}), chr(10) || '  ') || case when len(top_iocs) > 40 then chr(10) || '  and ' || (len(top_iocs) - 40) || ' more' else '' end", "errors": "array_to_string(errors[1:5], chr(10) || '  ')",
}


@query("select triage_id, concat_ws(chr(10), " + ", ".join("'" + label.replace("\n", "' || chr(10) || '") + f"' || nullif({_TICKET_SQL[n]}, '')" for label, n in exports.TICKET) + ") as ticket from triage")
def export_tickets(spark: SparkSession, folder: str) -> DataFrame:
    """The text of a ticket for each message."""
    return exports.ticket_values(table(spark, folder, "triage")).select("triage_id", exports.tickets().alias("ticket"))


@query("select triage_id as place, 'mail' as type, coalesce(campaign_key, '') as campaign_key, cast(null as bigint) as mail_count from triage union all select -1, 'campaign_pack_meta', null, count(*) from triage")
def export_campaign_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a campaign pack, read again."""
    lines = exports.campaign_pack(table(spark, folder, "triage"), "campaign_key", "triage_id").withColumn("j", F.from_json("line", "type string, campaign_key string, mail_count long"))
    return lines.select("place", "j.type", "j.campaign_key", "j.mail_count")


_ENTRIES = ("# comment", "", "domain: Example.COM.", "ip:10.0.0.1", "192.168.1.1", "2001:db8::1", "*.cdn.example", "cdn.example", "example.com")


@query("select * from (values ('domain', 'example.com'), ('ip', '10.0.0.1'), ('ip', '192.168.1.1'), ('ip', '2001:db8::1'), ('domain', '*.cdn.example'), ('domain', 'cdn.example')) t(kind, value)")
def allowlist_read(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of an allowlist file."""
    return config.allowlist_entries(spark.createDataFrame([(x,) for x in _ENTRIES], "line string"))


@query("""with h as (select distinct regexp_replace(lower(host), '\\.+$', '') as host from ioc where host is not null and not contains(host, ':') and not regexp_matches(host, '^[0-9.]+$')) select 'domain:' || host as line from h where host not in ('click.lumoraline.example', 'cdn.example')""".replace("\\\\", "\\"))
def allowlist_appended(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that the hosts of indicators add to an allowlist."""
    known = spark.createDataFrame([("domain", "click.lumoraline.example"), ("domain", "cdn.example")], "kind string, value string")
    hosts = table(spark, folder, "ioc").where("host is not null and not contains(host, ':')").where(~F.col("host").rlike(r"^[0-9.]+\z"))
    return config.new_allowlist_lines(hosts.select("host"), "host", known)


# --- messages as files ------------------------------------------------------------------------


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    mail = table(spark, folder, "mail").select(F.col("mail_id").alias("id"), "text", "recipients", "sender", "subject")
    head = table(spark, folder, "mail_identity").select(F.col("ident_id").alias("id"), "message_id", "in_reply_to", F.col("date_hdr").alias("date"))
    return mail_source.parse_files(mail_source.composed(mail.join(head, "id").withColumn("path", F.concat(F.lit("m"), F.col("id").cast("string"), F.lit(".eml")))))


def _line(c: str) -> str:
    return rf"coalesce(regexp_replace(regexp_replace({c}, '\s*[\r\n]+\s*', ' ', 'g'), '^[ \t]+|[ \t]+$', '', 'g'), '')"


@query(f"select 'm' || m.mail_id || '.eml' as path, {_line('m.sender')} as from_header, {_line('m.subject')} as subject, {_line('i.message_id')} as message_id, {_line('i.date_hdr')} as date, {_line('i.in_reply_to')} as in_reply_to, '' as spf, 0 as received_hops from mail m join mail_identity i on m.mail_id = i.ident_id")
def identity_cards(spark: SparkSession, folder: str) -> DataFrame:
    """The identity cards of messages that were written as files."""
    return headers.identity(_parsed(spark, folder)).select("path", "from_header", "subject", "message_id", "date", "in_reply_to", "spf", "received_hops")


@query()
def header_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators in the headers of messages that were written as files."""
    return indicators.extracted(headers.header_text(_parsed(spark, folder)), "path", "text").select("path", "ioc_type", "value", F.array_join("tags", "|").alias("tags"))


@query()
def links_unwrapped(spark: SparkSession, folder: str) -> DataFrame:
    """Where the links in all texts and rewrite fields lead, each link of a text once."""
    rewritten = table(spark, folder, "ioc").select(F.concat_ws(" ", F.lit("rewritten"), F.col("ioc_id").cast("string")).alias("id"), F.col("rewritten_from").alias("text"))
    found = indicators.found_in(reference._texts(spark, folder).unionByName(rewritten), "id", "text", ("url",)).where(F.lower("value").rlike("^https?://"))
    return rewriters.unwrap(found.select("id", "value").distinct(), "value").where("changed").select("id", "original", "unwrapped", F.array_join("chain", ">").alias("chain"))


_ROOT = r"lower(regexp_replace(regexp_extract(trim(coalesce(in_reply_to, ''), ' '), '^(\S+)', 1), '^[<>]+|[<>]+$', '', 'g'))"


@query(f"""with c as (select 'm' || m.mail_id || '.eml' as path, {_line('m.sender')} as sender, {_line('m.subject')} as subject, {_line('i.message_id')} as message_id, {_line('i.in_reply_to')} as in_reply_to from mail m join mail_identity i on m.mail_id = i.ident_id)
select path, sender, subject, message_id, coalesce('thread:' || nullif({_ROOT}, ''), 'subj:' || nullif({reference._SUBJECT}, ''), '') as campaign_key from c""")
def messages_analysed(spark: SparkSession, folder: str) -> DataFrame:
    """Triage rows of messages that were written as files and analysed as a whole."""
    return pipeline.analysed(_parsed(spark, folder)).triage.select("path", "sender", "subject", "message_id", "campaign_key")


@query()
def messages_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """The indicators of those messages."""
    allow = spark.createDataFrame([("example.net",)], "domain string")
    return pipeline.found_indicators(written(_parsed(spark, folder), "parsed"), allow).select("path", "ioc_type", "value", F.array_join("tags", "|").alias("tags"), "copies")

"""SQL that reads written dates independently of the operator, one pattern a form."""

from __future__ import annotations

from mirefold.operators.timestamps import ABBREVIATIONS, MONTHS

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp][Mm])\b)?"
_ZONE = r"(?:\s*([+-]\d{2}(?::?\d{2})?|[A-Za-z]+/[A-Za-z_/+-]+|[A-Za-z]{1,5}))?(?:\s*[(\[][^()\[\]]*[)\]])*"
#: Form, its pattern, and the names of its groups in order.
_FORMS = (
    ("iso", r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})[Tt ]+" + _TIME + _ZONE, "y m d h mi s f ap z"),
    ("compact", r"(\d{4})(\d{2})(\d{2})[Tt ](\d{2})(\d{2})(\d{2})()()" + _ZONE, "y m d h mi s f ap z"),
    ("rfc", r"(?:[A-Za-z]{3},?\s*)?(\d{1,2})[-\s]+([A-Za-z]{3})[-\s]+(\d{4}|\d{2})\s+" + _TIME + _ZONE, "d b y h mi s f ap z"),
    ("asctime", r"[A-Za-z]{3} +([A-Za-z]{3}) +(\d{1,2}) +" + _TIME + r" +(\d{4})()", "b d h mi s f ap y z"),
    ("slashed", r"(\d{1,2})/(\d{1,2})/(\d{4}),? +" + _TIME + "()", "p q y h mi s f ap z"),
    ("dotted", r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2}) +" + _TIME + "()", "d m y h mi s f ap z"),
    ("long", r"(\d{1,2})\.? (?:de )?(\p{L}{3,}) (?:de )?(\d{4})(?: г\.)?(?:,| à)? " + _TIME + "()", "d b y h mi s f ap z"),
)


def _form_sql(name: str, pattern: str, groups: str) -> str:
    found = groups.split()
    listed = ", ".join(f"'{g}'" for g in found)
    pick = lambda g: f"try_cast(nullif(r.{g}, '') as bigint)" if g in found else "null"
    months = " ".join(f"when lower(r.b) in ({', '.join(repr(w) for w in names.split())}) then {i}" for i, names in enumerate(MONTHS, 1))
    month = f"case {months} end" if "b" in found else "case when p > 12 then q when q > 12 then p when day_order = 'dmy' then q when day_order = 'mdy' then p when p = q then q end" if "p" in found else pick("m")
    day = "case when p > 12 then p when q > 12 then q when day_order = 'dmy' then p when day_order = 'mdy' then q when p = q then p end" if "p" in found else pick("d")
    more = f", {pick('p')} as p, {pick('q')} as q" if "p" in found else ""
    return f"""select tbl, row_id, field_name, tz_name, case when r_y < 100 then r_y + 2000 else r_y end as y, {month} as m, {day} as d,
 case when lower(ap) = 'pm' then h % 12 + 12 when lower(ap) = 'am' then h % 12 else h end as h, mi, coalesce(s, 0) as s, coalesce(cast(rpad(f, 6, '0') as bigint), 0) as f, z
from (select *, {pick('y')} as r_y, {pick('h')} as h, {pick('mi')} as mi, {pick('s')} as s, nullif(substr(r.f, 1, 6), '') as f, r.ap as ap, nullif(r.z, '') as z{more} from (
 select *, regexp_extract(v, '^{pattern}$', [{listed}]) as r from v where regexp_full_match(v, '{pattern}')))"""


def dates_sql() -> str:
    forms = "\nunion all\n".join(_form_sql(*f) for f in _FORMS)
    zones = " ".join(f"when '{n}' then {m}" for n, m in ABBREVIATIONS.items())
    return f"""with raw as (
 select 'mail_identity' as tbl, ident_id as row_id, 'date_hdr' as field_name, date_hdr as v, site_id from mail_identity
 union all select 'mail_identity', ident_id, 'first_received', split_part(first_received, ';', -1), site_id from mail_identity where contains(first_received, ';')
 union all select 'feedback', feedback_id, 'recorded_at', recorded_at, site_id from feedback),
v as (select tbl, row_id, field_name, regexp_replace(v, '^\\s+|\\s+$', '', 'g') as v, tz_name, day_order from raw left join site using (site_id) where v is not null),
p as ({forms}),
l as (select *, make_timestamp(y, m, d, h, mi, s + f / 1000000.0) as t from p
 where m between 1 and 12 and d between 1 and day(last_day(make_date(y, m, 1))) and h < 24 and mi < 60 and s <= 59),
k as (select *, epoch_us(make_timestamp(y, m, d, h, mi, cast(s as double))) + f as us,
 case when regexp_full_match(z, '[+-].*') then (case when z[1] = '-' then -1 else 1 end) * (cast(substr(z, 2, 2) as bigint) * 60 + case when length(z) > 3 then cast(right(z, 2) as bigint) else 0 end) else case lower(z) {zones} end end as off,
 case when z is null then tz_name when contains(z, '/') then z end as zone from l),
u as (select tbl, row_id, field_name, us, off, zone, make_timestamp(us) as local,
 timezone(zone, make_timestamp(us) - interval 1 day) + interval 24 hours as before, timezone(zone, make_timestamp(us)) as after from k)
select tbl, row_id, field_name, case when off is not null then us - off * 60000000 when timezone(zone, before) = local or timezone(zone, after) <> local then epoch_us(before) else epoch_us(after) end as utc_us
from u where off is not null or zone is not null
union all
select tbl, row_id, field_name, cast(v as bigint) * case when length(ltrim(v, '-')) < 12 then 1000000 when length(ltrim(v, '-')) < 15 then 1000 else 1 end from v where regexp_full_match(v, '-?[0-9]{{1,18}}')"""

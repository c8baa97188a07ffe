"""Strings, hosts, URLs and subjects as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How analysts write indicators so that they can't be clicked, and what they mean.
FANGS = (
    ("hxxps[://]", "https://"), ("hxxp[://]", "http://"), ("hxxps://", "https://"), ("hxxp://", "http://"), ("https[://]", "https://"), ("http[://]", "http://"),
    ("[://]", "://"), ("[:]", ":"), ("[.]", "."), ("(.)", "."), ("{.}", "."), ("[dot]", "."), ("(dot)", "."), ("{dot}", "."),
    ("[@]", "@"), ("[at]", "@"), ("(at)", "@"), ("{at}", "@"), ("hxxp[:]//", "http://"), ("hxxps[:]//", "https://"), ("\\.", "."),
)
# Zones under which a registrable name has three labels.
LONG_ZONES = ("co.uk", "com.br", "com.au", "com.tr")
# Words that mail gateways put before a subject, in brackets or before a colon, and those of reply and forward functions.
GATEWAY_WORDS = ("external email", "external", "ext", "внешняя почта", "внешнее", "spam")
GATEWAY_COLON = ("external", "внешняя почта", "внешнее", "spam")
REPLY_WORDS = ("re", "fwd", "fw", "ответ", "отв", "переслано", "пересылка", "пересл", "на")


def _words(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"


GATEWAY_TAG = rf"(?:\[{_words(GATEWAY_WORDS)}\]|{_words(GATEWAY_COLON)}\s*:)\s*"
ANSWER_TAG = rf"{_words(('re', 'ответ', 'отв', 'на'))}(?:\[[0-9]+\])?\s*:"
REPLY_TAG = rf"{_words(REPLY_WORDS)}(?:\[[0-9]+\])?\s*:\s*"
# Zones that are often abused.
SUSPICIOUS_ZONES = (".xyz", ".top", ".club", ".gq", ".tk", ".ml", ".cf", ".ga", ".zip", ".mov", ".cfd", ".sbs", ".click", ".bond", ".ru.com")
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


def defang(c: Column) -> Column:
    """hxxp for http (capital letters stay), and every dot in brackets."""
    scheme = F.regexp_replace(c, r"\bhttp([sS]?://)", "hxxp$1")
    return F.replace(F.replace(scheme, F.lit("."), F.lit("[.]")), F.lit("[[.]]"), F.lit("[.]"))


def refang(c: Column) -> Column:
    """The reverse of the usual ways to defang, in any letter case. Texts without any of them, nearly all, are only searched."""
    low, out, may = F.lower(c), c, F.lit(False)
    for written, meant in FANGS:
        out, may = F.regexp_replace(out, "(?i)" + _quoted(written), meant), may | low.contains(written)
    out = F.regexp_replace(out, r"(?i)\b([a-z0-9\-]+)\s+dot\s+([a-z0-9\-]+)\s+dot\s+([a-z]{2,24})\b", "$1.$2.$3")
    out = F.regexp_replace(out, r"(?i)\b([a-z0-9\-]+)\s+dot\s+([a-z]{2,24})\b", "$1.$2")
    return F.when(may | low.rlike(r"\sdot\s"), out).otherwise(c)


def url_part(c: Column, group: int) -> Column:
    """1 scheme, 2 user, 3 host, 4 port, 5 path, 6 query with its mark."""
    return F.regexp_extract(F.trim(c), r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?)?([^?#]*)(\?[^#]*)?", group)


def url_host(c: Column) -> Column:
    """Lower-case host of a URL, without brackets of an IPv6 host."""
    return F.lower(F.translate(url_part(c, 3), "[]", ""))


def url_key(c: Column) -> Column:
    """The form under which URLs are the same: scheme and host in lower case,
    no www., no fragment, no slash at the end of the path.
    """
    host = F.regexp_replace(url_host(c), r"^www\.", "")
    port, path, query = url_part(c, 4), url_part(c, 5), url_part(c, 6)
    return F.concat(
        F.lower(F.when(url_part(c, 1) == "", "http").otherwise(url_part(c, 1))), F.lit("://"), host,
        F.when(port.rlike("^0*$"), "").otherwise(F.concat(F.lit(":"), F.regexp_replace(port, "^0+", ""))),
        F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", "")), F.when(query == "?", "").otherwise(query),
    )


def domain_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\.+$", ""), r"^www\.", "")


def host_of(c: Column) -> Column:
    """Host of an e-mail address or a URL, or the value itself as a host."""
    value = F.trim(c)
    mail = F.lower(F.regexp_replace(F.regexp_extract(value, r"([^@]*)$", 1), "^>+|>+$", ""))
    url = F.when(F.instr(value, "://") > 0, value).otherwise(F.concat(F.lit("//"), value))
    return F.when((F.instr(value, "@") > 0) & (F.instr(value, "://") == 0), mail).otherwise(url_host(url))


def registrable(c: Column) -> Column:
    """The last two labels of a host, three under the zones that need it."""
    labels = F.filter(F.split(F.lower(F.trim(c)), r"\."), lambda x: F.trim(x) != "")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when((n >= 3) & last(2).isin(*LONG_ZONES), last(3)).when(n >= 2, last(2)).otherwise(F.lower(F.trim(c)))


def first_label(host: Column) -> Column:
    return F.substring_index(registrable(host), ".", 1)


def zone_of(host: Column) -> Column:
    reg = registrable(host)
    return F.when(F.instr(reg, ".") > 0, F.substring(reg, F.instr(reg, ".") + 1, F.length(reg))).otherwise("")


def sender_address(c: Column) -> Column:
    """The address of a From header, in lower case."""
    inside = F.regexp_extract(c, r"<([^>]+)>", 1)
    return F.lower(F.trim(F.when(inside != "", inside).otherwise(F.regexp_extract(c, r"([^\s<>()\"]+@[^\s<>()\"]+)", 1))))


def sender_display(c: Column) -> Column:
    """The display name of a From header, in lower case."""
    return F.when(F.trim(c).rlike(r'^"?[^"<]*"?\s*<[^>]+>'), F.lower(F.trim(F.regexp_extract(F.trim(c), r'^"?([^"<]*)"?\s*<[^>]+>', 1)))).when(F.instr(c, "@") > 0, "").otherwise(F.lower(F.trim(c)))


def sender_domain(c: Column) -> Column:
    """What follows the last @ of the address in angle brackets, else of the header."""
    low = F.lower(F.trim(c))
    inner = F.when(low.rlike("(?s)<.*>"), F.substring_index(F.substring_index(F.substring(low, F.instr(low, "<") + 1, F.length(low)), ">", 1), "<", -1)).otherwise(low)
    return F.when(F.instr(inner, "@") > 0, F.regexp_replace(F.regexp_extract(inner, r"([^@]*)$", 1), "^>+|>+$", "")).otherwise("")


def campaign_subject(c: Column) -> Column:
    """A subject without up to six gateway and reply tags, spaces collapsed, lower case, 80 characters."""
    bare = F.regexp_replace(F.trim(c), rf"(?iu)^(?:\s*(?:{GATEWAY_TAG}|{REPLY_TAG})){{0,6}}", "")
    return F.substring(F.regexp_replace(F.lower(F.trim(bare)), r"\s+", " "), 1, 80)


def thread_root(references: Column, in_reply_to: Column) -> Column:
    """The first identifier of References, else In-Reply-To, bare and in lower case; empty without both."""
    first = F.lower(F.regexp_replace(F.regexp_extract(F.trim(references), r"^(\S+)", 1), "^[<>]+|[<>]+$", ""))
    other = F.lower(F.regexp_replace(F.regexp_extract(F.trim(in_reply_to), r"^(\S+)", 1), "^[<>]+|[<>]+$", ""))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(other, F.lit("")), F.lit(""))


def related(left: Column, right: Column) -> Column:
    """Equal hosts, or one under the other."""
    return (left != "") & (right != "") & ((left == right) | left.endswith(F.concat(F.lit("."), right)) | right.endswith(F.concat(F.lit("."), left)))


def is_private_ipv4(c: Column) -> Column:
    a, b = (F.get(F.split(c, r"\."), F.lit(i)).try_cast("int") for i in (0, 1))
    return a.isin(10, 127, 0) | ((a == 169) & (b == 254)) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)) | ((a == 100) & b.between(64, 127)) | (c == "255.255.255.255")


def suspicious_zone(host: Column) -> Column:
    out = F.lit(False)
    for zone in SUSPICIOUS_ZONES:
        out = out | host.endswith(zone)
    return out


def join_visible(items: Column, limit: int, more: str = "+") -> Column:
    """Up to limit items joined by a bar, then how many are left out."""
    n = F.size(items)
    return F.when(n <= limit, F.array_join(items, "|")).otherwise(F.concat(F.array_join(F.slice(items, 1, limit), "|"), F.lit("|" + more), (n - limit).cast("string")))

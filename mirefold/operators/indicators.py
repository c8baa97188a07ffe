"""Indicators of compromise: found in text, merged, filtered, ranked and allowlisted."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirefold.functions import text as tx

# Schemes of addresses, hosts of messengers with what their links begin with, registry hives, namespaces of
# mutexes, and programs that attackers start.
SCHEMES = ("http", "https", "hxxp", "hxxps", "ftp", "file")
CHAT_LINKS = (("t.me/", "telegram"), ("telegram.me/", "telegram"), ("discord.gg/", "discord"), ("discord.com/invite/", "discord"))
HIVES = ("HKLM", "HKCU", "HKCR", "HKU", "HKCC", "HKEY_LOCAL_MACHINE", "HKEY_CURRENT_USER", "HKEY_CLASSES_ROOT", "HKEY_USERS", "HKEY_CURRENT_CONFIG")
NAMESPACES = ("Global", "Local")
PROGRAMS = ("powershell", "pwsh", "cmd", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "certutil", "bitsadmin")
# What makes a command line suspicious: options, calls and variables.
OPTIONS = ("enc", "encodedcommand", "e", "nop", "executionpolicy", "w hidden", "windowstyle hidden")
CALLS = ("downloadstring", "iex ", "frombase64", "invoke-", "http://", "https://", "$env:", ":\\", ":/")
# Last labels that end host names in running text, and those that end file names.
ZONES = (
    "ru su by ua kz uz am ge kg tj tm az md uk de fr it es pl cz sk nl be ch at se no fi dk ie pt gr tr il ae sa in cn jp kr tw hk sg my th vn id ph au nz ca us br mx ar cl co za eu "
    "io ai me tv cc ws to nu fm gg im je lc vc gd ms tc vg ac sh com org net edu gov mil int info biz name pro aero museum coop jobs mobi tel travel xxx online site website space tech "
    "store shop app dev cloud digital email mail bank finance money company ltd llc inc corp center world global today live news media blog club vip top xyz icu buzz click link win zip "
    "mov country agency solutions services support systems network security software technology group holdings international moscow tatar local localhost internal lan home corp intranet "
    "test example invalid"
).split()
FILE_ENDINGS = (
    "txt log csv json xml html htm pdf doc docx xls xlsx ppt pptx png jpg jpeg gif bmp svg mp3 mp4 avi mkv exe dll sys bat cmd ps1 vbs js jar msi dmg iso img rar 7z gz tar cab apk ipa py "
    "rb go rs c cpp h java class obj o tmp bak old ini cfg conf yaml yml toml md rtf odt ods db sql dat bin raw pcap evtx lnk reg plist"
).split()
# Header fields whose address in angle brackets is a mailbox, and those that hold identifiers.
MAILBOX_FIELDS = ("from", "to", "cc", "bcc", "sender", "reply-to", "mail from", "rcpt to", "return-path", "delivered-to", "envelope-to", "final-recipient", "original-recipient")
IDENTIFIER_FIELDS = ("message-id", "in-reply-to", "references")

# --- how each type is written; a match begins after something that isn't a letter, digit or underscore ------
_START = r"(?:^|[^A-Za-z0-9_])"
_STOP = r"\s<>\"')\]"  # ends an address in running text
_TAIL = rf"[^{_STOP}]*[^{_STOP}.,;:!?]"  # punctuation at the end belongs to the sentence
_PART = r"[^\\/:*?\"<>|'\s]*[^\\/:*?\"<>|'\s.,;)]"  # a name in a path
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"


def _either(words: tuple[str, ...]) -> str:
    return "|".join("".join(c if c.isalnum() or c in "_-" else r"\s+" if c == " " else "\\" + c for c in w) for w in words)


def _ipv6() -> str:
    """Eight groups, or fewer with one gap; the last two groups may be an IPv4 address."""
    g = "[0-9A-Fa-f]{1,4}"
    last = rf"(?:{g}:{g}|{tx.IPV4})"
    forms = [rf"(?:{g}:){{6}}{last}", rf"(?:{g}:){{7}}{g}", rf"(?:{g}:){{1,7}}:"]
    for before in range(7):
        head = "" if not before else g if before == 1 else rf"(?:{g}:){{{before - 1}}}{g}"
        after = 7 - before
        forms.append(rf"{head}::(?:{g}:){{0,{after - 1}}}{g}" if after > 1 else rf"{head}::{g}")
        if after > 2:
            forms.append(rf"{head}::(?:{g}:){{0,{after - 3}}}{tx.IPV4}")
    return "(" + "|".join(forms) + ")"


#: (type, kind, pattern, alphabet): a "token" must fill a whole run of its alphabet, a "find" may occur anywhere; group 1 holds the value.
PATTERNS: tuple[tuple[str, str, str, str], ...] = (
    ("messenger", "find", rf"(?i){_START}((?:https?://)?(?:{_either(tuple(h for h, _ in CHAT_LINKS))})[A-Za-z0-9_/=?-]*[A-Za-z0-9_/=-])", ""),
    ("url", "find", rf"(?i){_START}((?:{_either(SCHEMES)})://(?:\[[0-9A-Fa-f:.]+\](?:{_TAIL})?|{_TAIL}))", ""),
    ("email", "find", rf"(?i){_START}([a-z0-9_%+-](?:[a-z0-9._%+-]*[a-z0-9_%+-])?@(?:{_LABEL}\.)+[a-z]{{2,}})", ""),
    ("ipv4", "token", rf"({tx.IPV4})", r"[\w.]"),
    ("ipv6", "token", _ipv6(), r"[\w:.]"),
    ("sha256", "token", r"([A-Fa-f0-9]{64})", r"[A-Fa-f0-9]"),
    ("sha1", "token", r"([A-Fa-f0-9]{40})", r"[A-Fa-f0-9]"),
    ("md5", "token", r"([A-Fa-f0-9]{32})", r"[A-Fa-f0-9]"),
    ("cve", "find", rf"(?i){_START}(CVE-[0-9]{{4}}-[0-9]{{4,7}})", ""),
    ("unc", "find", rf"(?:^|[^\\])(\\\\[A-Za-z0-9][A-Za-z0-9._-]*(?:\\{_PART})+)", ""),
    ("filepath", "find", rf"{_START}([A-Za-z]:(?:\\{_PART})+)", ""),
    ("registry", "find", rf"(?i){_START}((?:{_either(HIVES)})(?:\\{_PART})+)", ""),
    ("mutex", "find", rf"(?i){_START}((?:{_either(NAMESPACES)})\\[A-Za-z0-9_.-]{{3,128}})", ""),
    ("monero", "find", rf"{_START}(4[0-9AB][1-9A-HJ-NP-Za-km-z]{{93}})\b", ""),
    ("command_line", "find", rf"(?i){_START}((?:{_either(PROGRAMS)})(?:\.exe)?[^A-Za-z0-9_.\r\n][^\r\n]{{0,400}})", ""),
)
#: What a text must hold for a type to be looked for at all.
NEEDS = {"url": "://", "email": "@", "cve": "-", "unc": "\\\\", "filepath": ":\\", "registry": "\\", "mutex": "\\", "ipv4": ".", "ipv6": ":", "ip_port": ":", "domain": "."}
IP_PORT = r"(?:^|[^A-Za-z0-9_.])([0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5})\b"
BITCOIN = rf"{_START}((?:bc1|[13])[A-HJ-NP-Za-z0-9]{{25,62}})\b"
COMMAND_SIGNAL = rf"(?i)\s-(?:{_either(OPTIONS)})(?:\s|$)|\s/c(?:\s|$)|{_either(CALLS)}|%[a-z0-9_]+%|\\\\[^\\\s]"
#: A run of the characters of hosts and addresses with a dot inside; hosts are runs that are one as a whole.
HOST_RUN = r"[\p{L}\p{N}@_-]++(?:\.++[\p{L}\p{N}@_-]++)+"
HOST = rf"^(?:{_LABEL}\.)+[a-z](?:[a-z0-9-]*[a-z0-9])\z"
UNICODE_HOST = r"^(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.)+\p{L}{2,}\z"
# Hosts of link-rewriting gateways.
REWRITER_HOSTS = ("safelinks.protection.outlook.com", "urldefense.com", "urldefense.proofpoint.com", "mimecast.com", "linkprotect.cudasvc.com")
# What raises or lowers an indicator where several writings compete.
PRIORITY = (("unwrapped", 50), ("url_rewriter", -30), ("allowlisted", -10), ("private", -5))
HASHES = ("md5", "sha1", "sha256")
# Tags that make a bare file name worth acting on.
FILE_RISK = ("double_extension", "dangerous_extension", "archive_dangerous_member", "nested_email", "qr")
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def base58_checks(address: str) -> bool:
    """The last four bytes are the start of the double SHA-256 of the rest."""
    number = 0
    for c in address:
        if c not in BASE58:
            return False
        number = number * 58 + BASE58.index(c)
    if number >= 1 << 200:
        return False
    raw = number.to_bytes(25, "big")
    return hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def bech32_checks(address: str) -> bool:
    """The polynomial remainder of prefix and data is that of Bech32 or Bech32m."""
    if address.lower() != address and address.upper() != address:
        return False
    address = address.lower()
    prefix, mark, data = address.rpartition("1")
    if not mark or len(data) < 6 or any(c not in BECH32 for c in data):
        return False
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    rest = 1
    for v in values:
        top, rest = rest >> 25, (rest & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            rest ^= g if top >> i & 1 else 0
    return rest in (1, 0x2BC830A3)


def _matches(text: Column, kind: str, pattern: str, alphabet: str) -> Column:
    if kind == "find":
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit(f"({alphabet}+)"), F.lit(1))
    return F.filter(runs, lambda x: x.rlike(f"^{pattern}$"))


def prepared(text: Column) -> Column:
    """A text as indicators are looked for in it: refanged, without identifier fields and invisible characters within words."""
    out = F.regexp_replace(tx.refang(text), rf"(?im)^(?:{_either(IDENTIFIER_FIELDS)})\s*:.*$", "")
    return F.regexp_replace(out, "(?<=[\\p{L}\\p{N}])[\u00ad\u200b-\u200d\ufeff]+(?=[\\p{L}\\p{N}])", "")


def without_identifiers(text: Column) -> Column:
    """A text without what stands in angle brackets, but for the mailboxes of address fields."""
    mailboxes = F.regexp_replace(text, rf"(?im)((?:^|[\s;])(?:{_either(MAILBOX_FIELDS)})(?:\s*:|\s)(?:\s*[a-z0-9-]+\s*;)?[^<>\n]*)<([^<>\s]+)>", "$1 $2 ")
    return F.regexp_replace(mailboxes, r"<[^<>\s]*@[^<>\s]*>", " ")


def _without_tails(text: Column) -> Column:
    """A text whose URLs are cut after their host."""
    return F.regexp_replace(text, rf"(?i)((?:{_either(SCHEMES)})://[^/?#{_STOP}]*)[/?#][^{_STOP}]*", "$1 ")


def is_host(host: Column, free_text: bool = False) -> Column:
    """Whether a dotted name is one of the domain system rather than a file name or an attribute."""
    labels = F.split(host, r"\.")
    zone, first = F.element_at(labels, -1), F.element_at(labels, 1)
    good = (F.size(labels) >= 2) & ~zone.isin(*FILE_ENDINGS) & ~zone.rlike("^[0-9]+$") & ~host.rlike(r"^(?:header|smtp)\.|(?:^|\.)-|-(?:\.|$)|\.\.")
    good = good & ~(first.rlike("^[0-9a-f]{8,}$") & first.rlike("[0-9]"))
    if free_text:
        good = good & ((F.size(labels) > 2) | zone.isin(*ZONES) | zone.startswith("xn--") | zone.rlike(r"[^\x00-\x7F]"))
    return good


def found_in(df: DataFrame, row_id: str, text: str, types: tuple[str, ...] | None = None, radius: int | None = None) -> DataFrame:
    """(row_id, ioc_type, pos, value, tags), with a radius also context, the text around the first place of a value: every indicator that a text contains, in order of
    type and place. Null and empty texts have none; the text is read whole and as it is; an
    indicator that recurs in a text is given each time. Nothing leaves the JVM.
    """
    t = F.col(text)
    arrays = [(name, _matches(t, kind, pattern, alphabet)) for name, kind, pattern, alphabet in PATTERNS if types is None or name in types]
    if types is None or "ip_port" in types:
        arrays.append(("ip_port", F.filter(F.regexp_extract_all(t, F.lit(IP_PORT), F.lit(1)), lambda x: x.rlike(rf"^{tx.IPV4}:"))))
    if types is None or "domain" in types:
        runs = F.transform(F.regexp_extract_all(_without_tails(without_identifiers(t)), F.lit(HOST_RUN), F.lit(0)), F.lower)
        hosts = F.filter(runs, lambda h: h.rlike(HOST) & is_host(h, True))
        foreign = F.filter(runs, lambda h: h.rlike(r"[^\x00-\x7F]") & h.rlike(UNICODE_HOST) & is_host(h, True))
        arrays.append(("domain", F.concat(hosts, foreign)))
    arrays = [(name, F.when(t.contains(NEEDS[name]), found) if name in NEEDS else found) for name, found in arrays]
    each = F.array(*[F.struct(F.lit(name).alias("ioc_type"), found.alias("found")) for name, found in arrays])
    kept = [t.alias("__t")] if radius else []
    rows = df.where(t.isNotNull()).select(F.col(row_id), *kept, F.explode(each).alias("e")).select(row_id, *["__t"] * len(kept), "e.ioc_type", F.posexplode("e.found").alias("pos", "raw"))
    kind, raw = F.col("ioc_type"), F.col("raw")
    value = (
        F.when(kind == "cve", F.upper(raw))
        .when(kind.isin(*HASHES), F.lower(raw))
        .when((kind == "messenger") & ~raw.rlike("(?i)^https?://"), F.concat(F.lit("https://"), raw))
        .when(kind == "command_line", trimmed_command(raw))
        .otherwise(raw)
    )
    rows = rows.withColumn("value", value).where((kind != "command_line") | ((F.length("value") >= 12) & F.col("value").rlike(COMMAND_SIGNAL)))
    rows = rows.where(~kind.isin(*HASHES) | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-f]")))
    rows = rows.where((kind != "ip_port") | F.substring_index("value", ":", -1).try_cast("int").between(1, 65535)).where((kind != "filepath") | (F.length("value") >= 6)).where((kind != "ipv6") | (F.length("value") > 2))
    chats = [F.when((kind == "messenger") & F.lower("value").contains(link), tag) for link, tag in CHAT_LINKS]
    tags = F.array_distinct(F.array_compact(F.array(
        F.when(kind.isin("ipv4", "ip_port") & tx.is_private_ipv4(F.substring_index("value", ":", 1)), "private"),
        F.when((kind == "ipv6") & is_private_ipv6(F.lower("value")), "private"),
        F.when((kind == "url") & F.lower("value").startswith("hxxp"), "was_defanged"),
        F.when((kind == "domain") & rewriter_host(F.col("value")), "url_rewriter"),
        F.when((kind == "domain") & F.col("value").rlike(r"(?:^|\.)xn--"), "punycode"),
        F.when(kind == "command_line", "process"),
        *chats,
    )))
    around = []
    if radius:
        place = F.instr(F.col("__t"), F.col("raw"))
        cut = F.substring(F.col("__t"), F.greatest(F.lit(1), place - radius), F.least(place, F.lit(radius + 1)) - 1 + F.length("raw") + radius)
        around = [F.trim(F.regexp_replace(cut, r"[\r\n]", " ")).alias("context")]
    return rows.select(row_id, "ioc_type", "pos", "value", tags.alias("tags"), *around)


def trimmed_command(c: Column) -> Column:
    """A command without the prose after it: up to two blanks before a capital letter, at most 240 characters."""
    bare = F.regexp_replace(F.trim(c), "[.,;]+$", "")
    return F.trim(F.substring(F.regexp_replace(bare, r"(?s)^(.{12,}?)\s{2,}\p{Lu}.*$", "$1"), 1, 240))


def is_private_ipv6(c: Column) -> Column:
    """Loopback, unspecified, link-local, unique local and documentation addresses, and private IPv4 ones written as IPv6."""
    tail = F.regexp_extract(c, rf"^::ffff:({tx.IPV4})$", 1)
    return c.isin("::1", "::") | c.rlike("^fe[89ab][0-9a-f]:|^f[cd][0-9a-f]{2}:|^2001:0?db8:") | ((tail != "") & tx.is_private_ipv4(tail))


def rewriter_host(c: Column) -> Column:
    out = F.lit(False)
    for suffix in REWRITER_HOSTS:
        out = out | (c == suffix) | c.endswith("." + suffix)
    return out


#: Types in the order in which they are looked for; where two readings are equal, the earlier stays.
ORDER = ("messenger", "url", "email", "ip_port", "ipv4", "ipv6", "sha256", "sha1", "md5", "cve", "unc", "filepath", "registry", "mutex", "monero", "command_line", "domain")


def extracted(df: DataFrame, row_id: str, text: str, radius: int = 60) -> DataFrame:
    """(row_id, ioc_type, key, value, tags, context, copies): each indicator of a text once.

    The text is refanged; identifier fields and identifiers in angle brackets
    are no addresses; hosts of URLs and addresses are indicators of their own;
    a hash that is part of a longer one that was found is left out; a chat
    link is no URL. Equal ones (URLs by their comparable form, the rest apart
    from case) give one row with the first writing, all tags, and the text
    around it. One shuffle by row and key, with partial sums. Null and empty
    texts have none; row_id must be unique.
    """
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(row_id), F.lower(text).contains("hxxp").alias("__was"), prepared(F.col(text)).alias("__text"))
    none = F.array().cast("array<string>")
    mails = found_in(rows.withColumn("__text", without_identifiers(F.col("__text"))), row_id, "__text", ("email",), radius).withColumn("value", F.lower("value"))
    others = found_in(rows, row_id, "__text", tuple(t for t in ORDER if t != "email"), radius)
    kind, value, pos = F.col("ioc_type"), F.col("value"), F.col("pos")
    host = tx.url_host(value)
    item = lambda k, v, p, t: F.struct(F.lit(k).alias("ioc_type") if isinstance(k, str) else k.alias("ioc_type"), v.alias("value"), p.alias("pos"), t.alias("tags"))
    plain = host.rlike(f"^{tx.IPV4}$")
    mail_host = F.substring_index(value, "@", -1)
    derived = F.array_compact(F.array(  # what an indicator names is one itself; it counts as found before free text
        item(kind, value, pos, F.col("tags")),
        F.when((kind == "url") & ~plain & is_host(host), item("domain", host, pos - 2_000_000, F.array_compact(F.array(F.lit("from_url"), F.when(rewriter_host(host), "url_rewriter"))))),
        F.when((kind == "url") & plain & ~tx.is_private_ipv4(host), item("ipv4", host, pos - 2_000_000, F.array(F.lit("from_url")))),
        F.when((kind == "email") & is_host(mail_host), item("domain", mail_host, pos - 1_000_000, F.array(F.lit("from_email")))),
        F.when(kind == "ip_port", item("ipv4", F.substring_index(value, ":", 1), pos - 1_000_000, F.col("tags"))),
    ))
    every = others.unionByName(mails).select(row_id, "context", F.explode(derived).alias("i")).select(row_id, "context", "i.*")
    key = F.when(kind.isin("url", "messenger"), tx.url_key(value)).when(kind == "domain", tx.domain_key(value)).otherwise(F.lower(value))
    every = every.withColumn("key", key).withColumn("value", F.when(kind == "domain", tx.domain_key(value)).otherwise(value))
    once = every.groupBy(row_id, "ioc_type", "key").agg(F.min_by(F.struct("value", "context"), "pos").alias("first"), F.array_sort(F.collect_set("tags")).alias("tags"), F.count("*").alias("copies"))
    whole = once.groupBy(row_id).agg(F.collect_list(F.struct("ioc_type", "key", "first.value", F.array_distinct(F.flatten("tags")).alias("tags"), "first.context", "copies")).alias("all"))  # as long as the text
    longer = F.filter("all", lambda x: x["ioc_type"].isin("sha256", "sha1"))
    part_of = lambda x: x["ioc_type"].isin("sha1", "md5") & F.exists(longer, lambda y: (F.length(y["value"]) > F.length(x["value"])) & y["value"].contains(x["value"]))
    chats = F.transform(F.filter("all", lambda x: x["ioc_type"] == "messenger"), lambda x: x["key"])
    kept = F.filter("all", lambda x: ~part_of(x) & ~((x["ioc_type"] == "url") & F.array_contains(chats, x["key"])))
    was = rows.where("__was").select(row_id, "__was")
    flat = whole.join(was, row_id, "left").select(row_id, "__was", F.explode(kept).alias("i"))
    tags = F.array_distinct(F.concat("i.tags", F.when((F.col("i.ioc_type") == "url") & F.col("__was"), F.array(F.lit("was_defanged"))).otherwise(none)))
    return flat.select(row_id, "i.ioc_type", "i.key", "i.value", tags.alias("tags"), "i.context", "i.copies")


def wallets_in(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, value) of the Bitcoin addresses in a text whose checksum holds."""
    near = df.where(F.col(text).rlike(BITCOIN)).select(row_id, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(BITCOIN), F.lit(1)))).alias("value"))
    schema = near.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [(bech32_checks(v) if v.lower().startswith("bc1") else base58_checks(v)) for v in b.column(1).to_pylist()]
            yield b.filter(pa.array(good, pa.bool_()))

    return near.mapInArrow(run, schema)


def derived_hosts(found: DataFrame, row_id: str) -> DataFrame:
    """(row_id, ioc_type, value, tags) of the hosts that URLs and addresses name."""
    host = F.when(F.col("ioc_type") == "url", tx.url_host(F.col("value"))).when(F.col("ioc_type") == "email", F.lower(F.substring_index("value", "@", -1)))
    tag = F.when(F.col("ioc_type") == "url", "from_url").otherwise("from_email")
    rows = found.select(row_id, host.alias("value"), F.array(tag).alias("tags")).where("value <> ''")
    return rows.select(row_id, F.when(F.col("value").rlike(f"^{tx.IPV4}$"), "ipv4").otherwise("domain").alias("ioc_type"), "value", "tags")


def has(tag: str, tags: str = "tags") -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def priority(tags: str = "tags") -> Column:
    """How strong an indicator is where writings of it compete."""
    total = F.when(has("from_url", tags) & ~has("url_rewriter", tags), 20).otherwise(0)
    for tag, points in PRIORITY:
        total = total + F.when(has(tag, tags), points).otherwise(0)
    return total.cast("int")


def merge_key(kind: Column, value: Column) -> Column:
    return F.when(kind == "url", tx.url_key(value)).otherwise(F.lower(value))


def merged(df: DataFrame, group: str, order: str) -> DataFrame:
    """One row (group, ioc_type, key, value, tags, rewritten, copies, priority) for each
    indicator of a group: the value of the strongest writing, the earliest of equals; the tags
    of all in order of strength; rewrites joined by a bar.

    Null tags count as none; null values are left out; `order` breaks ties and must be unique
    within a group. Writings, tags and rewrites are first counted each by itself, with partial
    sums, so that a hot indicator arrives as its distinct tags and not as its rows.
    """
    rows = df.where("value is not null").withColumn("key", merge_key(F.col("ioc_type"), F.col("value")))
    empty = F.array().cast("array<string>")
    item = lambda kind, value, pos: F.struct(F.lit(kind).alias("kind"), value.alias("item"), pos.cast("int").alias("pos"))
    items = F.concat(
        F.array(item("v", F.col("value"), F.lit(0)), item("r", F.trim(F.coalesce("rewritten_from", F.lit(""))), F.lit(0))),
        F.transform(F.coalesce("tags", empty), lambda t, i: item("t", t, i)),
    )
    each = rows.select(group, "ioc_type", "key", (-priority()).alias("p"), F.col(order).alias("o"), F.explode(items).alias("i"))
    distinct = each.groupBy(group, "ioc_type", "key", F.col("i.kind").alias("kind"), F.col("i.item").alias("item")).agg(F.min(F.struct("p", "o", "i.pos")).alias("first"), F.count("*").alias("n"))
    of = lambda kind: F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("item").isNotNull() & (F.col("item") != ""), F.struct("first", "item"))))
    agg = distinct.groupBy(group, "ioc_type", "key").agg(F.min_by("item", F.when(F.col("kind") == "v", F.col("first"))).alias("value"), of("t").alias("tags"), of("r").alias("rewritten"), F.sum(F.when(F.col("kind") == "v", F.col("n"))).cast("int").alias("copies"))
    names = lambda c: F.transform(c, lambda x: x["item"])
    out = agg.select(group, "ioc_type", "key", "value", names("tags").alias("tags"), F.array_join(names("rewritten"), " | ").alias("rewritten"), "copies")
    return out.withColumn("priority", priority_of(F.col("tags")))


def priority_of(tags: Column) -> Column:
    inside = lambda tag: F.coalesce(F.array_contains(tags, tag), F.lit(False))
    total = F.when(inside("from_url") & ~inside("url_rewriter"), 20).otherwise(0)
    for tag, points in PRIORITY:
        total = total + F.when(inside(tag), points).otherwise(0)
    return total.cast("int")


def noise_marked(df: DataFrame, group: str) -> DataFrame:
    """Rewriter domains of a group in which another domain was unwrapped or taken from a URL get
    the tag noise_candidate. The group's flag is aggregated and joined back, so that no window
    has to hold a group.
    """
    real = df.where((F.col("ioc_type") == "domain") & (has("unwrapped") | has("from_url"))).select(group).distinct().withColumn("__real", F.lit(True))
    noisy = (F.col("ioc_type") == "domain") & has("url_rewriter") & F.coalesce("__real", F.lit(False))
    return df.join(real, group, "left").withColumn("tags", F.when(noisy, F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("noise_candidate")))).otherwise(F.col("tags"))).drop("__real")


def filtered(df: DataFrame, types: list[str] | None = None, hide_private: bool = False, hide_rewriter: bool = False, hide_allowlisted: bool = False, actionable: bool = False, search: str = "", source_file: str = "") -> DataFrame:
    """Indicators that pass the filters; all of them are plain predicates and reach the scan where it can use them."""
    noise = has("url_rewriter") | has("noise_candidate")
    out = df
    if types is not None:
        out = out.where(F.col("ioc_type").isin(*types))
    if hide_private or actionable:
        out = out.where(~has("private"))
    if hide_rewriter or actionable:
        out = out.where(~noise)
    if hide_allowlisted or actionable:
        out = out.where(~has("allowlisted"))
    if actionable:
        out = out.where((F.col("ioc_type") != "filename") | F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in FILE_RISK])), F.lit(False)))
    if source_file:
        wanted = source_file.replace("\\", "/").lower()
        files = F.transform(F.filter("tags", lambda x: x.startswith("file:")), lambda x: F.lower(F.translate(F.substring(x, 6, 100000), "\\", "/")))
        name = wanted.rpartition("/")[2]
        hit = F.exists(files, lambda x: (x == wanted) | (~x.contains("/") & (x == name)))
        out = out.where(F.coalesce((F.size(files) <= 0) | hit, F.lit(True)))
    if q := search.strip().lower():
        hay = F.concat_ws(" ", F.lower("value"), F.col("ioc_type"), F.lower(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")), F.lower(F.coalesce("context", F.lit(""))))
        out = out.where(hay.contains(q))
    return out


def tier() -> Column:
    """Unwrapped first, then hashes, then the rest."""
    return F.when(has("unwrapped"), 0).when(F.col("ioc_type").isin(*HASHES) | has("attachment_hash"), 1).otherwise(2)


def top_strings(df: DataFrame, group: str, order: str, n: int = 5) -> DataFrame:
    """(group, top): up to n "type:value" of a group, strongest first; allowlisted, rewritten and
    private ones only fill what is left. Only the best n of each input task are shuffled.
    """
    excluded = F.when(has("allowlisted") | has("url_rewriter") | has("private"), 1).otherwise(0)
    best = F.struct(excluded.alias("x"), (-priority()).alias("p"), F.col(order).alias("o"), F.concat_ws(":", "ioc_type", "value").alias("s"))
    rows = df.where("value is not null").select(group, best.alias("b"))
    first = rows.groupBy(group, F.col("b.s").alias("s")).agg(F.min("b").alias("b"))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy("b"))).where(F.col("n") <= n)
    return ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("t")).select(group, F.transform("t", lambda x: x["s"]).alias("top"))


# Roots of clouds whose hosts are both the provider's own and its users', and hosts where users own the content.
CLOUD_ROOTS = ("amazonaws.com", "windows.net", "azure.com", "googleapis.com", "githubusercontent.com", "google.com", "live.com", "office.com", "github.com", "icloud.com", "microsoft.com")
USER_HOSTS = (
    "drive.google.com", "docs.google.com", "sites.google.com", "script.google.com", "storage.cloud.google.com", "sheets.google.com", "slides.google.com", "keep.google.com", "groups.google.com",
    "drive.usercontent.google.com", "calendar.google.com", "meet.google.com", "classroom.google.com", "lookerstudio.google.com", "chat.google.com", "datastudio.google.com",
    "onedrive.live.com", "storage.live.com", "sway.office.com", "forms.office.com", "excel.office.com", "word.office.com", "powerpoint.office.com", "onedrive.office.com", "onedrive.microsoft.com",
    "forms.microsoft.com", "sway.microsoft.com", "teams.microsoft.com", "teams.office.com", "loop.microsoft.com", "visio.office.com", "delve.office.com", "onenote.office.com", "onenote.microsoft.com",
    "whiteboard.office.com", "gist.github.com", "share.icloud.com", "photos.icloud.com", "storage.googleapis.com", "firebasestorage.googleapis.com", "githubusercontent.com",
)


def user_cloud_host(host: Column) -> Column:
    """Whether a host in a provider's cloud serves what a user put there: buckets, blobs, drives, forms."""
    bucket = host.endswith(".amazonaws.com") & host.rlike(r"(?:^|\.)s3[.-]")
    blob = host.rlike(r"^[a-z0-9][a-z0-9-]+(?:\.[a-z0-9][a-z0-9-]*)?\.(?:blob|file|dfs|web)\.core\.windows\.net\z") | (host.endswith(".azure.com") & host.rlike(r"\.(?:blob|storage|file)\."))
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return bucket | blob | F.arrays_overlap(above, F.array(*[F.lit(h) for h in USER_HOSTS]))


def allowlisted(df: DataFrame, host: str, domains: DataFrame) -> DataFrame:
    """df with `allowlisted`: whether the host or a domain above it is in domains(domain).

    A host where a user of a cloud owns the content isn't covered by the cloud's root.
    Each distinct host is exploded into itself and the domains above it, an equi-join; wildcard
    entries (*) are few and matched as one pattern. The distinct hosts are matched, not the rows.
    """
    plain = domains.where(~F.col("domain").contains("*")).select(F.lower("domain").alias("suffix")).distinct()
    wild = [r["domain"] for r in domains.where(F.col("domain").contains("*")).limit(1001).collect()]
    if len(wild) > 1000:
        raise ValueError("more than 1000 wildcard entries; write them as plain domains")
    hosts = df.select(F.lower(F.regexp_replace(host, r"\.+$", "")).alias("__host")).where("__host <> ''").distinct()
    labels = F.split("__host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    users = user_cloud_host(F.col("__host"))
    suffixes = hosts.withColumn("__user", users).withColumn("suffix", F.explode(above)).where(~(F.col("__user") & (F.col("suffix") != F.col("__host")) & F.col("suffix").isin(*CLOUD_ROOTS)))
    matched = suffixes.join(plain, "suffix").select("__host").distinct()
    if wild:
        pattern = "|".join("".join(".*" if c == "*" else "\\" + c if not c.isalnum() else c for c in w.lower()) for w in wild)
        matched = matched.unionByName(hosts.where(F.col("__host").rlike(f"^(?:{pattern})$"))).distinct()
    key = F.lower(F.regexp_replace(host, r"\.+$", ""))
    return df.withColumn("__host", key).join(matched.withColumn("allowlisted", F.lit(True)), "__host", "left").withColumn("allowlisted", F.coalesce("allowlisted", F.lit(False))).drop("__host")

"""What the headers, the text and the HTML of a message give away.

A signal of wording is a rule over small vocabularies: one group of words
near another, within so many words. All rules become plain patterns without
look-around on lower-case text, so that any engine can read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirefold.functions import text as tx

# --- vocabulary: stems (with *) and words, in English and Russian -----------------------------
SECRET = "password passwords passcode passcodes parol парол* пин-код*"
ASK = "enter type provide submit reset change confirm renew update введ* вве* укаж* смен* обнов* подтверд*"
ACCOUNT = "account accounts mailbox profile учетн* учётн* аккаунт* ящик*"
VERIFY = "verify validate confirm reactivate подтверд* провер* актив*"
BLOCKED = "suspended suspend locked blocked disabled deactivated заблокир* отключ* приостанов*"
HURRY = "urgent urgently immediately asap срочн* немедленн*"
EXPIRE = "expires expired expire expiring истек* истёк* заканчива*"
MONEY = "funds money payment cash amount деньг* средств* сумм* оплат*"
TRANSFER = "wire transfer transfers перевод* переведите перечисл*"
ALTER = "change changed changes changing new updated update смен* нов* измен*"
DETAILS = "iban реквизит* счет счёт счета карту карта"
DETAIL_NOUNS = "details instructions account"
BANK = "bank banking payment"
REFUSE = "reply respond answer отвеча* пиш*"
NOT = "not don't never не"
CALL = "call phone ring звон* перезвон*"
PACKED = "archive zip rar 7z file attachment архив* файл* вложен*"
PROTECTED = "protected encrypted защищ* запарол*"
CHATS = "telegram whatsapp viber signal телеграм* ватсап* вайбер*"
SHORT_MESSAGE = "sms смс"
CONTACT = "write message contact text пиш* напиш* свяж*"
FETCH = "download get open скача* загруз* откро*"
CLOUD = "yandex.disk yadi google drive dropbox onedrive яндекс.диск* яндекс диск* облак*"
SCAN = "scan scanning сканир* отсканир* навед*"
CODE = "qr qr-code qr-код*"
SHELLS = "powershell mshta certutil cmd bitsadmin"
# Hosts of link shorteners, of messengers and of file clouds, and schemes that start programs.
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "cutt.ly", "rebrand.ly", "clck.ru", "vk.cc", "u.to")
MESSENGERS = ("t.me", "telegram.me", "wa.me", "chat.whatsapp.com", "discord.gg")
CLOUDS = ("disk.yandex.ru", "disk.yandex.com", "yadi.sk", "cloud.mail.ru", "docs.google.com", "drive.google.com", "dropbox.com", "1drv.ms", "onedrive.live.com")
SCHEMES = ("search-ms", "ms-msdt", "ms-officecmd", "ms-appinstaller", "vbscript", "mhtml")
# Result headers that a body may imitate.
RESULT_HEADERS = ("authentication-results", "received-spf", "arc-authentication-results")

_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_SPACE = r"[^\p{L}\p{N}_]+"


def _any(words: str) -> str:
    """One of the words; a star stands for any ending."""
    out = []
    for w in words.split():
        plain = "".join(c if c.isalnum() else "[^\\p{L}\\p{N}]" if c in "-." else "\\" + c for c in w.rstrip("*"))
        out.append(plain + (r"\p{L}*" if w.endswith("*") else ""))
    return "(?:" + "|".join(out) + ")"


class Pattern(str):
    """A pattern, and words one of which a text must hold for it: searched for first, which is far cheaper."""

    needs: tuple[str, ...]

    def __new__(cls, text: str, needs: tuple[str, ...]) -> Pattern:
        out = super().__new__(cls, text)
        out.needs = needs
        return out


def _stems(words: str) -> tuple[str, ...]:
    """Of each word the longest run of letters that every form of it has."""
    return tuple(max("".join(c if c.isalnum() else " " for c in w).split(), key=len) for w in words.split())


def word(words: str) -> Pattern:
    return Pattern(_EDGE + _any(words) + _END, _stems(words))


def near(first: str, second: str, gap: int = 2, after: str = "") -> Pattern:
    """A word of the first group, at most gap words, a word of the second."""
    rarer = min(first, second, key=lambda w: len(w.split()))
    return Pattern(f"{_EDGE}{_any(first)}{_SPACE}(?:[\\p{{L}}\\p{{N}}_]+{_SPACE}){{0,{gap}}}{_any(second)}{_END}{after}", _stems(rarer))


def either(*patterns: Pattern) -> Pattern:
    return Pattern("|".join(patterns), tuple(dict.fromkeys(n for p in patterns for n in p.needs)))


def link_to(hosts: tuple[str, ...], optional_scheme: bool = False) -> Pattern:
    names = "|".join(h.replace(".", r"\.") for h in hosts)
    scheme = "(?:https?://)?" if optional_scheme else "https?://"
    return Pattern(rf"(?:^|[^a-z0-9.@_-]){scheme}(?:www\.)?(?:{names})/[^\s<>\"')\]]", tuple(h + "/" for h in hosts))


#: (kind, where, patterns, all of which must be found). Where: "text" is the visible text of both bodies, "raw" text or HTML source, "html" the source.
RULES: tuple[tuple[str, str, tuple[Pattern, ...]], ...] = (
    ("urgency", "text", (either(word(HURRY), near(SECRET, EXPIRE), near(ACCOUNT, BLOCKED), near(VERIFY, "identity личность")),)),
    ("credential_harvest", "text", (either(near(ASK, SECRET), near(VERIFY, ACCOUNT, 1)),)),
    ("bec_payment", "text", (either(near(TRANSFER, MONEY), near(ALTER, DETAILS), near(HURRY, TRANSFER, 1), near(HURRY, "оплат* pay payment", 1), near(BANK, DETAIL_NOUNS, 0, f".{{0,40}}{_any(ALTER)}"), near(ALTER, BANK, 1, _any(DETAIL_NOUNS))),)),
    ("payment_change", "text", (either(near(ALTER, DETAILS), near(ALTER, BANK, 1, _any(DETAIL_NOUNS))),)),
    ("bec_callback", "text", (near(NOT, REFUSE, 0), word(CALL))),
    ("clickfix", "text", (either(Pattern(r"(?:win|windows) ?\+ ?r" + _END, ("win",)), Pattern(word("run") + "dialog", ("dialog",)), near(SHELLS, "enc encodedcommand urlcache", 1), Pattern(rf"{_EDGE}mshta(?:\.exe)? ", ("mshta",))),)),
    ("archive_password", "text", (either(near(SECRET, PACKED, 2), near(PACKED, PROTECTED, 1), near(SECRET, PROTECTED, 0), Pattern(rf"{_EDGE}{_any(SECRET)} ?(?:is|:|=) ?\S", _stems(SECRET))),)),
    ("oob_delivery", "text", (either(near(SECRET, f"{CHATS} {SHORT_MESSAGE}", 2), near(FETCH, CHATS, 2)),)),
    ("qr_lure", "text", (either(near(SCAN, CODE, 2), Pattern(word(CODE) + "code", ("qr",)), near(CODE, "код code", 0)),)),
    ("messenger_lure", "text", (either(near(CONTACT, CHATS, 3), near(CHATS, "me us мне нам", 1), Pattern(rf"{_any(CHATS)}[^\n]{{0,40}}@[a-z][a-z0-9_.]{{2,}}", _stems(CHATS))),)),
    ("cloud_lure", "text", (either(link_to(CLOUDS), near(FETCH, CLOUD, 3)),)),
    ("url_shortener", "raw", (link_to(SHORTENERS),)),
    ("messenger_link", "raw", (link_to(MESSENGERS, True),)),
    ("url_userinfo", "raw", (Pattern(r"https?://[^\s/@<>\"']+\.[^\s/@<>\"']+@[^\s/<>\"']", ("://",)),)),
    ("dangerous_scheme", "raw", (Pattern(rf"(?:{'|'.join(SCHEMES)}) ?:|file ?://|href ?= ?[\"']?javascript:", (*SCHEMES, "file", "javascript:")),)),
    ("fake_auth_results", "raw", (Pattern(rf"(?:^|\n)[ \t]*(?:{'|'.join(RESULT_HEADERS)})[ \t]*:[ \t]*[^\s]", RESULT_HEADERS),)),
    ("hidden_style", "html", (Pattern(r"display ?: ?none|visibility ?: ?hidden|mso-hide ?: ?all|(?:font-size|opacity|max-height|max-width) ?: ?0(?:\.0+)?(?:px|pt|em)? ?(?:[;\"'}]|$)|left ?: ?-[0-9]{4}", (":",)),)),
    ("html_form", "html", (Pattern(r"<form[\s>]", ("<form",)),)),
    ("html_password_form", "html", (Pattern(r"<input[^>]*type ?= ?[\"']?password", ("<input",)),)),
    ("cid_image", "html", (Pattern(r"<img[^>]*src ?= ?[\"']?cid:", ("cid:",)),)),
)
IBAN = r"(?:^|[^A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?:$|[^A-Z0-9])"
CARD = r"(?:^|[^0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?:$|[^0-9])"
ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)[^>]*>(.*?)</a>"
HOST_LABEL = r"^(?:https?://)?(?:www\.)?((?:[a-z0-9-]+\.)+[a-z]{2,})(?:[/:?#]|$)"


def squeezed(c: Column) -> Column:
    """Lower case, with every blank run but line ends as one blank."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[ \t\x0B\f\r\x{A0}]+", " ")


def visible(html: Column) -> Column:
    """The text of a page that a reader sees: without scripts, styles, head, comments and tags."""
    body = html
    for tag in ("script", "style", "head", "title"):
        body = F.regexp_replace(body, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"(?i)<(?:br|/?p|/?div|/?tr|/?li|/?h[1-3])(?:\s[^>]*)?/?>", "\n")
    body = F.regexp_replace(body, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return body


def anchors(html: Column) -> Column:
    """array<struct(href, label)> of the links of a page."""
    parts = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("label"))
    return F.transform(parts, lambda a: F.struct(F.replace(a["href"], F.lit("&amp;"), F.lit("&")).alias("href"), F.trim(F.regexp_replace(a["label"], "<[^>]*>", "")).alias("label")))


def mismatched_links(html: Column) -> Column:
    """Links whose label looks like a host that isn't the target's."""
    shown = lambda a: F.regexp_extract(F.lower(a["label"]), HOST_LABEL, 1)
    real = lambda a: F.regexp_replace(tx.url_host(a["href"]), r"^www\.", "")
    return F.filter(anchors(html), lambda a: (shown(a) != "") & (real(a) != "") & ~tx.related(shown(a), real(a)))


def signals(df: DataFrame, row_id: str, text: str, html: str, kinds: list[str] | None = None) -> DataFrame:
    """(row_id, kind): each signal of a message once.

    Wording is looked for in the text and in what the page shows; markup in
    its source. payment_tokens needs a change of payment details beside an
    account or card number; messenger_only a messenger link and no other web
    link; image_only_body a picture and hardly a letter. Null texts and pages
    have no signal; both are read whole. Nothing leaves the JVM.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    rows = df.select(F.col(row_id), F.coalesce(F.col(text), F.lit("")).alias("__text"), page.alias("__page"))
    rows = rows.withColumn("__shown", F.when(F.col("__page") == "", "").otherwise(visible(F.col("__page"))))
    rows = rows.withColumn("__seen", squeezed(F.concat_ws("\n", "__text", "__shown"))).withColumn("__source", squeezed(F.col("__page"))).withColumn("__raw", squeezed(F.concat_ws("\n", "__text", "__page")))
    where = {"text": F.col("__seen"), "raw": F.col("__raw"), "html": F.col("__source")}
    hits: dict[str, Column] = {}
    for kind, place, patterns in RULES:
        hit = F.lit(True)
        for p in patterns:
            may = F.lit(False)
            for n in p.needs:
                may = may | where[place].contains(n)
            hit = hit & may & where[place].rlike(str(p))
        hits[kind] = hit
    both = F.concat_ws("\n", "__text", "__shown")
    links = F.regexp_extract_all(F.col("__raw"), F.lit(r"https?://(?:www\.)?([^\s/:?#\"'<>)\]]+)"), F.lit(1))
    letters = F.length(F.regexp_replace("__shown", r"[^\p{L}]", ""))
    picture = F.col("__source").rlike(r"<img[\s/]")
    hits["payment_tokens"] = hits["payment_change"] & (both.rlike(IBAN) | both.rlike(CARD))
    hits["messenger_only"] = hits["messenger_link"] & ~F.exists(links, lambda h: ~h.isin(*MESSENGERS, *SHORTENERS))
    hits["href_mismatch"] = F.size(mismatched_links(F.col("__page"))) > 0
    hits["cid_phishing"] = hits["cid_image"] & (F.size(links) > 0) & (letters <= 40)
    hits["image_only_body"] = picture & ~hits["cid_phishing"] & (F.trim("__text") == "") & (letters <= 40)
    wanted = [k for k in hits if kinds is None or k in kinds]
    return rows.select(F.col(row_id), F.explode(F.array_compact(F.array(*[F.when(hits[k], F.lit(k)) for k in wanted]))).alias("kind"))


def _severity(protocol: str) -> Column:
    value = F.lower(F.trim(F.col(protocol)))
    failed = "critical" if protocol == "dmarc" else "high"
    return F.when(value == "fail", failed).when(value.isin("softfail", "permerror", "temperror"), "medium").when(value == "none", "low").when(value == "pass", "info")


def header_findings(df: DataFrame, row_id: str) -> DataFrame:
    """(row_id, finding, severity) of identity rows: from_header, reply_to, return_path, subject,
    message_id, in_reply_to, references_hdr, list_id, spf, dkim, dmarc, received_hops.
    A null header is an absent one.
    """
    domain = lambda c: F.coalesce(F.regexp_extract(F.lower(F.col(c)), r"@([^@>\s()]+)", 1), F.lit(""))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    sender = domain("from_header")
    apart = lambda c: (domain(c) != "") & (sender != "") & ~tx.related(sender, domain(c))
    reply = F.regexp_replace(F.trim(F.coalesce("subject", F.lit(""))), rf"(?iu)^(?:{tx.GATEWAY_TAG})*", "").rlike(rf"(?iu)^{tx.ANSWER_TAG}")
    findings = {
        "reply_to_mismatch": F.when(apart("reply_to"), "high"),
        "return_path_mismatch": F.when(apart("return_path"), "medium"),
        "orphan_reply": F.when(reply & blank("in_reply_to") & blank("references_hdr"), "high"),
        "reply_chain_anomaly": F.when(apart("in_reply_to") | apart("references_hdr"), "high"),
        "message_id_domain": F.when(apart("message_id"), "low"),
        "no_received": F.when(F.coalesce(F.col("received_hops"), F.lit(0)) == 0, "medium"),
        "one_received": F.when(F.col("received_hops") == 1, "medium"),
        "no_auth_results": F.when(blank("spf") & blank("dkim") & blank("dmarc"), "low"),
        **{p: _severity(p) for p in ("spf", "dkim", "dmarc")},
    }
    each = F.array(*[F.struct(F.lit(n).alias("finding"), s.alias("severity")) for n, s in findings.items()])
    return df.select(F.col(row_id), F.explode(each).alias("f")).select(row_id, "f.finding", "f.severity").where("severity is not null")

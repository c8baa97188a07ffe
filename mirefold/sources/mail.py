"""Messages as files: parsed once, in Arrow batches, into plain tables."""

from __future__ import annotations

import email
import email.policy
import hashlib
import re
from collections.abc import Iterator
from email.header import decode_header, make_header
from email.message import Message
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirefold.sources.attachments import inspect

MOST_BYTES, MOST_TEXT = 40 << 20, 2_000_000
SUFFIXES = ("eml", "msg", "mbox", "pst")
#: Mails within mails that are read; deeper ones leave an error.
MOST_DEPTH = 2

HEADER = T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
ATTACHMENT = T.ArrayType(
    T.StructType(
        [T.StructField("ord", T.IntegerType()), T.StructField("filename", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mime", T.StringType())]
        + [T.StructField(n, T.StringType()) for n in ("md5", "sha1", "sha256")]
        + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("flags", "entries", "targets")]
        + [T.StructField("text", T.StringType())]
    )
)
PARSED = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("source_sha256", T.StringType()), T.StructField("headers", HEADER), T.StructField("text", T.StringType()), T.StructField("html", T.StringType()), T.StructField("attachments", ATTACHMENT), T.StructField("errors", T.ArrayType(T.StringType()))]
)


class _Visible(HTMLParser):
    """The text a reader sees, with the targets of links after it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.hidden = 0
        self.link: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style", "head", "title"):
            self.hidden += 1
        elif tag in ("br", "p", "div", "tr", "li", "h1", "h2", "h3"):
            self.parts.append("\n")
        if tag == "a" and (href := dict(attrs).get("href")):
            self.link = [href]

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head", "title") and self.hidden:
            self.hidden -= 1
        if tag in ("p", "div", "tr", "li", "h1", "h2", "h3"):
            self.parts.append("\n")
        if tag == "a" and self.link:
            self.links.append((self.link[0], "".join(self.link[1:]).strip()))
            self.link = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.link is not None:
                self.link.append(data)


def html_text(html: str) -> tuple[str, list[tuple[str, str]]]:
    """The visible text of a page and its links (target, label)."""
    page = _Visible()
    try:
        page.feed(html)
        page.close()
    except (ValueError, AssertionError):
        pass
    text = re.sub(r"[ \t]+", " ", "".join(page.parts))
    return re.sub(r"\s*\n\s*", "\n", text).strip(), page.links


# Encodings of one byte a character for Cyrillic, and those that read any byte, so that a declared one proves little.
CYRILLIC = ("cp1251", "koi8-r", "iso-8859-5", "cp866", "koi8-u", "mac-cyrillic")
PERMISSIVE = ("latin-1", "iso-8859-1", "us-ascii", "cp1252", "windows-1252", "cp1251", "windows-1251", "koi8-r", "koi8-u", "mac-cyrillic")


def _cyrillic_score(text: str) -> float:
    """How much a text looks like Cyrillic prose: lower-case letters, capitals only at the start of words, few other signs."""
    score, before = 0, " "
    for c in text:
        if "а" <= c <= "я" or c == "ё":
            score += 2
        elif "А" <= c <= "Я" or c == "Ё":
            score += 1 if not before.isalpha() else -1 if before.isupper() else -3
        elif c > "\x7f":
            score -= 3
        if c.isalpha() and before.isalpha() and c.isascii() != before.isascii():
            score -= 4  # letters of two scripts in one word
        before = c
    return score / max(1, sum(c > "\x7f" for c in text))


def decoded(raw: bytes, charset: str | None) -> str:
    """A part's text: UTF-8 where it is well-formed, else its own charset
    unless that reads any byte; then the Cyrillic encodings compete with it.
    """
    name = {"windows-1251": "cp1251", "koi8": "koi8-r"}.get((charset or "").lower(), (charset or "").lower())
    if name in ("", "utf-8", "utf8", *PERMISSIVE):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            pass
    else:
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            pass
    own = name if name in CYRILLIC else "cp1252"
    best = raw.decode(own, "replace")
    most = _cyrillic_score(best) + 0.1 if own in CYRILLIC else 1.2  # Western text must be beaten clearly
    for codec in CYRILLIC:
        text = raw.decode(codec, "replace")
        if (score := _cyrillic_score(text)) > most:
            best, most = text, score
    return best


def _attachments(out: dict, name: str, data: bytes, depth: int = 0) -> None:
    """A row for a file, and for the files that it holds openly."""
    f = inspect(name, data)
    out["attachments"].append(
        {
            "ord": len(out["attachments"]), "filename": name, "size": len(data), "mime": f.mime, "md5": hashlib.md5(data).hexdigest(), "sha1": hashlib.sha1(data).hexdigest(), "sha256": hashlib.sha256(data).hexdigest(),
            "flags": list(f.flags), "entries": list(f.entries), "targets": list(f.targets), "text": f.text,
        }
    )
    for inner, body in f.inner if depth < MOST_DEPTH else ():
        _attachments(out, inner, body, depth + 1)


def _tidy(raw: bytes) -> bytes:
    """Without byte-order marks, blank lines and the banner of a forwarding program before the first header; UTF-16 as UTF-8."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raw = raw.decode("utf-16", "replace").encode("utf-8")
    raw = raw.removeprefix(b"\xef\xbb\xbf").lstrip(b"\r\n \t")
    first, _, rest = raw.partition(b"\n")
    banner = re.fullmatch(rb"-{2,}.*-{2,}|[^:]* [^:]*:", first.strip())
    return rest.lstrip(b"\r\n") if banner and re.match(rb"\s*[A-Za-z-]+:", rest) else raw


def message_shaped(text: Column) -> Column:
    """Whether a pasted text has the header lines of a message: From, and Subject, Message-ID, Received or Date."""
    has = lambda names: text.rlike(rf"(?im)^(?:{names})\s*:")
    return F.coalesce(has("from") & has("subject|message-id|received|date"), F.lit(False))


def header_text(value: str) -> str:
    """A header's value on one line, encoded words decoded; raw bytes are read as UTF-8."""
    value = re.sub(r"\r?\n(?=[ \t])", "", value).strip()
    if not value.isascii():
        value = value.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    if "=?" in value:
        try:
            value = str(make_header(decode_header(value)))
        except (LookupError, ValueError):  # an unknown charset: the words stay encoded
            pass
    return value


def parse_message(path: str, raw: bytes) -> dict:
    """One message: headers in order, text, HTML and attachments, mails inside mails to depth 2."""
    out: dict = {"path": path, "kind": "email", "source_sha256": hashlib.sha256(raw).hexdigest(), "headers": [], "text": "", "html": "", "attachments": [], "errors": []}
    message = email.message_from_bytes(_tidy(raw), policy=email.policy.compat32)
    for i, (name, value) in enumerate(message.raw_items()):
        out["headers"].append({"ord": i, "name": name, "value": header_text(str(value))})
    texts, pages = [], []

    def walk(part: Message, depth: int) -> None:
        kind, name = part.get_content_type(), part.get_filename() or ""
        if kind == "message/rfc822":
            inner = part.get_payload()
            for m in inner if isinstance(inner, list) else [inner]:
                if not isinstance(m, Message):
                    continue
                if depth >= MOST_DEPTH:
                    out["errors"].append(f"a mail nested deeper than {MOST_DEPTH} was not read")
                    continue
                texts.append("\n".join(f"{h}: {header_text(str(m[h]))}" for h in ("From", "To", "Subject") if m[h]))
                walk(m, depth + 1)
            return
        if part.is_multipart():
            for inner in part.get_payload():
                walk(inner, depth)
            return
        data = part.get_payload(decode=True) or b""
        attached = part.get_content_disposition() == "attachment" or name
        if not attached and kind in ("text/plain", "message/delivery-status"):
            texts.append(decoded(data, part.get_content_charset()))
        elif not attached and kind == "text/html":
            pages.append(decoded(data, part.get_content_charset()))
        elif data or name:
            _attachments(out, name or f"part.{kind.rpartition('/')[2]}", data)

    try:
        walk(message, 0)
    except Exception as e:  # noqa: BLE001  a broken message is a row with an error, not a failed job
        out["errors"].append(f"parse: {type(e).__name__}")
    out["text"], out["html"] = "\n".join(texts), "\n".join(pages)
    if not out["text"] and out["html"]:
        visible, links = html_text(out["html"])
        out["text"] = visible + ("\nURLs:\n" + "\n".join(dict.fromkeys(h for h, _ in links)) if links else "")
    for field in ("text", "html"):
        if len(out[field]) > MOST_TEXT:
            out[field] = out[field][:MOST_TEXT]
            out["errors"].append(f"{field} clipped")
    return out


def split_mailbox(raw: bytes, most: int) -> tuple[list[bytes], int]:
    """The messages of an mbox file up to `most`, and how many it has. A file without a "From " line is one message."""
    marks = list(re.finditer(rb"(?m)^From [^\r\n]*\r?\n", raw))
    if not marks:
        return ([raw] if raw.strip() else []), int(bool(raw.strip()))
    ends = [m.start() for m in marks[1:]] + [len(raw)]
    parts = [raw[m.end() : b] for m, b in zip(marks[:most], ends, strict=False)]
    return [re.sub(rb"(?m)^>(>*From )", rb"\1", p) for p in parts], len(marks)


def _without_content(path: str | None, raw: bytes, error: str) -> dict:
    return {"path": path, "kind": "unknown", "source_sha256": hashlib.sha256(raw).hexdigest() if raw else None, "headers": [], "text": "", "html": "", "attachments": [], "errors": [error]}


def parse_files(files: DataFrame, mailbox_limit: int = 500) -> DataFrame:
    """Messages of files(path, content[, length]): .eml, and each message of an .mbox up to the limit.

    Files over 40 MB (by `length` where their content was left out), .msg and
    .pst (whose readers are optional libraries), unknown suffixes and empty
    files give one row of kind unknown with an error; so does what a mailbox
    holds beyond the limit. A message that can't be read is a row with an
    error, never a failed job.
    """
    if "length" not in files.columns:
        files = files.withColumn("length", F.octet_length("content").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(PARSED)
        for b in batches:
            rows = []
            for path, content, size in zip(*(b.column(c).to_pylist() for c in ("path", "content", "length")), strict=True):
                raw, suffix = content or b"", (path or "").lower().rpartition(".")[2]
                error = "too large" if (size or 0) > MOST_BYTES else "" if suffix in ("eml", "mbox") else "no reader for this type" if suffix in SUFFIXES else "unknown type"
                if not error and not raw.strip():
                    error = "empty"
                if error:
                    rows.append(_without_content(path, raw, error))
                elif suffix == "mbox":
                    parts, total = split_mailbox(raw, mailbox_limit)
                    rows += [parse_message(f"{path}#{i}", part) for i, part in enumerate(parts)]
                    if total > len(parts):
                        rows.append(_without_content(path, b"", f"{total - len(parts)} of {total} messages are beyond the limit"))
                else:
                    rows.append(parse_message(path, raw))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content", "length").mapInArrow(run, PARSED)


def parse_pasted(texts: DataFrame, path: str, text: str) -> DataFrame:
    """Messages that were pasted as text; what has no header lines of a message gives a row with an error."""
    shaped = message_shaped(F.col(text))
    name = F.concat(F.col(path), F.lit(".eml")).alias("path")
    good = parse_files(texts.where(shaped).select(name, F.encode(text, "UTF-8").alias("content")))
    empty = {f.name: F.array().cast(f.dataType) if isinstance(f.dataType, T.ArrayType) else F.lit("") for f in PARSED.fields}
    bad = texts.where(~shaped).select(name, F.lit("unknown").alias("kind"), *[empty[n].alias(n) for n in ("source_sha256", "headers", "text", "html", "attachments")], F.array(F.lit("not a message")).alias("errors"))
    return good.unionByName(bad)


def read_folder(spark: SparkSession, folder: str, mailbox_limit: int = 500) -> DataFrame:
    """All messages under a folder; the content of files over 40 MB isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(folder)
    small = files.where(F.col("length") <= MOST_BYTES).select("path", "content", "length")
    large = files.where(F.col("length") > MOST_BYTES).select("path", F.lit(None).cast("binary").alias("content"), "length")
    return parse_files(small.unionByName(large), mailbox_limit)


def pages(df: DataFrame, row_id: str, html: str) -> DataFrame:
    """(row_id, visible, links): what each page shows, and the targets and labels of its links. Null pages give no row."""
    key = df.schema[row_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("target", pa.string()), ("label", pa.string())]))
        for b in batches:
            read = [html_text(h) for h in b.column(1).to_pylist()]
            links = [[{"target": t, "label": x} for t, x in found] for _, found in read]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in read], pa.string()), pa.array(links, kind)], names=[row_id, "visible", "links"])

    return df.where(F.col(html).isNotNull()).select(row_id, html).mapInArrow(run, f"`{row_id}` {key}, visible string, links array<struct<target:string,label:string>>")


def header(name: str) -> Column:
    """The first value of a header, null where it is absent."""
    return F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def auth_results(parsed: DataFrame) -> DataFrame:
    """parsed with spf, dkim and dmarc: of all results of a protocol the worst, else pass, else the first."""
    lines = F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == "authentication-results"), lambda h: F.lower(h["value"]))
    out = parsed
    for protocol in ("spf", "dkim", "dmarc"):
        said = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(rf"{protocol}\s*=\s*([a-z]+)"), F.lit(1))))  # noqa: B023
        if protocol == "spf":
            received = F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == "received-spf"), lambda h: F.regexp_extract(F.lower(h["value"]), r"^\s*([a-z]+)", 1))
            said = F.concat(said, F.filter(received, lambda x: x != ""))
        worst = F.coalesce(*[F.when(F.array_contains(said, s), s) for s in ("fail", "softfail", "permerror", "temperror", "pass")], F.get(said, F.lit(0)))
        out = out.withColumn(protocol, worst)
    return out


def composed(mail: DataFrame) -> DataFrame:
    """(path, content): rows of mail (path, sender, recipients, subject, message_id, date, in_reply_to, text) as RFC 822 files."""
    field = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ": "), F.regexp_replace(c, r"\s*[\r\n]+\s*", " "), F.lit("\r\n"))).otherwise("")
    head = F.concat(field("From", F.col("sender")), field("To", F.array_join("recipients", ", ")), field("Subject", F.col("subject")), field("Message-ID", F.col("message_id")), field("Date", F.col("date")), field("In-Reply-To", F.col("in_reply_to")))
    body = F.concat(head, F.lit("MIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    return mail.select("path", F.encode(body, "UTF-8").alias("content"))

"""What the bytes of an attachment give away, without unpacking or running anything.

Each kind of file has a small scanner that gives flags, the names of members,
targets (addresses and paths that the file leads to) and text. A scanner that
fails leaves a flag behind and never fails the job.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

# Suffixes by kind.
DANGEROUS = ("exe", "dll", "scr", "bat", "cmd", "ps1", "vbs", "vbe", "js", "jse", "wsf", "wsh", "hta", "cpl", "msi", "msp", "com", "pif", "jar", "iso", "img", "lnk", "reg", "scf", "chm", "one", "onepkg")
SHOWN, HIDDEN = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "jpg", "png", "gif"), ("exe", "scr", "bat", "cmd", "js", "vbs", "ps1", "jar")
ARCHIVES = ("zip", "rar", "7z", "gz", "tar", "cab", "iso")
OFFICE_OLD, OFFICE_ZIP, OFFICE_MACRO = ("doc", "docm", "xls", "xlsm", "ppt", "pptm", "rtf"), ("docx", "xlsx", "pptx", "docm", "xlsm", "pptm"), ("docm", "xlsm", "pptm")
IMAGES, MAILS, PAGES = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff"), ("eml", "msg"), ("html", "htm", "shtml", "xhtml", "mht", "mhtml", "svg")
SCRIPTS, DISKS = ("js", "jse", "vbs", "vbe", "wsf", "wsh", "hta", "ps1", "bat", "cmd"), ("vhd", "vhdx", "wim", "esd")
SHORTCUTS = ("settingcontent-ms", "searchconnector-ms", "library-ms", "appref-ms", "diagcab", "iqy", "slk", "url", "scf", "chm")
SUSPICIOUS_ZONES = (".xyz", ".top", ".club", ".gq", ".tk", ".ml", ".cf", ".ga", ".zip", ".mov", ".cfd", ".sbs", ".click", ".bond", ".ru.com")
# Programs and calls that run other programs.
RUNNERS = ("powershell", "pwsh", "wscript", "cscript", "mshta", "cmd.exe", "rundll32", "certutil", "bitsadmin", "msiexec", "regsvr32", "forfiles", "conhost", "finger")
SMUGGLING = ("data:text/html", "atob(", "blob(", "mssaveoropenblob", "activexobject", "fromcharcode", "unescape(", "download=")
FORMULAS = ("ddeauto", "dde(", "cmd|", "msexcel|", "shell(", "powershell", "mshta.exe")
MACRO_STARTS = ("AutoOpen", "Auto_Open", "AutoExec", "Auto_Exec", "Document_Open", "Workbook_Open", "Workbook_Activate", "URLDownloadToFile", "WScript.Shell", "Shell.Application", "MSXML2.XMLHTTP", "WinHttp.WinHttpRequest", "ADODB.Stream")
# The first bytes of file types, and types by suffix.
MAGIC = ((b"%PDF", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"\xd0\xcf\x11\xe0", "application/x-ole-storage"), (b"MZ", "application/x-msdownload"), (b"Rar!", "application/vnd.rar"), (b"7z\xbc\xaf'\x1c", "application/x-7z-compressed"), (b"\x89PNG", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"{\\rtf", "application/rtf"), (b"MSCF", "application/vnd.ms-cab-compressed"), (b"\x78\x9f\x3e\x22", "application/ms-tnef"), (b"L\0\0\0\x01\x14\x02\0", "application/x-ms-shortcut"))
BY_SUFFIX = {"eml": "message/rfc822", "msg": "application/vnd.ms-outlook", "html": "text/html", "htm": "text/html", "svg": "image/svg+xml", "mht": "multipart/related", "ics": "text/calendar", "txt": "text/plain", "csv": "text/csv", "json": "application/json", "xml": "application/xml"}
MOST_ENTRIES, MOST_PARTS, BOMB = 200, 40, 80 << 20
DOUBLE = re.compile(rf"\.(?:{'|'.join(SHOWN)})\.(?:{'|'.join(HIDDEN)})$", re.IGNORECASE)
_ADDRESS = r"(?:https?://|file://|search-ms:|ms-msdt:|\\\\)[^\s\"'<>\x00]{3,}"


class Found:
    """What a file gave: flags and names in the order of their discovery, each once."""

    def __init__(self, name: str, data: bytes) -> None:
        self.name, self.data, self.low = name.lower(), data, data.lower()
        self.suffix = self.name.rpartition(".")[2] if "." in self.name else ""
        self.flags: dict[str, None] = {}
        self.entries: dict[str, None] = {}
        self.targets: dict[str, None] = {}
        self.text = ""
        self.inner: list[tuple[str, bytes]] = []  # files inside that are inspected themselves
        self.mime = next((m for start, m in MAGIC if data.startswith(start)), BY_SUFFIX.get(self.suffix, "application/octet-stream"))

    def flag(self, *names: str) -> None:
        self.flags.update(dict.fromkeys(names))

    def holds(self, *marks: str) -> bool:
        return any(m.lower().encode() in self.low for m in marks)


def texts_of(data: bytes) -> list[str]:
    """A file's bytes as text in each width of characters that programs write."""
    return [data.decode("latin-1"), data.decode("utf-16-le", "ignore"), data[1:].decode("utf-16-le", "ignore")]


def names_in(data: bytes) -> list[str]:
    """Names with a known suffix that stand in the bytes of a container."""
    known = "|".join(dict.fromkeys((*DANGEROUS, *SHOWN, *ARCHIVES, *MAILS, *SHORTCUTS, "sys", "html", "htm")))
    pattern = re.compile(rf"[\w.\- ]{{2,80}}\.(?:{known})(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
    return list(dict.fromkeys(m.strip() for t in texts_of(data) for m in pattern.findall(t)))


def members(f: Found, names: list[str], prefix: str) -> None:
    """Flags for the names inside a container."""
    low = [n.replace("\\", "/").rpartition("/")[2].lower() for n in names]
    ends = lambda *suffixes: any(n.rpartition(".")[2] in suffixes for n in low if "." in n)
    f.entries.update(dict.fromkeys(names[:MOST_ENTRIES]))
    if len(names) > MOST_ENTRIES:
        f.flag("entries_cut")
    for flag, hit in ((f"{prefix}_double_extension", any(DOUBLE.search(n) for n in low)), (f"{prefix}_dangerous_member", ends(*DANGEROUS)), (f"{prefix}_nested_email", ends(*MAILS))):
        if hit:
            f.flag(flag)


def scan_zip(f: Found) -> None:
    """The directory of a ZIP; members of Office files that hold relations, formulas and macros are read."""
    try:
        with zipfile.ZipFile(io.BytesIO(f.data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            names = [i.filename for i in infos]
            if any(i.flag_bits & 1 for i in infos):
                f.flag("encrypted_archive")
            if sum(i.file_size for i in infos) > BOMB:
                f.flag("zip_bomb_suspect")
                f.entries.update(dict.fromkeys(names[:MOST_ENTRIES]))
                return
            members(f, names, "archive")
            low = [n.replace("\\", "/").lower() for n in names]
            if any("macrosheets" in n for n in low):
                f.flag("office_xlm")
            if any(n.endswith("vbaproject.bin") for n in low):
                f.flag("ooxml_vba")
            if any(n.rpartition(".")[2] in ARCHIVES for n in low if "." in n):
                f.flag("nested_archive")
            if "[content_types].xml" in low or f.suffix in OFFICE_ZIP:
                scan_office(f, z, infos)
    except (zipfile.BadZipFile, OSError, ValueError, RuntimeError, NotImplementedError, EOFError, struct.error):
        f.flag("broken_archive")
        if f.holds("encrypt"):
            f.flag("encrypted_archive")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _tree(raw: bytes) -> ElementTree.Element | None:
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:  # no entities are expanded
        return None
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return None


def scan_office(f: Found, z: zipfile.ZipFile, infos: list[zipfile.ZipInfo]) -> None:
    """Text, external targets, remote templates, formulas that fetch or run, and macros of an Office file."""
    shared: list[str] = []
    lines: list[str] = []
    for info in sorted(infos, key=lambda i: (i.filename != "xl/sharedStrings.xml", [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", i.filename)])):
        low = info.filename.replace("\\", "/").lower()
        if info.flag_bits & 1 or not low.endswith((".xml", ".rels", "vbaproject.bin")):
            continue
        raw = z.read(info)
        squeezed = re.sub(rb"\s+", b"", raw.lower())
        if low.endswith("vbaproject.bin"):
            if _macro_runs(raw):
                f.flag("office_vba_live")
            continue
        if "externallinks/" in low or (low.endswith("connections.xml") and re.search(rb"https?://|\\\\", raw.lower())) or (low.startswith("xl/") and re.search(rb"webservice\(|hyperlink\([\"']?(?:&quot;)?https?://", squeezed)):
            f.flag("office_external_data")
        if (low.startswith(("xl/worksheets/", "word/")) or "sharedstrings" in low or "workbook" in low) and any(m.encode() in squeezed for m in FORMULAS):
            f.flag("office_dde")
        root = _tree(raw)
        if root is None:
            continue
        if low.endswith(".rels"):
            for e in root.iter():
                target, kind = e.get("Target", ""), e.get("Type", "").lower()
                web = target.lower().startswith(("http://", "https://"))
                if _local(e.tag) == "Relationship" and target and (e.get("TargetMode", "").lower() == "external" or web):
                    f.targets[target] = None
                    if web and ("settings.xml.rels" in low or any(k in kind for k in ("template", "oleobject", "subdocument"))):
                        f.flag("office_remote_template")
                    elif web:
                        f.flag("office_hyperlink")
        elif low == "xl/sharedstrings.xml":
            shared = ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in root.iter() if _local(s.tag) == "si"]
        elif low.startswith("xl/worksheets/"):
            for c in root.iter():
                if _local(c.tag) == "c":
                    value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                    if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    if value:
                        lines.append(value)
        elif low.startswith(("word/document", "word/header", "word/footer", "word/footnotes", "ppt/slides/slide", "ppt/notesslides/")):
            for p in root.iter():
                if _local(p.tag) == "p":
                    lines.append("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t"))
    f.text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", "\n".join(x for x in lines if x))


def _macro_runs(raw: bytes) -> bool:
    """Whether a macro project names an automatic start, a download or a call of a program, in either width of characters."""
    texts = [t.lower() for t in texts_of(raw)]
    return any(m.lower() in t for m in MACRO_STARTS for t in texts) or any(re.search(r"(?<![a-z0-9_])shell\s*\(", t) for t in texts)


def scan_names(f: Found, kind: str, prefix: str) -> None:
    """Containers whose directory isn't read: names by their suffixes."""
    names = names_in(f.data)
    f.flag(*kind.split())
    members(f, names, "archive")
    ends = lambda *suffixes: any(n.lower().rpartition(".")[2] in suffixes for n in names)
    if not names:
        f.flag("archive_unlisted")
    for flag, suffixes in ((f"{prefix}_contains_lnk", ("lnk",)), (f"{prefix}_contains_exe", ("exe", "dll", "scr")), (f"{prefix}_contains_script", SCRIPTS)):
        if ends(*suffixes):
            f.flag(flag)


def scan_rar(f: Found) -> None:
    scan_names(f, "archive rar_archive", "rar")
    if b"encrypted" in f.low[:4096]:
        f.flag("encrypted_archive")


def scan_script(f: Found) -> None:
    f.flag("script_attachment")
    found = [m for t in texts_of(f.data) for m in re.findall(_ADDRESS, t)]
    f.targets.update(dict.fromkeys(found))
    if found:
        f.flag("script_url")
    if f.holds(*RUNNERS, "createobject", "frombase64string", "eval("):
        f.flag("script_runner")


def scan_link(f: Found) -> None:
    f.flag("shortcut_lnk")
    if f.data[:4] != b"L\0\0\0":
        return
    found = [m.strip(" \t\"'") for t in texts_of(f.data) for m in re.findall(rf"(?i)(?:[A-Za-z]:\\|\\\\|https?://|file://)[^\x00\r\n]{{4,240}}", t)]
    f.targets.update(dict.fromkeys(found))
    joined = "\n".join(found).lower()
    if found:
        f.flag("lnk_target")
    if any(r in joined for r in RUNNERS):
        f.flag("lnk_dangerous")
    if re.search(r"https?://|file://|\\\\", joined):
        f.flag("lnk_http_target")


def scan_shortcut(f: Found) -> None:
    f.flag("lure_shortcut")
    text = "\n".join(texts_of(f.data))
    named = re.findall(r"(?im)^\s*(?:URL|IconFile|DeepLink)\s*=\s*(\S+)", text)
    f.targets.update(dict.fromkeys([*named, *(m.rstrip(").,;]") for m in re.findall(f"(?i){_ADDRESS}", text))]))
    if f.targets:
        f.flag("lure_shortcut_target")


def scan_pdf(f: Found) -> None:
    f.flag("pdf_attachment")
    key = lambda *names: re.search(rb"/(?:" + b"|".join(n.encode() for n in names) + rb")(?![A-Za-z])", f.data)
    address = re.search(rb"/URI\s*\(", f.data)
    for flag, hit in (("pdf_javascript", key("JavaScript", "JS", "OpenAction", "AA")), ("pdf_launch", key("Launch")), ("pdf_submitform", key("SubmitForm")), ("pdf_gotor", key("GoToR")), ("pdf_uri_action", address), ("pdf_openaction_uri", key("OpenAction") and address)):
        if hit:
            f.flag(flag)
    f.targets.update(dict.fromkeys(m.decode("latin-1") for m in re.findall(rb"/URI\s*\(([^()]*)\)", f.data)))


def scan_rtf(f: Found) -> None:
    update, equation = b"\\objupdate" in f.low, b"equation.3" in f.low or b"equation.2" in f.low
    object_ = b"\\objdata" in f.low and (update or equation or b"package" in f.low)
    for flag, hit in (("rtf_objupdate", update), ("rtf_equation", equation), ("rtf_ole", object_), ("rtf_exploit", update or equation or object_)):
        if hit:
            f.flag(flag)


class _Page(HTMLParser):
    """Visible text, targets of links and actions of forms."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.actions, self.hidden = [], [], [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        self.hidden += tag in ("script", "style")
        self.parts.append("\n" if tag in ("p", "div", "tr", "li", "br") else "")
        if tag == "form" and a.get("action"):
            self.actions.append(a["action"])
        if link := a.get("href") or a.get("xlink:href"):
            self.links.append(link)

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        self.parts.append("\n" if tag in ("p", "div", "tr", "li") else "")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def suspicious_action(action: str) -> bool:
    """A form that sends to a bare IPv4 address or to an often abused zone."""
    host = action.strip().lower().rpartition("://")[2].partition("/")[0].partition("?")[0].rpartition("@")[2].strip("[]")
    return bool(re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", host)) or host.endswith(SUSPICIOUS_ZONES)


def scan_page(f: Found) -> None:
    kind = "svg" if f.suffix == "svg" or b"<svg" in f.low[:4096] else "mht" if f.suffix in ("mht", "mhtml") else "html"
    f.flag(f"{kind}_attachment")
    page = _Page()
    try:
        page.feed(f.data.decode("utf-8", "replace"))
        page.close()
    except (ValueError, AssertionError):
        f.flag("broken_page")
    f.text = re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t]+", " ", "".join(page.parts))).strip()
    f.targets.update(dict.fromkeys(page.links))
    if any(m.encode() in re.sub(rb"\s+", b"", f.low) for m in SMUGGLING) or re.search(rb"data:(?:application|text)[^,]{0,80},[a-z0-9+/=]{800}", f.low):
        f.flag("html_smuggling")
    if kind == "svg" and (b"<script" in f.low or b"onload=" in f.low):
        f.flag("svg_script")
    if any(suspicious_action(a) for a in page.actions):
        f.flag("html_form_action")


def polyglot(f: Found) -> bool:
    """A page whose first 8 KB hold another file's magic, too."""
    head = f.low[:8192]
    return bool(re.search(rb"<!doctype\s+html|<(?:html|head|body)[\s>]", head[:512])) and (b"pk\x03\x04" in head[32:] or b"%pdf" in head[32:])


def scan_ole(f: Found) -> None:
    f.flag("ole_compound")
    wide = lambda m: m.lower().encode() in f.low or m.encode("utf-16-le") in f.data
    for flag, marks in (("office_xlm", ("Excel 4.0",)), ("ole_package", ("Ole10Native",)), ("ole_macros_suspected", ("VBA", "Macros")), ("office_encrypted", ("EncryptionInfo", "EncryptedPackage"))):
        if any(wide(m) for m in marks):
            f.flag(flag)
    if "ole_macros_suspected" in f.flags and _macro_runs(f.data):
        f.flag("office_vba_live")


def scan_tnef(f: Found) -> None:
    """Attachments in a winmail.dat: attributes of level, identifier, size, data and checksum, one after the other."""
    f.flag("tnef_attachment")
    at, name = 6, "winmail_part.bin"
    while at + 9 <= len(f.data) and len(f.inner) < MOST_PARTS:
        kind, size = struct.unpack_from("<II", f.data, at + 1)
        body = f.data[at + 9 : at + 9 + size]
        at += 9 + size + 2
        if len(body) < size:
            f.flag("tnef_broken")
            break
        if kind & 0xFFFF == 0x8010:  # the title
            name = body.split(b"\0", 1)[0].decode("latin-1").replace("\\", "/").rpartition("/")[2] or name
        elif kind & 0xFFFF == 0x800F and body:  # the data
            f.inner.append((name, body))
            name = "winmail_part.bin"
    f.entries.update(dict.fromkeys(n for n, _ in f.inner))


def scan_onenote(f: Found) -> None:
    f.flag("onenote_attachment")
    if f.holds("FileData", "embeddedFile", "OneNote.Package", "ONEDOC", "Embedded File Object"):
        f.flag("onenote_embedded_file")


#: (who is scanned, the scanner), in order.
SCANNERS: tuple[tuple[Callable[[Found], bool], Callable[[Found], None]], ...] = (
    (lambda f: f.name.endswith(tuple("." + s for s in SHORTCUTS)), scan_shortcut),
    (lambda f: f.suffix == "rtf" or f.low.startswith(b"{\\rtf"), scan_rtf),
    (lambda f: f.suffix in ("iso", "img"), lambda f: scan_names(f, "iso_image", "iso")),
    (lambda f: f.suffix in DISKS, lambda f: scan_names(f, "disk_image", "disk")),
    (lambda f: f.suffix in SCRIPTS, scan_script),
    (lambda f: f.suffix == "lnk", scan_link),
    (lambda f: f.suffix == "cab" or f.data.startswith(b"MSCF"), lambda f: scan_names(f, "archive cab_archive", "cab")),
    (lambda f: f.suffix in ("one", "onepkg"), scan_onenote),
    (lambda f: f.suffix in PAGES or b"<html" in f.low[:4096] or b"<svg" in f.low[:4096], scan_page),
    (lambda f: f.suffix == "pdf" or f.data.startswith(b"%PDF"), scan_pdf),
    (lambda f: f.data.startswith(b"\x78\x9f\x3e\x22"), scan_tnef),
    (lambda f: f.data.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), scan_ole),
    (lambda f: f.data.startswith(b"PK"), scan_zip),
    (lambda f: f.suffix == "7z" or f.data.startswith(b"7z\xbc\xaf'\x1c"), lambda f: f.flag("archive", "seven_zip", "archive_unlisted")),
    (lambda f: f.suffix == "rar" or f.data.startswith(b"Rar!"), scan_rar),
)
#: Flags that follow from name, type and size alone.
PLAIN: tuple[tuple[str, Callable[[Found], bool]], ...] = (
    ("double_extension", lambda f: bool(DOUBLE.search(f.name))),
    ("dangerous_extension", lambda f: f.suffix in DANGEROUS),
    ("archive", lambda f: f.suffix in ARCHIVES),
    ("office_macro_capable", lambda f: f.suffix in OFFICE_OLD),
    ("macro_enabled_office", lambda f: f.suffix in OFFICE_MACRO),
    ("nested_email", lambda f: f.suffix in MAILS or f.mime == "message/rfc822"),
    ("image_attachment", lambda f: f.suffix in IMAGES or f.mime.startswith("image/") and f.suffix != "svg"),
    ("mime_mismatch", lambda f: f.suffix in ("pdf", "jpg", "png", "txt", "docx") and f.mime == "application/x-msdownload"),
    ("html_polyglot", polyglot),
    ("empty_file", lambda f: not f.data),
)


def inspect(name: str, data: bytes) -> Found:
    """Flags, members, targets and text of a file, by its name and its bytes."""
    f = Found(name, data)
    for flag, hit in PLAIN:
        if hit(f):
            f.flag(flag)
    for applies, scan in SCANNERS:
        try:
            if applies(f):
                scan(f)
        except (ValueError, KeyError, IndexError, OSError, RuntimeError, RecursionError, MemoryError, struct.error):
            f.flag("scan_failed")
    return f

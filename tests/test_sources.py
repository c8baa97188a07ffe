import io
import mailbox
import struct
import zipfile
from email.message import EmailMessage

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirefold.sources import attachments as at
from mirefold.sources import mail as m
from mirefold.streaming import triage


def zipped(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, "x")
    return out.getvalue()


def message(subject="Grüße", body="Hallo Welt", attachments=()):
    e = EmailMessage()
    e["From"], e["To"], e["Subject"], e["Message-ID"] = "Ann <a@x.test>", "b@x.test", subject, "<1@x.test>"
    e["Authentication-Results"] = "mx; spf=pass; dkim=pass"
    e["Authentication-Results"] = "mx2; spf=softfail dmarc=none"
    e.set_content(body)
    for name, data in attachments:
        e.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return e


def flags(name, data):
    return list(at.inspect(name, data).flags)


def test_names_and_types():
    assert flags("invoice.pdf.exe", b"MZ..") == ["double_extension", "dangerous_extension"]
    assert flags("a.pdf", b"MZ..")[:1] == ["mime_mismatch"] and flags("", b"") == ["empty_file"] and flags("x.onepkg", b"FileData") == ["dangerous_extension", "onenote_attachment", "onenote_embedded_file"]
    assert all(flags(f"x.{s}", b"1")[:1] == ["dangerous_extension"] for s in ("msp", "scf", "onepkg")) and flags("x.xll", b"1") == [] and flags("photo.png", b"x") == ["image_attachment"]


def test_zip():
    f = at.inspect("a.zip", zipped("x/y.js", "m.eml", "b.zip", "r.pdf.exe"))
    assert f.mime == "application/zip" and list(f.entries) == ["x/y.js", "m.eml", "b.zip", "r.pdf.exe"]
    assert list(f.flags) == ["archive", "archive_double_extension", "archive_dangerous_member", "archive_nested_email", "nested_archive"]
    assert "broken_archive" in flags("a.zip", b"PK\x03\x04broken")
    many = at.inspect("a.zip", zipped(*(f"{i}.txt" for i in range(300))))
    assert len(many.entries) == 200 and "entries_cut" in many.flags


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        for n, body in parts.items():
            z.writestr(n, body)
    return out.getvalue()


RELS = '<Relationships><Relationship Type="http://schemas.test/{}" Target="https://evil.test/x" TargetMode="External"/></Relationships>'


def test_office():
    f = at.inspect("a.docx", office({"word/document.xml": "<w><p><r><t>Hello</t></r><r><t> there</t></r></p><p><t>two</t></p></w>", "word/_rels/document.xml.rels": RELS.format("hyperlink")}))
    assert f.text == "Hello there\ntwo" and list(f.targets) == ["https://evil.test/x"] and list(f.flags) == ["office_hyperlink"]
    assert "office_remote_template" in flags("a.docx", office({"word/_rels/settings.xml.rels": RELS.format("attachedTemplate")}))
    sheet = '<w><row><c t="s"><v>1</v></c><c><v>5</v></c><c t="inlineStr"><is><t>in</t></is></c></row></w>'
    x = at.inspect("a.xlsx", office({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<s><si><t>zero</t></si><si><t>o</t><t>ne</t></si></s>"}))
    assert x.text == "one\n5\nin" and not x.flags
    assert "office_dde" in flags("a.xlsx", office({"xl/worksheets/sheet1.xml": "<w><f>=cmd|'/c calc'!A0</f></w>"})) and "office_external_data" in flags("a.xlsx", office({"xl/worksheets/sheet1.xml": "<f>WEBSERVICE(&quot;https://x.test&quot;)</f>"}))
    macro = flags("a.docm", office({"word/vbaProject.bin": "x" + "AutoOpen".encode("utf-16-le").decode("latin-1")}))
    assert {"macro_enabled_office", "office_macro_capable", "ooxml_vba", "office_vba_live"} <= set(macro) and "office_vba_live" not in flags("a.docm", office({"word/vbaProject.bin": "plain"}))
    p = at.inspect("a.pptx", office({"ppt/slides/slide10.xml": "<s><p><t>ten</t></p></s>", "ppt/slides/slide2.xml": "<s><p><t>two</t></p></s>"}))
    assert p.text == "two\nten"


def test_other_containers():
    assert flags("a.rar", b"Rar!\x1a\x07\x00..run me.exe\0x.pdf.js\0") == ["archive", "rar_archive", "archive_double_extension", "archive_dangerous_member", "rar_contains_exe", "rar_contains_script"]
    iso = at.inspect("d.iso", b"\0" * 64 + b"READ.LNK;1\0\0\0\0" + "setup.exe".encode("utf-16-le"))
    assert {"iso_image", "iso_contains_lnk", "iso_contains_exe", "archive_dangerous_member"} <= set(iso.flags) and {"READ.LNK", "setup.exe"} <= set(iso.entries)
    assert "disk_contains_script" in flags("d.vhdx", b"..a.vbs\0") and "cab_contains_lnk" in flags("c.cab", b"MSCF..go.lnk\0") and flags("x.7z", b"7z\xbc\xaf'\x1c") == ["archive", "seven_zip", "archive_unlisted"]


def test_scripts_and_links():
    f = at.inspect("a.js", b"x = ActiveXObject('WScript'); go('https://evil.test/p')")
    assert {"script_attachment", "script_url", "script_runner"} <= set(f.flags) and "https://evil.test/p" in f.targets
    lnk = at.inspect("a.lnk", b"L\0\0\0" + b"\0" * 76 + "C:\\Windows\\cmd.exe /c start https://evil.test".encode("utf-16-le"))
    assert {"shortcut_lnk", "lnk_target", "lnk_dangerous", "lnk_http_target"} <= set(lnk.flags)
    url = at.inspect("a.url", b"[InternetShortcut]\r\nURL=file://srv/x.exe\r\n")
    assert "lure_shortcut_target" in url.flags and next(iter(url.targets)) == "file://srv/x.exe"


def test_documents_and_pages():
    assert flags("x.pdf", b"%PDF-1.7 /OpenAction /JavaScript /URI (https://a.test)") == ["pdf_attachment", "pdf_javascript", "pdf_uri_action", "pdf_openaction_uri"]
    assert flags("x.rtf", b"{\\rtf1 \\objupdate \\objdata equation.3") == ["office_macro_capable", "rtf_objupdate", "rtf_equation", "rtf_ole", "rtf_exploit"]
    page = at.inspect("a.html", b"<html><body><form action='http://1.2.3.4/x'></form><script>atob ('x')</script>Hi<p>you</p><a href='https://l.test'>l</a>")
    assert list(page.flags) == ["html_attachment", "html_smuggling", "html_form_action"] and page.text == "Hi\nyou\nl" and list(page.targets) == ["https://l.test"]
    assert "svg_script" in flags("a.svg", b"<svg onload=x()>") and "html_polyglot" in flags("a.htm", b"<html>" + b" " * 40 + b"PK\x03\x04")
    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "VBA".encode("utf-16-le") + b"\1Ole10Native" + b"URLDownloadToFile"
    assert {"ole_compound", "ole_package", "ole_macros_suspected", "office_vba_live"} <= set(flags("a.doc", ole))


def test_tnef():
    part = lambda kind, body: b"\x02" + struct.pack("<II", kind, len(body)) + body + b"\0\0"
    data = b"\x78\x9f\x3e\x22\0\0" + part(0x18010, b"a.exe\0") + part(0x6800F, b"MZ" * 20) + part(0x18010, b"b.txt\0") + part(0x6800F, b"hello")
    f = at.inspect("winmail.dat", data)
    assert [n for n, _ in f.inner] == ["a.exe", "b.txt"] and list(f.flags) == ["tnef_attachment"]
    assert "tnef_broken" in flags("winmail.dat", data[:-4])


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["a.zip", "a.docx", "a.lnk", "winmail.dat", "a.html", "a.pdf", "a.doc", "a.iso", "a.rtf"]), st.sampled_from([b"", b"PK\x03\x04", b"\x78\x9f\x3e\x22", b"L\0\0\0", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"<html>"]), st.binary(max_size=200))
def test_any_bytes_are_scanned(name, start, rest):
    assert "scan_failed" not in at.inspect(name, start + rest).flags


@pytest.mark.parametrize("codec,declared", [("cp1251", "koi8-r"), ("koi8-r", None), ("cp866", "windows-1251"), ("cp1251", "windows-1251"), ("iso-8859-5", "latin-1"), ("utf-8", "koi8-r")])
def test_cyrillic_encodings_compete(codec, declared):
    text = "Добрый день, коллеги! Проверьте, пожалуйста, журнал проверок до конца недели."
    assert m.decoded(text.encode(codec), declared) == text


def test_western_text_stays_western():
    text = "Grüße aus Köln, déjà vu – à bientôt"
    assert m.decoded(text.encode("cp1252"), "iso-8859-1") == text == m.decoded(text.encode("cp1252"), None) and m.decoded(b"x", "no-such-charset") == "x"


def test_html():
    text, links = m.html_text("<head><title>no</title></head><p>Hello<br>you</p><script>bad()</script><a href='http://h.test'>click <b>me</b></a>")
    assert text == "Hello\nyou\nclick me" and links == [("http://h.test", "click me")]


def test_folder(spark, tmp_path):
    inner = message("Inner", "inner words")
    outer = message(attachments=[("note.pdf.exe", b"MZ1")])
    outer.add_attachment(inner)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.eml").write_bytes(b"\xef\xbb\xbf\r\n" + outer.as_bytes())
    (tmp_path / "b.msg").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"ignored")
    box = mailbox.mbox(str(tmp_path / "d.mbox"))
    for i in range(3):
        box.add(message(f"S{i}", "body\nFrom here on"))
    box.close()
    parsed = m.auth_results(m.read_folder(spark, str(tmp_path), mailbox_limit=2)).select("*", m.header("subject").alias("subject"), m.header("absent").alias("absent")).collect()
    by = {r["path"].rpartition("/")[2]: r for r in parsed}
    assert set(by) == {"a.eml", "b.msg", "d.mbox#0", "d.mbox#1", "d.mbox"} and by["d.mbox"]["errors"] == ["1 of 3 messages are beyond the limit"]
    a = by["a.eml"]
    assert a["subject"] == "Grüße" and a["absent"] is None and "Hallo Welt" in a["text"] and "inner words" in a["text"] and a["spf"] == "softfail" and a["dkim"] == "pass" and a["dmarc"] == "none"
    assert [x["filename"] for x in a["attachments"]] == ["note.pdf.exe"] and a["attachments"][0]["flags"] == ["double_extension", "dangerous_extension"]
    assert by["b.msg"]["kind"] == "unknown" and by["d.mbox#1"]["text"].strip() == "body\nFrom here on"


def test_broken_files(spark):
    df = spark.createDataFrame([("a.eml", bytearray(b"")), ("b.eml", bytearray(b"\xff\xfeno")), ("c.eml", None), ("d", bytearray(b"x"))], "path string, content binary")
    assert m.parse_files(df).count() == 4 and m.parse_files(df.limit(0)).count() == 0
    boxes = spark.createDataFrame([("a.mbox", bytearray(b"")), ("b.mbox", bytearray(b"Subject: one\n\nbody")), ("c.mbox", bytearray(b"From x\nSubject: 1\n\na\nFrom y\nSubject: 2\n\nb"))], "path string, content binary")
    got = {r["path"]: r for r in m.parse_files(boxes).collect()}
    assert got["a.mbox"]["errors"] == ["empty"] and got["b.mbox#0"]["text"] == "body" and {"c.mbox#0", "c.mbox#1"} <= set(got) and len(got) == 4


def test_large_files_give_an_error_and_are_not_read(spark):
    df = spark.createDataFrame([("a.eml", None, 50 << 20), ("b.mbox", None, 50 << 20), ("c.eml", bytearray(b"Subject: x\n\ny"), 12)], "path string, content binary, length long")
    got = {r["path"]: r["errors"] for r in m.parse_files(df).collect()}
    assert got == {"a.eml": ["too large"], "b.mbox": ["too large"], "c.eml": []}


def test_deeply_nested_mails_leave_an_error(spark):
    inner = message("deep", "deepest words")
    for i in range(4):
        outer = message(f"level {i}", f"words {i}")
        outer.add_attachment(inner)
        inner = outer
    row = m.parse_message("a.eml", inner.as_bytes())
    assert "words 1" in row["text"] and "deepest words" not in row["text"] and any("nested deeper" in e for e in row["errors"])


def test_pasted_text_and_banners(spark):
    df = spark.createDataFrame([("p1", "---------- Forwarded message ----------\nFrom: a@x.test\nSubject: hi\n\nbody"), ("p2", "only words"), ("p3", None)], "name string, text string")
    got = {r["path"]: r for r in m.parse_pasted(df, "name", "text").collect()}
    assert got["p1.eml"]["text"] == "body" and got["p2.eml"]["errors"] == ["not a message"] == got["p3.eml"]["errors"]
    assert m.parse_message("x", b"From: a@x.test\nSubject: s: t\n\nb")["headers"][0]["name"] == "From"


def test_stream(spark, tmp_path):
    rows = [(1, "a", "x.test", "k", "benign", "2024-01-01 10:00:00"), (2, "a", "x.test", "k", "benign", "2024-01-02 10:00:00"), (3, "b", "y.test", "k", "malicious", "2024-01-02 11:00:00")]
    df = spark.createDataFrame(rows, "id long, message_id string, domain string, campaign_key string, verdict_level string, t string").withColumn("at", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("once", triage.once(stream, "message_id", "at"), "append"), ("levels", triage.level_counts(stream, "at"), "complete"), ("div", triage.diverging(stream, "at", "campaign_key", "domain"), "complete")):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["message_id"] for r in spark.table("once").collect()) == ["a", "b"]
    assert sum(r["messages"] for r in spark.table("levels").collect()) == 3
    assert [r["domains"] for r in spark.table("div").collect()] == [2]

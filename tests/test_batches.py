import json
import zipfile

import pytest
from pyspark.sql import functions as F

from mirefold.operators import batches, headers, indicators, pipeline
from mirefold.sources import config, exports
from mirefold.sources import mail as m


def one(spark, column, schema="x string", value=("",)):
    return spark.createDataFrame([value], schema).select(column).first()[0]


def test_types():
    assert "registry" not in batches.selected_types() and "bitcoin" not in batches.selected_types() and "registry" in batches.selected_types(everything=True) and batches.selected_types(("crypto",)) == ["bitcoin", "monero"]


@pytest.mark.parametrize("text,level", [(" Phishing", None), ("фишинг", "malicious"), ("OK", "benign"), ("Suspicious ", "suspicious"), ("", None), (None, None)])
def test_levels(spark, text, level):
    assert one(spark, batches.level_of(F.col("x")), value=(text,)) == level


@pytest.mark.parametrize("text,most,want", [("abcdefgh", 5, "ab…gh"), ("abc", 5, "abc"), ("", 3, ""), ("abcd", 1, "…"), ("abcdef", 4, "ab…f")])
def test_shortened(spark, text, most, want):
    assert one(spark, batches.shortened(F.col("x"), most), value=(text,)) == want


def test_lists_once(spark):
    assert one(spark, batches.distinct_ignoring_case(F.col("x")), "x array<string>", (["a", None, "A", "b", "B", "a"],)) == ["a", "b"]


def test_peers_of_a_hot_campaign(spark):
    df = spark.range(300).selectExpr("id", "if(id < 290, 'hot', concat('k', id)) as key", "if(id = 7, null, concat('p', lpad(id, 3, '0'))) as path", "1 as peers").unionByName(spark.createDataFrame([(900, None, "x", 1), (901, "", "y", 1)], "id long, key string, path string, peers int"))
    out = {r["id"]: r for r in batches.peers(df, "key", "path", "id", most=5).collect()}
    assert len(out) == 300 and out[0]["peer_count"] == 289 and out[0]["peers"] == ["p001", "p002", "p003", "p004", "p005"] and out[7]["peers"][0] == "p000" and out[295]["peers"] == []
    assert batches.peers(df.limit(0), "key", "path", "id").count() == 0


def test_paths(spark):
    left = spark.createDataFrame([(1, "IN\\A.eml"), (2, "other/b.eml"), (3, "other/c.eml"), (4, None)], "id long, p string")
    right = spark.createDataFrame([("in/a.eml", 10), ("in/A.eml", 9), ("in/b.eml", 11), ("x/c.eml", 12), ("y/c.eml", 13), (None, 14)], "q string, rid long")
    assert {r["id"]: r["rid"] for r in batches.matched_paths(left, "p", right, "q", "rid").collect()} == {1: 9, 2: 11, 3: None, 4: None}


def test_rewrites(spark):
    df = spark.createDataFrame([(1, "a", "url", "https://t.test/x", None, None), (2, "a", "domain", "wrap.test", ["k"], None), (3, "b", "url", "https://t.test/x", None, "old")], "id long, g string, ioc_type string, value string, tags array<string>, rewritten_from string")
    links = spark.createDataFrame([("a", "https://wrap.test/?u=1", "https://t.test/x"), ("a", "https://same.test", "https://same.test")], "g string, original string, unwrapped string")
    got = {r["id"]: (r["tags"], r["rewritten_from"]) for r in batches.rewrites_marked(df, "g", links).collect()}
    assert got == {1: (["unwrapped"], "https://wrap.test/?u=1"), 2: (["k", "url_rewriter"], None), 3: ([], "old")}


def parsed(spark, raw):
    return m.parse_files(spark.createDataFrame([("a.eml", bytearray(raw))], "path string, content binary"))


MAIL = b"""Received: by b; 2\r\nReceived: by a; 1\r\nFrom: Ann <a@x.test>\r\nSubject: see https://evil.test/p\r\nList-Unsubscribe: <https://u.other.test/x>, <mailto:stop@m.test?subject=x>
DKIM-Signature: v=1; a=rsa; d=evil.test; s=k\r\nAuthentication-Results: mx; spf=pass; dkim=pass\r\n\r\nbody"""


def test_headers(spark):
    df = parsed(spark, MAIL)
    card = headers.identity(df).first()
    assert (card["from_header"], card["spf"], card["dmarc"], card["received_hops"], card["first_received"]) == ("Ann <a@x.test>", "pass", "", 2, "by b; 2")
    assert headers.originating_hop(df).first()["hop"] == "by a; 1"
    assert tuple(headers.alignment(df).first())[1:] == ("evil.test", "x.test")
    assert sorted(df.select(headers.unsubscribe_hosts(m.header("List-Unsubscribe"))).first()[0]) == ["m.test", "u.other.test"]
    assert headers.header_text(df).first()["text"].split("\n")[1] == "Subject: see https://evil.test/p"


@pytest.mark.parametrize("results,wrong", [("dkim=pass header.d=x.test header.from=x.test", None), ("dkim=pass header.i=@mail.x.test header.from=x.test", None), ("dkim=pass header.d=e.test header.from=x.test", ("e.test", "x.test")), ("dkim=pass header.i=@e.test header.from=x.test", ("e.test", "x.test"))])
def test_alignment_of_results(spark, results, wrong):
    got = headers.alignment(parsed(spark, f"From: a@x.test\r\nAuthentication-Results: mx; {results}\r\n\r\nb".encode())).first()
    assert (got and (got["signed"], got["sender"])) == wrong


def test_attachments_lift(spark):
    e = b"""From: a@x.test\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Disposition: attachment; filename=a.url\r\n\r\n[InternetShortcut]\r\nURL=https://evil.test/x\r\n--b\r\nContent-Disposition: attachment; filename=empty.txt\r\n\r\n\r\n--b--"""
    got = {(r["ioc_type"], r["value"]) for r in headers.attachment_indicators(parsed(spark, e)).collect()}
    assert ("url", "https://evil.test/x") in got and ("filename", "empty.txt") in got and sum(k == "md5" for k, _ in got) == 1


def test_lists(spark, tmp_path):
    (tmp_path / "allow.txt").write_text("# c\n\ndomain: Example.COM.\nip:10.0.0.1\n2001:db8::1\n*.cdn.example\nexample.com\n")
    entries = config.allowlist_entries(config.lines_of(spark, str(tmp_path / "allow.txt")))
    assert {tuple(r) for r in entries.collect()} == {("domain", "example.com"), ("ip", "10.0.0.1"), ("ip", "2001:db8::1"), ("domain", "*.cdn.example")}
    new = spark.createDataFrame([("https://New.test/x",), ("bob@example.com",), ("www.b.test",), ("9.9.9.9",), (None,), ("",)], "v string")
    assert {r[0] for r in config.new_allowlist_lines(new, "v", entries).collect()} == {"domain:new.test", "domain:www.b.test", "ip:9.9.9.9"}
    owned = spark.createDataFrame([("@Corp.example",), ("# x",), ("a b.test",), ("x@y.test",), ("single",), ("-bad.test",)], "line string")
    assert [r[0] for r in config.owned_domains(owned).collect()] == ["corp.example"]
    assert one(spark, config.zones(F.col("x")), "x array<string>", (["XYZ", ".xyz", " top ", "", None],)) == [".xyz", ".top"]


def test_feedback_files(spark, tmp_path):
    at = str(tmp_path / "fb")
    for k in range(3):
        config.append_feedback(spark.createDataFrame([(k, "fp")], "n long, kind string"), at)
    assert [r["n"] for r in config.recent_feedback(spark, at, "n long, kind string", "n", 2).collect()] == [2, 1]
    changes = spark.createDataFrame([("b", 2), ("a", -1)], "k string, v int")
    assert json.loads(config.suggestions_json(changes, "k", "v").first()[0]) == {"a": -1, "b": 2}


def test_profile_packs_stay_in_their_folder(tmp_path):
    good, bad = tmp_path / "good.zip", tmp_path / "bad.zip"
    for at, names in ((good, ["a.txt", "d/b.txt"]), (bad, ["ok.txt", "../evil.txt"])):
        with zipfile.ZipFile(at, "w") as z:
            for n in names:
                z.writestr(n, "x")
    assert config.unpack_profile(str(good), str(tmp_path / "out")) == ["a.txt", "d/b.txt"] and (tmp_path / "out/d/b.txt").exists()
    with pytest.raises(ValueError):
        config.unpack_profile(str(bad), str(tmp_path / "out2"))
    assert not (tmp_path / "out2").exists() and not (tmp_path / "evil.txt").exists()


def test_tickets(spark):
    df = spark.createDataFrame([("malicious", 80, "k", None, "in\\a.eml", "A", "S", None, ["url:https://e.test/x"], None)], "verdict_level string, verdict_score int, campaign_key string, top_reason string, path string, sender string, subject string, message_id string, top_iocs array<string>, errors array<string>")
    values = exports.ticket_values(df)
    assert values.select(exports.tickets()).first()[0] == "Verdict: malicious\nScore: 80\nCampaign: k\nFile: a.eml\nFrom: A\nSubject: S\nIndicators:\n  url:hxxps://e[.]test/x"
    assert values.select(exports.tickets("{verdict}/{reason}/{other}")).first()[0] == "malicious//{other}"


def test_messages_from_file_to_row(spark):
    raw = b"""From: "Ann" <a@x.test>\r\nReply-To: b@evil.test\r\nSubject: Re: pay\r\nMessage-ID: <1@x.test>\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nUrgent: see https://urldefense.com/v3/__https://deep.test/p__;x or https://ok.example.net/a\r\n--b\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename=run.exe\r\n\r\nMZ1\r\n--b--"""
    files = spark.createDataFrame([("a.eml", bytearray(raw)), ("b.msg", bytearray(b"x"))], "path string, content binary")
    out = pipeline.analysed(m.parse_files(files), spark.createDataFrame([("example.net",)], "domain string"))
    found = {(r["ioc_type"], r["value"]): set(r["tags"]) for r in out.indicators.collect()}
    assert "unwrapped" in found["url", "https://deep.test/p"] and "allowlisted" in found["domain", "ok.example.net"] and "url_rewriter" in found["domain", "urldefense.com"] and {"a@x.test", "b@evil.test"} <= {v for k, v in found if k == "email"}
    assert ("filename", "run.exe") in found and sum(k == "sha256" for k, _ in found) == 1
    assert {"reply_to_mismatch", "orphan_reply"} <= {r["finding"] for r in out.findings.collect()} and "urgency" in {r["kind"] for r in out.signals.collect()}
    rows = {r["path"]: r for r in out.triage.collect()}
    assert rows["a.eml"]["campaign_key"].startswith("att:") and rows["a.eml"]["ioc_count"] == len(found) and rows["a.eml"]["top_iocs"][0] == "url:https://deep.test/p"
    assert rows["b.msg"]["errors"] == ["no reader for this type"] and rows["b.msg"]["ioc_count"] == 0


FINDINGS = [
    ("Sender: b@y.test", {"sender_mismatch": "high", "no_auth_header": "low"}), ("Sender: b@y.test\r\nList-Id: <l.test>", {"sender_mismatch": "info", "no_auth_header": "low"}), ("Sender: b@m.x.test", {"no_auth_header": "low"}),
    ("Resent-From: b@y.test\r\nAuthentication-Results: mx; spf=fail", {"resent_from": "medium", "no_arc": "low"}), ("ARC-Seal: i=1; cv=fail\r\nAuthentication-Results: mx; spf=pass", {"arc_failed": "high"}),
    ("ARC-Seal: i=1; cv=pass\r\nARC-Authentication-Results: i=1; dkim=pass\r\nAuthentication-Results: mx; spf=fail", {"arc": "info"}),
]


@pytest.mark.parametrize("extra,want", FINDINGS)
def test_more_findings(spark, extra, want):
    got = {r["finding"]: r["severity"] for r in headers.more_findings(parsed(spark, f"From: a@x.test\r\n{extra}\r\n\r\nb".encode())).collect()}
    assert got == want


HOSTS = [("bucket.s3.amazonaws.com", True), ("s3-eu.amazonaws.com", True), ("ses.amazonaws.com", False), ("acc.blob.core.windows.net", True), ("acc.z13.web.core.windows.net", True), ("x.drive.google.com", True), ("mail.google.com", False), ("raw.githubusercontent.com", True)]


@pytest.mark.parametrize("host,user", HOSTS)
def test_user_clouds(spark, host, user):
    assert one(spark, indicators.user_cloud_host(F.col("x")), value=(host,)) == user
    allow = spark.createDataFrame([("amazonaws.com",), ("windows.net",), ("google.com",), ("githubusercontent.com",)], "domain string")
    assert indicators.allowlisted(spark.createDataFrame([(host,)], "h string"), "h", allow).first()["allowlisted"] != user

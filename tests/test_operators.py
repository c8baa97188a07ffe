import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirefold.functions import rewriters
from mirefold.functions import text as tx
from mirefold.operators import campaigns, indicators, lookalikes, scoring, signals
from mirefold.sources import exports


def values(spark, function, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, v string")
    return [r["o"] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_strings(spark):
    assert values(spark, tx.defang, ["https://a.b", None, ""]) == ["hxxps://a[.]b", None, ""]
    assert values(spark, tx.refang, ["hXXps://a[.]b", "a(dot)b", "x [at] y", "mail dot evil dot com", "a {.} b"]) == ["https://a.b", "a.b", "x @ y", "mail.evil.com", "a . b"]
    assert values(spark, tx.url_key, ["HTTP://www.A.test:080/p/?Q=1#f", "http://a.test/", "//b.test/x//"]) == ["http://a.test:80/p?Q=1", "http://a.test/", "http://b.test/x"]
    assert values(spark, tx.registrable, ["a.b.co.uk", "x.y.z", "single", "a..b."]) == ["b.co.uk", "y.z", "single", "a.b"]
    assert values(spark, tx.campaign_subject, ["[EXT] Re: AW: x", "Re[2]: Fwd:  Two  Words", "  ", "SPAM: ответ: Да"]) == ["aw: x", "two words", "", "да"]
    assert values(spark, tx.host_of, ["a@B.test>", "http://C.test:8/x", "d.test/x", ""]) == ["b.test", "c.test", "d.test", ""]
    assert values(spark, tx.is_private_ipv4, ["10.1.1.1", "100.64.0.1", "100.128.0.1", "172.31.0.1", "172.32.0.1", "8.8.8.8"]) == [True, True, False, True, False, False]


CHAINS = [
    ("https://eu.safelinks.protection.outlook.com/?url=https%3A%2F%2Fevil.test%2Fp&data=1", "https://evil.test/p", ["microsoft_safelinks"]),
    ("https://urldefense.com/v3/__https://evil.test/p__;!!x", "https://evil.test/p", ["proofpoint_v3"]),
    ("https://urldefense.proofpoint.com/v2/url?u=https-3A__evil.test_p&d=x", "https://evil.test/p", ["proofpoint_v2"]),
    ("http://proxy.test:8080/*,1,0/http://evil.test/p", "http://evil.test/p", ["proxysg"]),
    ("https://www.google.com/url?q=https://evil.test/", "https://evil.test/", ["google_redirect"]),
    ("https://wrap.test/r?u=https%3A%2F%2Feu.safelinks.protection.outlook.com%2F%3Furl%3Dhttps%253A%252F%252Fevil.test", "https://evil.test", ["microsoft_safelinks", "microsoft_safelinks"]),
    ("https://mimecast.com/s/nothing", "https://mimecast.com/s/nothing", []),
    ("https://plain.test/page.", "https://plain.test/page", []),
    (None, None, []),
]


def test_unwrap(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(CHAINS)], "i int, u string")
    out = rewriters.unwrap(df, "u").orderBy("i").collect()
    assert [(r["unwrapped"], r["chain"]) for r in out] == [(w, c) for _, w, c in CHAINS]


def test_found(spark):
    text = "see hxxps://evil.test/a. t.me/chan1 10.0.0.1:8080 1.2.3.4 999.1.1.1 1.2.3.4.5 " + "a1" * 32 + " " + "1" * 64 + r" CVE-2024-12345 HKLM\Run C:\Users\x.exe Global\mtx1 a@b.test powershell -nop -w hidden x"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    got = {(r["ioc_type"], r["value"]) for r in indicators.found_in(df, "id", "t").collect()}
    assert got == {
        ("url", "hxxps://evil.test/a"), ("messenger", "https://t.me/chan1"), ("ip_port", "10.0.0.1:8080"), ("ipv4", "10.0.0.1"), ("ipv4", "1.2.3.4"), ("sha256", "a1" * 32), ("cve", "CVE-2024-12345"),
        ("registry", r"HKLM\Run"), ("filepath", r"C:\Users\x.exe"), ("mutex", r"Global\mtx1"), ("email", "a@b.test"), ("command_line", "powershell -nop -w hidden x"), ("domain", "evil.test"), ("domain", "t.me"),
    }


def test_wallets(spark):
    good, segwit = "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"
    df = spark.createDataFrame([(1, f"{good} {segwit} 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb")], "id long, t string")
    assert {r["value"] for r in indicators.wallets_in(df, "id", "t").collect()} == {good, segwit}


def test_merge_keeps_the_strongest(spark):
    rows = [(1, "m", "url", "http://www.A.test/x/", ["a", "private"], "r1", None), (2, "m", "url", "http://a.test/x", ["unwrapped"], "r2", None), (3, "m", "url", None, None, None, None)]
    df = spark.createDataFrame(rows, "ioc_id long, msg_id string, ioc_type string, value string, tags array<string>, rewritten_from string, context string")
    r = indicators.merged(df, "msg_id", "ioc_id").collect()[0]
    assert (r["value"], r["tags"], r["rewritten"], r["copies"], r["priority"]) == ("http://a.test/x", ["unwrapped", "a", "private"], "r2 | r1", 2, 45)
    assert [x["ioc_id"] for x in indicators.filtered(df, hide_private=True).collect()] == [2, 3]
    assert indicators.filtered(df, types=["url"], search="A.TEST/x", source_file="q.eml").count() == 2


def test_allowlist(spark):
    df = spark.createDataFrame([(1, "a.ok.test"), (2, "ok.test."), (3, "notok.test"), (4, None), (5, "x-y.wild.test")], "id long, host string")
    allow = spark.createDataFrame([("OK.test",), ("*.wild.test",)], "domain string")
    assert {r["id"]: r["allowlisted"] for r in indicators.allowlisted(df, "host", allow).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_lookalikes(spark):
    df = spark.createDataFrame([("velmarapay.example",), ("velmarapаy.example",), ("velmarapay-login.test",), ("velmarpay.example",), ("unrelated.test",), (None,)], "h string")
    got = {(r["host"], r["kind"]) for r in lookalikes.brand_hits(df, "h", ["velmarapay.example"]).collect()}
    assert got == {("velmarapаy.example", "homoglyph"), ("velmarapаy.example", "idn"), ("velmarapay-login.test", "brand_spoof"), ("velmarpay.example", "levenshtein")}
    mails = spark.createDataFrame([(1, '"Velmara Pay" <x@evil.test>'), (2, "Velmara Pay <x@velmarapay.example>"), (3, None)], "id long, f string")
    assert [(r["id"], r["brand"]) for r in lookalikes.display_spoofs(mails, "id", "f", [("velmara pay", ["velmarapay.example"])]).collect()] == [(1, "velmarapay.example")]


@settings(max_examples=25, deadline=None)
@given(points=st.lists(st.integers(1, 50), min_size=1, max_size=6), cap=st.integers(5, 60))
def test_caps_add_up(spark, points, cap):
    df = spark.createDataFrame([("g", i, p) for i, p in enumerate(points)], "g string, i int, p int")
    got = [r["capped_points"] for r in scoring.capped(df, ["g"], "i", "p", cap).orderBy("i").collect()]
    assert got == points if sum(points) <= cap else sum(got) == cap


def test_floor_and_verdicts(spark):
    df = spark.createDataFrame([("m", 1, -25), ("m", 2, -20)], "m string, i int, p int")
    assert sum(r["capped_points"] for r in scoring.capped(df, ["m"], "i", "p", -30).collect()) == -30
    rows = spark.createDataFrame([("a", 80), ("b", 31), ("c", -5), ("d", 25), ("d", -20)], "m string, p int")
    got = {r["m"]: (r["score"], r["level"], r["confidence"]) for r in scoring.verdicts(rows, "m", "p").collect()}
    assert got == {"a": (80, "malicious", "high"), "b": (31, "suspicious", "low"), "c": (0, "benign", "medium"), "d": (5, "benign", "low")}


@pytest.mark.parametrize("kinds,want", [(["fp"] * 4 + ["fn"], {"threshold_suspicious": 35, "threshold_malicious": 65, "cap_headers": 40, "cap_lookalike": 26, "cap_display_spoof": 24}), (["fn"] * 4 + ["fp"], {"threshold_suspicious": 25, "threshold_malicious": 55, "cap_content": 45}), (["fp", "fn"], {}), (["confirm"] * 5, {})])
def test_thresholds(spark, kinds, want):
    df = spark.createDataFrame([(k, None) for k in kinds], "kind string, segment string")
    assert {r["setting"]: r["value"] for r in scoring.threshold_changes(df).collect()} == want


def test_campaigns(spark):
    rows = [("<a@x> <b@y>", None, "s"), (None, "<B@y>", "s"), (None, None, "[EXT] Re: Hello  World"), (None, None, None)]
    df = spark.createDataFrame(rows, "r string, i string, s string")
    assert [r["k"] for r in df.select(campaigns.campaign_key(F.col("r"), F.col("i"), F.col("s")).alias("k")).collect()] == ["thread:a@x", "thread:b@y", "subj:hello world", ""]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "url", "http://a.test/?x=1", ["t"], "c"), (2, "sha1", "ab'c", None, None)], "ioc_id long, ioc_type string, value string, tags array<string>, context string")
    lines = [r["l"] for r in df.select("ioc_id", exports.cef_indicator(F.col("ioc_type"), F.col("value"), F.col("tags"), F.lit("malicious")).alias("l")).orderBy("ioc_id").collect()]
    assert lines[0].endswith(r"|ioc|url|9|request=http://a.test/?x\=1 cs3=url cs3Label=IocType cs4=t cs4Label=Tags") and "fileHash=ab'c" in lines[1]
    assert [r["p"] for r in df.select(exports.stix_pattern(F.col("ioc_type"), F.col("value")).alias("p")).collect()] == ["[url:value = 'http://a.test/?x=1']", "[file:hashes.'SHA-1' = 'ab\\'c']"]
    exports.write_lines(df, "value", str(tmp_path / "lines"))
    exports.write_csv(exports.misp_rows(df), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_signals(spark):
    rows = [(1, "Urgent: enter your password at https://bit.ly/x", "<form><input type='password'><img src='cid:1'>"), (2, None, None), (3, "password policy; ssh a@b", "<div style='opacity:0.85'>"), (4, "срочно перезвоните http://brand.test@evil.test/x\nReceived-SPF: pass", "")]
    df = spark.createDataFrame(rows, "id long, t string, h string")
    got = {}
    for r in signals.signals(df, "id", "t", "h").collect():
        got.setdefault(r["id"], set()).add(r["kind"])
    assert got == {1: {"urgency", "credential_harvest", "url_shortener", "html_form", "html_password_form", "cid_image", "cid_phishing"}, 4: {"urgency", "url_userinfo", "fake_auth_results"}}


def test_header_findings(spark):
    schema = "id long, from_header string, reply_to string, return_path string, subject string, message_id string, in_reply_to string, references_hdr string, spf string, dkim string, dmarc string, received_hops int"
    rows = [(1, "A <a@x.test>", "b@y.test", "<a@m.x.test>", "[EXT] Re: hi", "<1@x.test>", None, " ", "softfail", None, "fail", 0), (2, None, None, None, None, None, None, None, None, None, None, 3)]
    got = {(r["id"], r["finding"], r["severity"]) for r in signals.header_findings(spark.createDataFrame(rows, schema), "id").collect()}
    assert got == {(1, "reply_to_mismatch", "high"), (1, "orphan_reply", "high"), (1, "no_received", "medium"), (1, "spf", "medium"), (1, "dmarc", "critical"), (2, "no_auth_results", "low")}


def indicators_of(spark, text):
    return {(r["ioc_type"], r["value"]): r for r in indicators.extracted(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()}


def test_extracted_refangs_and_names_hosts(spark):
    got = indicators_of(spark, "go to hxxps://WWW.Evil[.]test/a/ or https://evil.test/a now, write to Bob[at]mail.test")
    assert set(got) == {("url", "https://WWW.Evil.test/a/"), ("domain", "evil.test"), ("email", "bob@mail.test"), ("domain", "mail.test")}
    assert got["url", "https://WWW.Evil.test/a/"]["copies"] == 2 and "was_defanged" in got["url", "https://WWW.Evil.test/a/"]["tags"]
    assert {"from_url"} <= set(got["domain", "evil.test"]["tags"]) and "from_email" in got["domain", "mail.test"]["tags"]
    assert "write to" in got["email", "bob@mail.test"]["context"]


def test_identifiers_are_no_addresses(spark):
    text = "Message-ID: <a1@id.test>\nReferences: <b2@id.test>\nFrom: Boss <boss@real.test>\nseen <c3@other.test> here"
    assert {v for k, v in indicators_of(spark, text) if k == "email"} == {"boss@real.test"}


def test_hosts_in_text(spark):
    text = "ivan.petrov sent report.pdf from mx1.mail.example and kаspi.kz via ka\u200bspi.kz, header.from passed, 1a2b3c4d5e.test too; xn--80ak6aa92e.com"
    assert {v for k, v in indicators_of(spark, text) if k == "domain"} == {"mx1.mail.example", "kаspi.kz", "kaspi.kz", "xn--80ak6aa92e.com"}


def test_hashes_and_addresses(spark):
    long = "a1" * 32
    got = indicators_of(spark, f"{long} {'a1' * 20} {'b2' * 20} {'c3' * 16} {'b2' * 16} fe80::1 2001:db8::5 12:30:45 10.1.2.3:8443 8.8.8.8:99999 8.8.8.8")
    assert {v for k, v in got if k in ("sha256", "sha1", "md5")} == {long, "b2" * 20, "c3" * 16}  # a hash within a longer one is left out
    assert {(k, v) for k, v in got if k in ("ipv6", "ip_port", "ipv4")} == {("ipv6", "fe80::1"), ("ipv6", "2001:db8::5"), ("ip_port", "10.1.2.3:8443"), ("ipv4", "10.1.2.3"), ("ipv4", "8.8.8.8")}
    assert "private" in got["ipv6", "fe80::1"]["tags"] and "private" in got["ipv4", "10.1.2.3"]["tags"] and "private" not in got["ipv4", "8.8.8.8"]["tags"]


def test_nothing_extracted(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "plain words only")], "id long, t string").selectExpr("*", "1 as value", "2 as tags")
    assert indicators.extracted(df, "id", "t").count() == 0 and indicators.extracted(df.limit(0), "id", "t").count() == 0


FOLDED = [("аррӏе.test", "app" + "ӏe.test"), ("ｍａｉｌ.test", "mail.test"), ("g00gle.com", "g00gle.com"), ("ҚАЗ.kz", "kaз.kz"), ("𝐚𝐛.com", "ab.com")]


@pytest.mark.parametrize("text,want", FOLDED)
def test_folding(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(lookalikes.folded(F.col("t"))).first()[0] == want


def test_kinds_of_look_alikes(spark):
    hosts = ["g00gle.com", "gооgle.com", "google.net", "xn--ggle-55da.com", "google-login.top", "googleapis.com", "googel.com", "mail.com", "google.com", "accounts.google.com", "näm.test"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {(r["host"], r["kind"], r["brand"]) for r in lookalikes.brand_hits(df, "h", ["google.com", "gmail.com"]).collect()}
    assert got == {
        ("g00gle.com", "levenshtein", "google.com"), ("gооgle.com", "idn", ""), ("gооgle.com", "homoglyph", "google.com"), ("xn--ggle-55da.com", "idn", ""), ("xn--ggle-55da.com", "homoglyph", "google.com"),
        ("google-login.top", "brand_spoof", "google.com"), ("googel.com", "levenshtein", "google.com"), ("näm.test", "idn", ""),
    }


def test_spoofed_names(spark):
    rows = [(1, "Velmara Pay <x@evil.test>"), (2, "Velmara Pay <x@mail.velmarapay.example>"), (3, "Velmara Pay music <x@evil.test>"), (4, "Arcovia Velmara Pay <x@evil.test>"), (5, "Velmara Payroll <x@evil.test>"), (6, None)]
    names = [("velmara pay", ["velmarapay.example"]), ("arcovia", ["arcovia.example"])]
    got = {(r["id"], r["label"]) for r in lookalikes.display_spoofs(spark.createDataFrame(rows, "id long, f string"), "id", "f", names).collect()}
    assert got == {(1, "velmara pay"), (4, "arcovia")}


SIGNS = [
    ("Your password expires today", None, "urgency"), ("please enter your password", None, "credential_harvest"), ("Введите пароль от почты", None, "credential_harvest"), ("Изменились наши реквизиты", None, "payment_change"),
    ("Do not reply, just call me", None, "bec_callback"), ("press win+r", None, "clickfix"), ("password: 1234", None, "archive_password"), ("contact me via telegram", None, "messenger_lure"), ("scan the QR code", None, "qr_lure"),
    (None, "<b>enter</b> your <i>password</i>", "credential_harvest"), (None, "<a href='https://evil.test/x'>www.bank.test</a>", "href_mismatch"), (None, "<p style='display:none'>x</p>", "hidden_style"),
    (None, "<form action='x'>", "html_form"), (None, "<img src='https://a.test/b.png'>", "image_only_body"), (None, "<img src='cid:1'><a href='http://a.test'>x</a>", "cid_phishing"), ("see t.me/room1", None, "messenger_only"),
    ("x\nReceived-SPF: pass", None, "fake_auth_results"), ("go to https://a.b@c.test/", None, "url_userinfo"), ("new payment details: IBAN DE89370400440532013000", None, "payment_tokens"),
]
QUIET = ["The password policy was published.", "Our account number is unchanged.", "The QR printer is broken", "call us, reply to us", "<script>enter your password</script>", "<a href='https://www.bank.test/x'>bank.test</a>", "see t.me/room1 and https://a.test/", "font-size: 0.9em; opacity: 0.5"]


@pytest.fixture(scope="module")
def signs(spark):
    rows = [(i, t, h) for i, (t, h, _) in enumerate(SIGNS)] + [(1000 + i, None if "<" in x else x, x if "<" in x else None) for i, x in enumerate(QUIET)]
    out = {}
    for r in signals.signals(spark.createDataFrame(rows, "id long, t string, h string"), "id", "t", "h").collect():
        out.setdefault(r["id"], set()).add(r["kind"])
    return out


@pytest.mark.parametrize("i", range(len(SIGNS)))
def test_each_signal(signs, i):
    assert SIGNS[i][2] in signs.get(i, set())


@pytest.mark.parametrize("i", range(len(QUIET)))
def test_ordinary_text_has_none(signs, i):
    assert signs.get(1000 + i, set()) <= {"messenger_link"}

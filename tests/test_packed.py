import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirefold.operators.packed import CodeBook, Splitter, cheapest, code_counts, parses, split_packed

IDS = Splitter({"w": 300, "<w>": 3000, '"<w>"': 250})
TAGS = Splitter({"w": 70000, '"w"': 3000})
CASES = [
    (IDS, "<a@x> <b@y>", ["a@x", "b@y"]),
    (IDS, "<a@x><b@y>", ["a@x", "b@y"]),
    (IDS, "<a@x>\r\n\t<b@y>", ["a@x", "b@y"]),
    (IDS, '<"a b"@x>, <c@y>', ['"a b"@x', "c@y"]),
    (IDS, '"a b"@x; c@y', ['"a b"@x', "c@y"]),
    (IDS, '"<a@x>";"<b@y>"', ["a@x", "b@y"]),
    (IDS, "<a@x>  <b@y>,<c@z>", ["a@x", "b@y", "c@z"]),
    (IDS, '<"a b"@x>', ['"a b"@x']),
    (TAGS, "qr | punycode | private; qr ;from_email", ["qr", "punycode", "private", "qr", "from_email"]),
    (TAGS, '"noise" | url_rewriter', ["noise", "url_rewriter"]),
    (TAGS, 'unwrapped,"file:inbox/Juli 2025 2.eml"', ["unwrapped", "file:inbox/Juli 2025 2.eml"]),
    (TAGS, '"variant:say ""hi"""', ['variant:say "hi"']),
    (TAGS, 'qr, "variant:""x"", y"', ["qr", 'variant:"x", y']),
    (TAGS, '"file:a|b 10.eml"', ["file:a|b 10.eml"]),
    (TAGS, "private||allowlisted|qr", ["private", "allowlisted", "qr"]),
    (TAGS, " , ;", []),
    (TAGS, "", []),
]


@pytest.mark.parametrize("splitter,text,want", CASES)
def test_dialects(splitter, text, want):
    assert splitter(text) == want


VALUE = st.text(alphabet="abcXYZ019_:/.é|,; ", min_size=1, max_size=12).map(str.strip).filter(bool)


@settings(max_examples=150, deadline=None)
@given(st.lists(VALUE, min_size=2, max_size=5), st.sampled_from([",", ";", "|", "; ", " | "]))
def test_round_trip(values, delimiter):
    quoted = [f'"{v}"' if any(c in v for c in "|,; ") else v for v in values]
    assert TAGS(delimiter.join(quoted)) == values


def test_table(spark):
    rows = [(1, "a;b", ["x", "y|z", None, ""]), (2, None, None), (3, "single", ["x"]), (4, "", []), (5, "a;" * 3000 + "b", ["a b"])]
    df = spark.createDataFrame(rows, "id long, s string, t array<string>").withColumn("pos", F.lit(0))
    out = split_packed(df, "id", {"s": F.col("s"), "t": F.col("t")}).collect()
    got = sorted((r["row_id"], r["field_name"], r["pos"], r["value"]) for r in out if r["row_id"] != 5)
    assert got == [(1, "s", 1, "a"), (1, "s", 2, "b"), (1, "t", 1, "x"), (1, "t", 2, "y"), (1, "t", 3, "z")]
    assert sum(r["row_id"] == 5 for r in out) == 3003
    assert split_packed(df.limit(0), "id", {"s": F.col("s")}).count() == 0


def test_recurring_values_decide_where_shapes_do_not():
    counts = {"w": 1000, '"w"': 10}
    known = {zlib.crc32(v.encode()): 400 for v in ("red", "green")}
    assert Splitter(counts, known)("red green") == ["red", "green"]
    book = CodeBook(counts, known)
    options = parses("w w", book)
    assert len(options) == 2 and cheapest(["a", " ", "b"], options, book) == ["a", "b"]
    whole = Splitter({"w": 1000}, {zlib.crc32(b"red green"): 900})
    assert whole("red green") == ["red green"] and whole("red blue") == ["red", "blue"]


def test_code_counts(spark):
    rows = [(i, "red" if i % 2 else f"u{i}", "<" * 9 + "x") for i in range(40)] + [(99, "a;b", None)]
    counts = code_counts(spark.createDataFrame(rows, "id long, s string, t string"), {"s": F.col("s"), "t": F.col("t")})
    assert counts["s"] == ({"w": 40}, {zlib.crc32(b"red"): 20})
    assert list(counts["t"][0].values()) == [40] and list(counts["t"][0])[0].startswith("#")

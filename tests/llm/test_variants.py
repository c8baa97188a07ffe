import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirefold.llm.variants import common_form, normalised, variant_flags

CASES = [
    ("ｄａｌｉ．ｅｘａｍｐｌｅ", "dali.example", 1), ("𝚗𝚊𝚟.com", "nav.com", 1), ("ét", "ét", 2), ("ka​spi", "kaspi", 4), ("a\xa0b　c", "a b c", 8), ("examрle", "example", 16),
    ("Сеpюк", "Серюк", 16), ("Счёт reçu", "Счёт reçu", 0), ("«ok» – “x”…", "«ok» – “x”…", 0), ("paypa1", "paypa1", 0), ("", "", 0), ("вход-login", "вход-login", 0), ("№ 5 ½ µm", "№ 5 ½ µm", 0),
]


@pytest.mark.parametrize("text,want,flags", CASES)
def test_cases(text, want, flags):
    assert common_form(pa.array([text])).to_pylist() == [want]
    assert variant_flags(pa.array([text])).tolist() == [flags]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aeonẹ́́̈ậüñ xyz", max_size=12), min_size=1, max_size=5))
def test_composition_is_nfc(texts):
    assert common_form(pa.array(texts)).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_composition_reaches_over_marks_that_stay():
    texts = ["a\u0323\u0323\u0302", "a\u0327\u0323\u0302\u0301", "\u1100\u1161\u11a8\u1100\u1161", "각\u11a8", "\U0002f800", "ｶﾞ", "a\u0301\u0301", "\u0301a", "\u09c7\u09be\u09be"]
    assert common_form(pa.array(texts)).to_pylist() == [unicodedata.normalize("NFKC" if t == "ｶﾞ" else "NFC", t) for t in texts]


def test_every_canonical_form():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (how := unicodedata.decomposition(chr(c))) and how[0] != "<" and c not in (0x2000, 0x2001)]
    assert len(points) > 2000 and common_form(pa.array(points)).to_pylist() == [unicodedata.normalize("NFC", p) for p in points]


@pytest.mark.parametrize("text", ["zΐ", "ab\U000e0101c\U000f0000"])
def test_other_scripts_and_planes(text):
    assert common_form(pa.array([text])).to_pylist() == [text.replace("\U000e0101", "")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=8)), max_size=6))
def test_twice_is_once(texts):
    once = common_form(pa.array(texts, pa.string()))
    assert common_form(once).to_pylist() == once.to_pylist()
    assert [t is None for t in texts] == [t is None for t in once.to_pylist()]


def test_table(spark):
    df = spark.createDataFrame([(1, "é", "n"), (2, None, "n"), (3, "plain", "n"), (1, "é", "n"), (4, "x" * 100_000 + "​", "n")], "id long, v string, note string")
    assert [(r["id"], r["variant_flags"]) for r in normalised(df, "v").orderBy("id").collect()] == [(1, 2), (1, 2), (2, 0), (3, 0), (4, 4)]
    assert sorted(r["id"] for r in normalised(df, "v", only_changed=True).collect()) == [1, 1, 4]
    assert normalised(df.limit(0), "v").count() == 0
    with pytest.raises(ValueError):
        normalised(df.withColumnRenamed("note", "common"), "v")

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirefold.llm.pieces import pieces_of, split_texts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é.,;!?\n\r日", max_size=400), st.integers(12, 60), st.integers(0, 7))
def test_round_trip(text, limit, overlap):
    raw, cut = text.encode(), pieces_of(text, limit, overlap)
    assert b"".join(raw[body:end] for _, body, end in cut) == raw
    assert all(end - start <= limit for start, _, end in cut)
    assert all(body - start <= overlap for start, body, _ in cut)
    for start, _, end in cut:
        raw[start:end].decode()


def test_prefers_strong_boundaries():
    text = "First part here. It goes on.\n\n" + "Second part is here too. And more.\n\n" + "Third."
    cut = pieces_of(text, 40, 0)
    raw = text.encode()
    assert [raw[b:e].decode() for _, b, e in cut] == ["First part here. It goes on.\n\n", "Second part is here too. And more.\n\n", "Third."]


def test_a_text_without_boundaries():
    cut = pieces_of("é" * 5000, 1001, 100)
    assert max(e - s for s, _, e in cut) <= 1001 and len(cut) > 10


def test_table(spark):
    df = spark.createDataFrame([(1, "short"), (2, None), (3, ""), (4, "word " * 500), (4, "word " * 500)], "doc_id long, text string").selectExpr("*", "0 as piece_no")
    out = split_texts(df, "doc_id", "text", 300, 30).toPandas()
    assert out[out.doc_id == 1].n_pieces.tolist() == [1] and out[out.doc_id == 3].n_tokens.tolist() == [0] and 2 not in set(out.doc_id)
    long = out[(out.doc_id == 4)].drop_duplicates("piece_no").sort_values("piece_no")
    assert (long.overlap_tokens[1:] > 0).all() and long.n_tokens.max() <= 300
    assert "".join(t.encode()[o:].decode() for t, o in zip(long.piece_text, long.overlap_tokens, strict=True)) == "word " * 500
    assert split_texts(df.limit(0), "doc_id", "text", 300).count() == 0
    with pytest.raises(ValueError):
        pieces_of("x" * 100, 10, 10)


def test_runs_of_marks_take_linear_time():
    began = time.perf_counter()
    for run in (".", "!?", ",;", " ", ". .", "\n"):
        text = run * 300_000
        cut = pieces_of(text, 4000, 100)
        assert [c[1] for c in cut[1:]] == [c[2] for c in cut[:-1]] and cut[-1][2] == len(text)
    assert time.perf_counter() - began < 60

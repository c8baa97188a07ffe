import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirefold.llm.packing import assign, fullest, packed


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=8), st.integers(1, 60))
def test_fullest_is_optimal(sizes, room):
    distinct = sorted(set(sizes), reverse=True)
    counts = [sizes.count(s) for s in distinct]
    got = fullest(distinct, counts, room)
    assert all(n <= sizes.count(s) for s, n in got.items())
    best = max((sum(c) for r in range(len(sizes) + 1) for c in itertools.combinations(sizes, r) if sum(c) <= room), default=0)
    assert sum(s * n for s, n in got.items()) == best


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_containers_hold_everything(sizes):
    out = assign(np.array(sizes, np.int64), 50)
    load = np.bincount(out, weights=sizes) if sizes else []
    assert len(out) == len(sizes) and (len(sizes) == 0 or max(load) <= 50)


def test_table(spark):
    rows = [(1, "a" * 10), (2, "é" * 30), (3, None), (4, ""), (5, "b" * 25), (6, "a" * 10), (6, "a" * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as g")
    out = packed(df, "doc_id", "text", 25).toPandas()
    assert sorted(out.doc_id.unique()) == [1, 2, 4, 5, 6] and (out.doc_id == 6).sum() == 2
    parts = out[out.doc_id == 2].sort_values("part_no")
    assert parts.n_tokens.tolist() == [24, 24, 12] and parts.start_byte.tolist() == [0, 24, 48]
    assert out.groupby("container_id").n_tokens.sum().max() <= 25
    assert packed(df.limit(0), "doc_id", "text", 25).count() == 0
    with pytest.raises(ValueError):
        packed(df, "doc_id", "text", 0)


def test_little_room_is_left(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    out = packed(df, "doc_id", "text", 16384).toPandas()
    assert out.container_id.nunique() <= -(-out.n_tokens.sum() // 16384) + 1

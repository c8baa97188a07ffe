from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mirefold.operators.quotient import QuotientTable, permute, redelivered, split, unpermute


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2**64 - 1)] * 4), min_size=1, max_size=20))
def test_permutation_is_a_bijection(words):
    w = np.array(words, np.uint64)
    assert (unpermute(permute(w)) == w).all()


def test_equal_only_if_the_identifier_is():
    w = np.zeros((4, 4), np.uint64)
    w[1, 3], w[2, 0] = 1, 1  # differ in one bit
    q, r = split(w)
    t = QuotientTable(1)
    t.insert([q, *r.T, np.array([5, 7, 9, 3])])
    assert t.lost.tolist() == [True, False, False, False]
    t.insert([q[:1], *r[:1].T, np.array([1])])
    assert t.lost.tolist() == [True, False, False, True, False]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 5)), max_size=60), max_size=5))
def test_table_against_a_dictionary(batches):
    t, best, rows = QuotientTable(2), {}, []
    for batch in batches:
        words = np.zeros((len(batch), 4), np.uint64)
        words[:, 2] = [k for k, _ in batch]
        q, r = split(words)
        numbers = np.arange(len(rows), len(rows) + len(batch))
        t.insert([q, *r.T, np.array([v for _, v in batch], np.int64), numbers])
        rows += [(k, v, int(i)) for (k, v), i in zip(batch, numbers, strict=True)]
    for k, v, i in rows:
        best[k] = min(best.get(k, (v, i)), (v, i))
    assert [not x for x in t.lost] == [best[k] == (v, i) for k, v, i in rows]


def test_slots_that_collide():
    n = 3000
    r = np.zeros((n, 4), np.uint64)
    r[:, 0] = np.arange(n)  # one home slot for all
    t = QuotientTable(1)
    t.insert([np.zeros(n, np.int64), *r.T, np.arange(n)])
    t.insert([np.zeros(n, np.int64), *r.T, np.arange(n) - 1])
    assert t.lost[:n].all() and not t.lost[n:].any()


def test_redelivered(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    rows = [("a", 1, "x", t(2), 0), ("a", 2, "x", t(1), 0), ("a", 3, "x", t(1), 0), ("b", 1, "x", t(1), 0), ("a", 4, None, t(1), 0), ("a", 5, "", t(1), 0), ("a", 6, "y", None, 0), ("a", 7, "y", t(9), 0)]
    df = spark.createDataFrame(rows, "tbl string, id long, k string, at timestamp, k0 int")
    out = {(r["tbl"], r["id"]) for r in redelivered(df, "k", "at", "id", group="tbl").collect()}
    assert out == {("a", 1), ("a", 3), ("a", 6)}  # the earliest stays, then the smallest id; a null time is latest; a null identifier stays
    assert redelivered(df.limit(0), "k", "at", "id", group="tbl").count() == 0
    assert {r["id"] for r in redelivered(df.where("tbl = 'a'"), "k", "at", "id").collect()} == {1, 3, 6}


def test_a_hot_identifier(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, concat('k', id), 'hot') as k", "timestamp_seconds(id) as at")
    assert redelivered(df.repartition(6), "k", "at", "id").count() == 1999

from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from mirefold.llm.radix import Trie, collapse, copies


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=20), max_size=40))
def test_trie_counts(keys):
    t = Trie(pa.array(keys, pa.binary()), np.arange(len(keys)), np.ones(len(keys), np.int64))
    want = defaultdict(list)
    for i, k in enumerate(keys):
        want[k].append(i)
    got = dict(zip(t.keys.to_pylist(), zip(t.least.tolist(), t.count.tolist(), strict=True), strict=True))
    assert got == {k: (min(v), len(v)) for k, v in want.items()}


def test_splits_oversized_buckets(spark):
    texts = [f"https://shared.example/path/{i % 700}" for i in range(4000)] + ["https://hot.example"] * 2000 + ["", "a", "a\0"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, k string").selectExpr("id", "encode(k, 'UTF-8') as key", "k").repartition(5)
    want = defaultdict(list)
    for i, k in enumerate(texts):
        want[k.encode()].append(i)
    got = {bytes(r["key"]): (r["first_id"], r["copies"]) for r in collapse(df, bucket_bytes=500).collect()}
    assert got == {k: (min(v), len(v)) for k, v in want.items()}
    found = {(r["k"], r["first_id"]) for r in copies(df, ["k"], bucket_bytes=500).collect()}
    assert found == {(k.decode(), min(v)) for k, v in want.items() if len(v) > 1}


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, key binary")
    assert collapse(df).count() == 0 and copies(df).count() == 0

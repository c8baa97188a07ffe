"""Records that differ only in writing, collapsed and counted.

Canonical bytes are counted in tries: each task first counts its own rows,
then buckets of equal leading bytes are counted whole. A bucket over the size
limit is split by further bytes, again and again, until each fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirefold.session import partitions, written

#: Canonical bytes that one bucket may hold.
BUCKET_BYTES = 16 << 20
#: Rows and bytes that a task counts together before it hands on its counts.
LOCAL_ROWS, LOCAL_BYTES = 500_000, 64 << 20
#: Prefix lengths of successive splits; beyond the last each adds STEP bytes.
STEP = 4


class Trie:
    """A trie of keys with terminal counters, eight bytes an edge.

    All keys are inserted level by level: the rows still alive are grouped by
    (node, next eight bytes, bytes left up to eight), and each group is a
    child. A key's end is a terminal with its count and least number.
    """

    def __init__(self, keys: pa.Array, numbers: np.ndarray, counts: np.ndarray) -> None:
        keys = keys.cast(pa.large_binary())
        if keys.offset:
            keys = pa.concat_arrays([keys])
        n = len(keys)
        bounds = np.frombuffer(keys.buffers()[1], np.int64)[: n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer((keys.buffers()[2] or pa.py_buffer(b"")).to_pybytes() + b"\0" * 8, np.uint8)
        start, length = bounds[:-1], np.diff(bounds)
        terminal = np.full(n, -1, np.int64)
        alive, node, terminals, depth = np.arange(n), np.zeros(n, np.int64), 0, 0
        while len(alive):
            left = np.minimum(length[alive] - depth, 9)  # 9: goes on below this edge
            take = np.minimum(start[alive][:, None] + depth + np.arange(8), len(data) - 1)
            edge = np.where(np.arange(8) < left[:, None], data[take], 0).astype(np.uint8).copy().view(">u8")[:, 0]
            order = np.lexsort((left, edge, node))
            a, b, c = node[order], edge[order], left[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            child = np.empty(len(order), np.int64)
            child[order] = np.cumsum(new) - 1
            ends = left <= 8
            distinct, inverse = np.unique(child[ends], return_inverse=True)
            terminal[alive[ends]] = terminals + inverse
            terminals += len(distinct)
            alive, node, depth = alive[~ends], child[~ends], depth + 8
        self.count = np.zeros(terminals, np.int64)
        np.add.at(self.count, terminal, counts)
        self.least = np.full(terminals, np.iinfo(np.int64).max)
        np.minimum.at(self.least, terminal, numbers)
        self.example = np.zeros(terminals, np.int64)
        self.example[terminal] = np.arange(n)
        self.keys = keys.take(pa.array(self.example)).cast(pa.binary()) if n else pa.array([], pa.binary())

    def rows(self) -> list[pa.Array]:
        return [self.keys, pa.array(self.least), pa.array(self.count)]


_COUNTS = "key binary, first_id bigint, copies bigint"


def _counted_locally(keyed: DataFrame) -> DataFrame:
    """(key, first_id, copies) of each task's rows: a hot key leaves a task as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            numbers = t.column(1).to_numpy()
            keys = t.column(0).combine_chunks() if t.column(0).num_chunks != 1 else t.column(0).chunk(0)
            return pa.RecordBatch.from_arrays(Trie(keys, numbers, np.ones(len(numbers), np.int64)).rows(), names=["key", "first_id", "copies"])

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= LOCAL_ROWS or sum(x.nbytes for x in held) >= LOCAL_BYTES:
                yield flush()
                held.clear()
        if sum(map(len, held)):
            yield flush()

    return keyed.mapInArrow(run, _COUNTS)


def _oversized(counts: DataFrame, limit: int) -> list[tuple[int, list[bytes]]]:
    """Prefixes, by growing length, whose buckets exceed the limit.

    A level has at most total/limit of them, and the limit is at least an
    eighth of what a shuffle partition holds, so at most eight times as many
    prefixes as shuffle partitions come to the driver in a level. A bucket of
    one key that many tasks counted can't be split and isn't: it is merged
    as it comes.
    """
    spark, size = counts.sparkSession, F.length("key").cast("long")
    total, longest = counts.agg(F.sum(size), F.max(F.length("key"))).first()
    limit = max(limit, (total or 0) // (8 * partitions(spark)))
    levels: list[tuple[int, list[bytes]]] = [(0, [b""])] if (total or 0) > limit else []
    while levels and levels[-1][1] and levels[-1][0] < longest:
        depth, over = levels[-1]
        within = counts.select("key", size.alias("size"), F.xxhash64("key").alias("digest"))
        if depth:
            heavy = spark.createDataFrame([(bytearray(p),) for p in over], "prefix binary")
            within = within.withColumn("prefix", F.substring("key", 1, depth)).join(F.broadcast(heavy), "prefix", "left_semi")
        deeper = within.groupBy(F.substring("key", 1, depth + STEP).alias("p")).agg(F.sum("size").alias("size"), F.min("digest").alias("one"), F.max("digest").alias("other")).where((F.col("size") > limit) & (F.col("one") != F.col("other")))
        levels.append((depth + STEP, [bytes(r["p"]) for r in deeper.select("p").toLocalIterator()]))
    return levels[1:] if levels else []


def _bucketed(counts: DataFrame, levels: list[tuple[int, list[bytes]]]) -> DataFrame:
    """Adds the bucket: the shortest prefix that isn't oversized."""
    bucket = F.lit(b"")
    if levels:
        spark = counts.sparkSession
        over = spark.createDataFrame([(d, bytearray(p)) for d, ps in levels for p in ps] or [(0, bytearray(b"\0"))], "d int, p binary")
        depth = F.lit(STEP)
        out = counts
        for d, prefixes in levels:  # as many joins as levels, each with a side of bounded size
            if not prefixes:
                continue
            side = over.where(F.col("d") == d).select(F.col("p").alias(f"p{d}"))
            out = out.withColumn(f"k{d}", F.substring("key", 1, d)).join(F.broadcast(side), F.col(f"k{d}") == F.col(f"p{d}"), "left")
            depth = F.when(F.col(f"p{d}").isNotNull(), F.lit(d + STEP)).otherwise(depth)
        return out.withColumn("bucket", F.substring(F.col("key"), F.lit(1), depth)).select("bucket", *counts.columns)
    return counts.select(bucket.alias("bucket"), *counts.columns)


def collapse(keyed: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(key, first_id, copies): one row for each distinct key of keyed(key
    binary, id bigint), with the smallest id and the number of rows.

    Rows with a null key are left out; an empty key is a key like others; the
    keys may be of any length; an empty table gives no rows. The result is a
    table in the shared folder.
    """
    pairs = keyed.select(F.col("key"), F.col("id").cast("long").alias("id")).where("key is not null")
    local = written(_counted_locally(pairs), "radix")
    placed = _bucketed(local, _oversized(local, bucket_bytes)).repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            trie = Trie(t.column(1).chunk(0), t.column(2).to_numpy(), t.column(3).to_numpy())
            held.clear()
            return pa.RecordBatch.from_arrays(trie.rows(), names=["key", "first_id", "copies"])

        def merge(bucket: bytes) -> None:
            """Counts of one key that many tasks found become one row."""
            merged = flush()
            held.append(pa.RecordBatch.from_arrays([pa.array([bucket] * len(merged), pa.binary()), *merged.columns], names=["bucket", "key", "first_id", "copies"]))

        for b in batches:
            names = b.column(0)
            ends = np.flatnonzero(np.array(pa.compute.not_equal(names[1:], names[:-1]), dtype=bool)) + 1 if len(b) > 1 else np.zeros(0, int)
            for i, j in zip([0, *ends], [*ends, len(b)], strict=True):
                if j <= i:
                    continue
                if held and names[int(i)].as_py() != now:
                    yield flush()
                now = names[int(i)].as_py()
                held.append(b.slice(i, j - i))
                if len(held) % 64 == 0 and sum(x.nbytes for x in held) > LOCAL_BYTES:
                    merge(now)
        if held:
            yield flush()

    return written(placed.mapInArrow(run, _COUNTS), "collapsed")


def copies(keyed: DataFrame, others: list[str] | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows of keyed that are a copy of a row with a smaller id: their columns
    `others` (id by default) and first_id, the smallest id with the same key.

    The join that brings first_id back to the rows is on the whole key; AQE
    splits the partition of a hot key, whose other side is a single row.
    """
    others = others or ["id"]
    keyed = written(keyed.select("key", F.col("id").cast("long").alias("id"), *[c for c in others if c != "id"]).where("key is not null"), "keyed")  # the keys are made once
    first = collapse(keyed, bucket_bytes).where("copies > 1").select("key", "first_id")
    rows = keyed.select("key", F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}_out") for c in others])
    return rows.join(first, "key").where("__id <> first_id").select(*[F.col(f"__{c}_out").alias(c) for c in others], "first_id")

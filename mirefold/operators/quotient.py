"""One copy of each identifier, by exact quotient hash tables.

A fixed-width identifier (256 bits) is permuted by an invertible mixing of its
four words. The first QUOTIENT_BITS bits of the permuted number are the
quotient, which names the shard; the table keeps the complete remainder, so
that two entries are equal only if the identifiers are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirefold.session import written

QUOTIENT_BITS = 20
#: Entries a map-side table holds before it hands them on; the shards merge what several tables hold.
LOCAL_ENTRIES = 500_000
_ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_WORDS = ["q", "r0", "r1", "r2", "r3"]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(key)
    return x ^ (x >> np.uint64(32))


def permute(words: np.ndarray) -> np.ndarray:
    """A bijection on n x 4 words: a generalised Feistel network."""
    a, b, c, d = (words[:, i].astype(np.uint64) for i in range(4))
    for key in _ROUNDS * 2:
        a, b, c, d = b, c, d, a ^ _mix(b + c + d, key)
    return np.stack([a, b, c, d], axis=1)


def unpermute(words: np.ndarray) -> np.ndarray:
    a, b, c, d = (words[:, i].astype(np.uint64) for i in range(4))
    for key in reversed(_ROUNDS * 2):
        a, b, c, d = d ^ _mix(a + b + c, key), a, b, c
    return np.stack([a, b, c, d], axis=1)


def split(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quotient and complete remainder (n x 4) of identifiers."""
    p = permute(words)
    shift = np.uint64(64 - QUOTIENT_BITS)
    quotient = (p[:, 0] >> shift).astype(np.int64)
    p[:, 0] &= (np.uint64(1) << shift) - np.uint64(1)
    return quotient, p


class QuotientTable:
    """A hash table of quotients and complete remainders; of the entries of one
    identifier the one of least rank stays, the others are lost.

    Slots are probed one after the other from the place that the remainder
    names; all entries of a batch are probed together, so that a round costs a
    few array operations and there are as many rounds as the longest probe.
    """

    def __init__(self, ranks: int) -> None:
        self.slots = np.full(1024, -1, np.int64)  # number of the entry, or -1
        self.columns = [np.zeros(0, np.int64)] + [np.zeros(0, np.uint64)] * 4 + [np.zeros(0, np.int64)] * ranks
        self.lost = np.zeros(0, bool)

    def __len__(self) -> int:
        return len(self.lost)

    def insert(self, columns: list[np.ndarray]) -> None:
        """Entries as quotient, four words of the remainder, and ranks."""
        n = len(self)
        self.columns = [np.concatenate([mine, new.astype(mine.dtype, copy=False)]) for mine, new in zip(self.columns, columns, strict=True)]
        self.lost = np.r_[self.lost, np.zeros(len(columns[0]), bool)]
        new = np.arange(n, len(self))
        if 2 * len(self) > len(self.slots):
            self.slots = np.full(1 << int(4 * len(self)).bit_length(), -1, np.int64)
            new = np.r_[np.flatnonzero(~self.lost[:n]), new]
        self._place(new)

    def _place(self, entries: np.ndarray) -> None:
        mask, words = len(self.slots) - 1, self.columns[:5]
        at = (self.columns[4][entries] & np.uint64(mask)).astype(np.int64)
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free][::-1]] = entries[free][::-1]
            there = self.slots[at]
            same = there != entries
            for w in words:
                same &= w[there] == w[entries]
            if same.any():
                self._merge(entries[same], at[same])
            goes_on = (there != entries) & ~same
            entries, at = entries[goes_on], (at[goes_on] + 1) & mask

    def _merge(self, entries: np.ndarray, at: np.ndarray) -> None:
        """Entries whose identifier is in the slot already: the least rank takes it."""
        slots = np.unique(at)
        entries, at = np.r_[entries, self.slots[slots]], np.r_[at, slots]
        order = np.lexsort([*(c[entries] for c in self.columns[:4:-1]), at])
        entries, at = entries[order], at[order]
        first = np.r_[True, at[1:] != at[:-1]]
        self.slots[at[first]] = entries[first]
        self.lost[entries[~first]] = True


def redelivered(df: DataFrame, identifier: str, order: str, row_id: str, group: str | None = None) -> DataFrame:
    """Rows of df that must go so that one row of each identifier remains: all
    but the one with the earliest `order`, then the smallest `row_id`.

    `identifier` is a string (equal strings are the same message); null keeps
    the row. `group` names a column whose values are deduplicated apart from
    each other. A null `order` counts as latest. `row_id` is a whole number,
    unique within a group. The result has the columns `group` (where given)
    and `row_id`. Each task keeps a bounded table and hands on one entry of an
    identifier, so one delivered millions of times moves as one row a task;
    what loses in a task's table or in a shard's is the result, and no join is
    needed. No shuffle is keyed by the identifier itself.
    """
    keys = ([group] if group else []) + [row_id]
    parts = ([F.coalesce(F.col(group).cast("string"), F.lit("\x00")), F.lit("\x01")] if group else []) + [F.col(identifier)]
    digest = F.unhex(F.sha2(F.concat(*parts), 256))
    when = F.unix_micros(order) if df.schema[order].dataType.typeName() == "timestamp" else F.col(order).cast("long")
    names = ["__when", "__number"]
    ranks = [F.coalesce(when, F.lit(2**63 - 1)).alias("__when"), F.col(row_id).cast("long").alias("__number")]
    rows = df.where(F.col(identifier).isNotNull()).select(digest.alias("__digest"), *ranks, *[F.col(k) for k in keys])
    carried = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = ", ".join([f"{c} bigint" for c in (*_WORDS, *names)] + [carried])

    def numbers(b: pa.RecordBatch) -> list[np.ndarray]:
        return [b.column(n).to_numpy(zero_copy_only=False) for n in names]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = [], QuotientTable(len(names))

        def hand_on() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            words = [pa.array(c.view(np.int64)) for c in table.columns[:5]]
            out = pa.RecordBatch.from_arrays([*words, *rows[0].columns[1:], pa.array(table.lost)], names=[*_WORDS, *names, *keys, "__lost"])
            return out

        for b in batches:
            if not len(b):
                continue
            ids = b.column(0).cast(pa.binary(32))
            words = np.frombuffer(ids.buffers()[1], dtype=">u8", offset=ids.offset * 32, count=len(ids) * 4).reshape(-1, 4)
            quotient, rest = split(words)
            table.insert([quotient, *rest.T, *numbers(b)])
            held.append(b)
            if len(table) > LOCAL_ENTRIES:
                yield hand_on()
                held, table = [], QuotientTable(len(names))
        if held:
            yield hand_on()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: pa.RecordBatch | None = None

        def losers(b: pa.RecordBatch) -> pa.RecordBatch:
            table = QuotientTable(len(names))
            words = [b.column(c).to_numpy(zero_copy_only=False) for c in _WORDS]
            table.insert([words[0], *(w.view(np.uint64) for w in words[1:]), *numbers(b)])
            return b.filter(pa.array(table.lost)).select(keys)

        for b in batches:  # ordered by quotient, so all but the last quotient of a batch is complete
            if not len(b):
                continue
            if pending is not None:
                b = pa.Table.from_batches([pending, b]).combine_chunks().to_batches()[0]
            quotient = b.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(quotient, quotient[-1]))
            yield losers(b.slice(0, cut))
            pending = b.slice(cut)
        if pending is not None:
            yield losers(pending)

    told = written(rows.mapInArrow(local, f"{schema}, __lost boolean"), "quotients")
    shards = told.where("not __lost").drop("__lost").repartition(F.col("q")).sortWithinPartitions("q")
    return told.where("__lost").select(*keys).unionByName(shards.mapInArrow(merge, carried))

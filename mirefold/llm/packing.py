"""Texts put together in containers of fixed capacity, with little room left."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirefold.session import partitions

#: Rows of a group that is packed on its own; a group's last container is all that can be left half empty.
GROUP_ROWS = 20_000


def fullest(lengths: list[int], counts: list[int], room: int) -> dict[int, int]:
    """The part {length: count} of a multiset of lengths whose sum comes
    closest to room without exceeding it.

    Subset sums are the bits of one integer. A length with count n enters in
    portions of 1, 2, 4, ... copies; the bits before each portion are kept, so
    the counts are traced back from the best sum. The window of lengths ends
    where room is reached exactly.
    """
    mask, full = (1 << (room + 1)) - 1, 1 << room
    bits, steps = 1, []
    for length, count in zip(lengths, counts, strict=True):
        portion = 1
        while count and portion * length <= room:
            take = min(portion, count)
            grown = bits | (bits << (take * length)) & mask
            if grown != bits:
                steps.append((bits, take, length))
                bits = grown
            count -= take
            portion *= 2
        if bits & full:
            break
    left = bits.bit_length() - 1
    out: dict[int, int] = {}
    for earlier, take, length in reversed(steps):
        if not earlier >> left & 1:
            out[length] = out.get(length, 0) + take
            left -= take * length
    return out


def patterns(sizes: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Container contents {length: count} with how often each is used, by
    minimum bin slack: the longest length left is set, then the rest of the
    container is filled from the lengths left.
    """
    distinct, count = np.unique(sizes[sizes > 0], return_counts=True)
    left = dict(zip(distinct[::-1].tolist(), count[::-1].tolist(), strict=True))
    out = []
    while left:
        seed = next(iter(left))
        left[seed] -= 1
        others = [(s, n) for s, n in left.items() if n and s <= capacity - seed]
        fill = fullest([s for s, _ in others], [n for _, n in others], capacity - seed)
        left[seed] += 1
        fill[seed] = fill.get(seed, 0) + 1
        times = min(left[s] // n for s, n in fill.items())
        for s, n in fill.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out.append((fill, times))
    return out


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (from 0) of each item; items of size 0 go into container 0."""
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    at = {int(s): int(i) for s, i in zip(*np.unique(ordered, return_index=True), strict=True)}
    out, container = np.zeros(len(sizes), np.int64), 0
    for fill, times in patterns(sizes, capacity):
        for _ in range(times):
            for s, n in fill.items():
                out[order[at[s] : at[s] + n]] = container
                at[s] += n
            container += 1
    return out


def _parts(raw: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, bytes) of the parts of a text over the capacity; no character is cut."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + capacity, len(raw))
        cut = end
        while cut > at and cut < len(raw) and raw[cut] & 0xC0 == 0x80:
            cut -= 1
        end = cut if cut > at else end
        out.append((at, end - at))
        at = end
    return out


def packed(df: DataFrame, row_id: str, text: str, capacity: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row a text, or a part of one: row_id, part_no (from 1), start_byte,
    n_tokens and container_id.

    A token is a byte of the UTF-8 form. Only texts over the capacity are
    divided, into full parts and a rest that is packed like a text. Null texts
    give no row; empty ones are in the first container of their group; ties in
    size are taken in the order of row_id; repeated rows are packed each.
    Texts are dealt to groups of about group_rows by a hash of row_id, so no
    group grows with the data, and only sizes are shuffled.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    key = df.schema[row_id].dataType.simpleString()
    groups = max(1, math.ceil(df.count() / group_rows))
    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("t"), F.pmod(F.xxhash64(F.col(row_id)), F.lit(groups)).alias("g")).where("t is not null")
    small = rows.where(F.octet_length("t") <= capacity).select("g", "row_id", F.lit(1).alias("part_no"), F.lit(0).cast("long").alias("start_byte"), F.octet_length("t").alias("n_tokens"))

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, part, start, size = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, (s, n) in enumerate(_parts(t.encode(), capacity), 1):
                    at.append(i)
                    part.append(k)
                    start.append(s)
                    size.append(n)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(2).take(take), b.column(0).take(take), pa.array(part, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32())], names=["g", "row_id", "part_no", "start_byte", "n_tokens"])

    large = rows.where(F.octet_length("t") > capacity).mapInArrow(divide, f"g bigint, row_id {key}, part_no int, start_byte bigint, n_tokens int")

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["row_id", "part_no"], kind="stable")
        group["container_id"] = (group["g"].to_numpy(np.int64) << 32) + assign(group["n_tokens"].to_numpy(np.int64), capacity)
        return group[["row_id", "part_no", "start_byte", "n_tokens", "container_id"]]

    tasks = min(groups, 8 * partitions(df.sparkSession))  # a stated number: small rows, much work, so AQE must not join the groups in one task
    out = small.unionByName(large).repartition(tasks, "g").groupBy("g").applyInPandas(fill, f"row_id {key}, part_no int, start_byte bigint, n_tokens int, container_id bigint")
    return out.withColumnRenamed("row_id", row_id)

"""Oversized texts as pieces, cut at natural boundaries, with an overlap."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of the boundary after a segment: a cut inside a word is the weakest.
INSIDE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
_LINE = re.compile(rb"[^\n]*\n+|[^\n]+")
# What ends a sentence, a clause and a word; each is found in one forward scan.
_SENTENCE, _CLAUSE, _WORD = re.compile(rb"[.!?]\s+"), re.compile(rb"[,;:]\s+"), re.compile(rb"(?<=\S)\s+")


def _hard(text: bytes, room: int) -> list[bytes]:
    """Cuts of at most room bytes, never inside a character that fits."""
    out, at = [], 0
    while at < len(text):
        end = min(at + room, len(text))
        cut = end
        while cut > at and cut < len(text) and text[cut] & 0xC0 == 0x80:
            cut -= 1
        end = cut if cut > at else end
        out.append(text[at:end])
        at = end
    return out


def atoms(text: bytes, room: int) -> list[tuple[int, int]]:
    """(bytes, strength of the boundary after it) of the segments to begin with.

    Lines are broken into sentences; only what is still longer than room is
    broken further, into clauses, words and at last anywhere.
    """
    out: list[tuple[int, int]] = []

    def put(part: bytes, after: int, rules: tuple) -> None:
        if len(part) <= room and len(rules) < 3:
            out.append((len(part), after))
        elif not rules:
            cuts = _hard(part, room)
            out.extend((len(c), INSIDE) for c in cuts[:-1])
            out.append((len(cuts[-1]), after))
        else:
            (rule, strength), rest = rules[0], rules[1:]
            ends = [m.end() for m in rule.finditer(part)]
            if not ends or ends[-1] < len(part):
                ends.append(len(part))
            parts = [part[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            for p in parts[:-1]:
                put(p, strength, rest)
            put(parts[-1], after, rest)

    rules = ((_SENTENCE, SENTENCE), (_CLAUSE, CLAUSE), (_WORD, WORD))
    for line in _LINE.findall(text):
        put(line, PARAGRAPH if line.endswith(b"\n\n") or line.endswith(b"\r\n\r\n") else LINE, rules)
    return out


def merged(sizes: list[tuple[int, int]], room: int) -> list[int]:
    """Sizes of the bodies after agglomerative merging: the weakest boundary
    first (then the smallest pair, then the earlier), while a pair fits.
    """
    n = len(sizes)
    size, strength = [s for s, _ in sizes], [b for _, b in sizes]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(strength[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, both, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or after[i] != j or size[i] + size[j] != both or both > room:
            continue
        size[i], strength[i], alive[j] = both, strength[j], False
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
            heapq.heappush(heap, (strength[i], both + size[after[i]], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(heap, (strength[before[i]], size[before[i]] + both, before[i], i))
    out, i = [], 0
    while i >= 0 and n:
        out.append(size[i])
        i = after[i]
    return out


def _overlap_start(text: bytes, floor: int, start: int, overlap: int) -> int:
    """Where the overlap before start begins: at most overlap bytes back, at
    the first line or word in there, but no earlier than floor.
    """
    low = max(floor, start - overlap)
    while low < start and text[low] & 0xC0 == 0x80:
        low += 1
    if low == floor or overlap <= 0:
        return low
    window = text[low:start]
    for mark in (b"\n", b" "):
        at = window.find(mark, 0, max(1, len(window) // 4))
        if at >= 0:
            return low + at + 1
    return low


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, body start, end) in UTF-8 bytes of the pieces of a text.

    The bodies follow each other without gap; a piece is its body and the
    overlap before it, together at most limit bytes.
    """
    raw = text.encode()
    if len(raw) <= limit:
        return [(0, 0, len(raw))]
    if not 0 <= overlap <= limit - 4:
        raise ValueError("the limit must leave room for a character beside the overlap")
    room = limit - overlap
    out, at, floor = [], 0, 0
    for body in merged(atoms(raw, room), room):
        start = _overlap_start(raw, floor, at, overlap) if at else 0
        out.append((start, at, at + body))
        floor, at = start, at + body
    return out


def split_texts(df: DataFrame, row_id: str, text: str, limit: int, overlap: int = 0, with_text: bool = True) -> DataFrame:
    """One row a piece: row_id, piece_no (from 1), n_pieces, start_byte,
    overlap_tokens (shared with the piece before), n_tokens and the text.

    A token is a byte of the UTF-8 form. Texts within the limit are one piece
    and never leave the JVM; an empty text is one piece of 0 tokens, a null
    one gives no row; texts of any length are cut whole; repeated rows are cut
    alike. Pieces without their overlaps, one after the other, are the text.
    """
    key = df.schema[row_id].dataType.simpleString()
    wide = ", piece_text string" if with_text else ""
    rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("t")).where("t is not null")
    whole = rows.where(F.octet_length("t") <= limit).select(
        "row_id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("start_byte"), F.lit(0).alias("overlap_tokens"), F.octet_length("t").alias("n_tokens"), *([F.col("t").alias("piece_text")] if with_text else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, number, total, start_byte, shared, tokens, texts = [], [], [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                cut = pieces_of(t, limit, overlap)
                raw = t.encode() if with_text else b""
                for k, (start, body, end) in enumerate(cut, 1):
                    at.append(i)
                    number.append(k)
                    total.append(len(cut))
                    start_byte.append(start)
                    shared.append(body - start)
                    tokens.append(end - start)
                    if with_text:
                        texts.append(raw[start:end].decode())
            columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(total, pa.int32()), pa.array(start_byte, pa.int64()), pa.array(shared, pa.int32()), pa.array(tokens, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if with_text else []), names=["row_id", "piece_no", "n_pieces", "start_byte", "overlap_tokens", "n_tokens"] + (["piece_text"] if with_text else []))

    schema = f"row_id {key}, piece_no int, n_pieces int, start_byte bigint, overlap_tokens int, n_tokens int{wide}"
    cut = rows.where(F.octet_length("t") > limit).mapInArrow(run, schema)
    return whole.unionByName(cut).withColumnRenamed("row_id", row_id)

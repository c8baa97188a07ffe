"""Several values packed in one field, one value a row.

Every field is parsed under candidate dialects (which delimiters it uses,
whether quotes and angle brackets enclose values), and the dialect with the
shortest description wins. A value that recurs costs the code length of its
share of all values; another one is spelled out: its characters, and the code
length of its skeleton, the value with each run of ordinary characters written
as w. Both lengths come from counts over all fields that every dialect reads
alike.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = " ,;|"
#: Skeletons of more symbols share so many entries of a code book by a hash; shorter ones have one each (4**6 at most).
COUNTED, HASHED = 6, 4096
#: A value is in the code book from so many uses and this share of all on, so a book has at most 1/share values.
RECURS, RECURS_SHARE = 5, 1e-5
CHARACTER_BITS = 5  # an ordinary character
SPELLED_BITS = 8  # a symbol of a skeleton that isn't in the code book
ENCLOSED_BITS = 3  # a symbol inside quotes or brackets, where delimiters are usual
KIND_BITS = 2  # plain, quoted or in brackets
_TOKEN = re.compile(r'\s+|[,;|"<>]|[^\s,;|"<>]+', re.ASCII)
#: What a field must contain to be read as more than one value by any dialect.
PACKED = r'[\s,;|]|><|""'


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def skeleton(tokens: list[str]) -> str:
    """One symbol a token: blank, delimiter, quote or bracket as it is, w for the rest (@ where the run begins with it)."""
    return "".join(" " if t.isspace() else t if t in ',;|"<>' else "@" if t[0] == "@" else "w" for t in tokens)


def parse(symbols: str, delimiters: str, quotes: bool, brackets: bool, adjacent: bool) -> tuple[list[tuple[int, int, str]], int] | None:
    """The values (from, to, kind) of a skeleton under a dialect, and how many
    delimiters it used; None where the field breaks the dialect's rules.
    """
    values: list[tuple[int, int, str]] = []
    i, used, n = 0, 0, len(symbols)
    while i < n:
        c = symbols[i]
        if c == " " or c in delimiters:
            used += c in delimiters
            i += 1
            continue
        start, kind = i, "plain"
        if quotes and c == '"':
            i += 1
            while i < n and (symbols[i] != '"' or symbols[i : i + 2] == '""'):
                i += 2 if symbols[i] == '"' else 1
            if i >= n:
                return None
            i += 1
            kind = "quoted"
            if i < n and symbols[i] == "@":  # a quoted local part of an address
                kind, i = "plain", i + 1
        elif brackets and c == "<":
            inside = False
            while i < n and (symbols[i] != ">" or inside):
                inside ^= symbols[i] == '"'
                i += 1
            if i >= n:
                return None
            i += 1
            kind = "bracket"
        if kind == "plain":
            while i < n and symbols[i] not in delimiters:
                i += 1
            end = i
            while symbols[end - 1] == " ":
                end -= 1
            values.append((start, end, kind))
        else:
            values.append((start, i, kind))
            if i < n and symbols[i] != " " and symbols[i] not in delimiters:
                if not (adjacent and symbols[i] == "<"):
                    return None
                used += 1
            elif i < n and " " not in delimiters:  # padding may follow, then a delimiter must
                j = i
                while j < n and symbols[j] == " ":
                    j += 1
                if j < n and symbols[j] not in delimiters:
                    return None
    return values, used


def _entry(symbols: str) -> str:
    """The code book's entry of a skeleton."""
    return symbols if len(symbols) <= COUNTED else f"#{zlib.crc32(symbols.encode()) % HASHED}"


class CodeBook:
    """Code lengths of skeletons, and of values that recur, from their counts over the corpus."""

    def __init__(self, counts: dict[str, int], values: dict[int, int] | None = None) -> None:
        self.total = sum(counts.values())
        self.bits = {s: math.log2((self.total + 2) / n) for s, n in counts.items() if n}
        self.escape = math.log2(self.total + 2)
        self.values = {v: math.log2((self.total + 2) / n) for v, n in (values or {}).items()}

    def plain(self, symbols: str) -> float:
        return self.bits.get(_entry(symbols), self.escape + SPELLED_BITS * len(symbols))

    def enclosed(self, symbols: str) -> float:
        return min(self.bits.get(_entry(symbols), math.inf), ENCLOSED_BITS * len(symbols))


def parses(symbols: str, book: CodeBook) -> list[tuple[float, list[tuple[int, int, float]]]]:
    """The different parses of a skeleton, each with the bits of the cheapest
    dialect that makes it (without its values) and per value (from, to, bits
    of its kind and skeleton); fewer delimiters and enclosures come first.
    """
    present = [d for d in DELIMITERS if d in symbols]  # a delimiter that doesn't occur only lengthens the dialect
    found: dict[tuple, tuple[float, list[tuple[int, int, float]]]] = {}
    for size in range(len(present) + 1):
        for chosen in itertools.combinations(present, size):
            for quotes, brackets, adjacent in ((False, False, False), (True, False, False), (False, True, False), (True, True, False), (False, True, True), (True, True, True)):
                if (quotes and '"' not in symbols) or (brackets and "<" not in symbols) or (adjacent and "><" not in symbols):
                    continue
                read = parse(symbols, "".join(chosen), quotes, brackets, adjacent)
                if read is None:
                    continue
                values, used = read
                bits = size + quotes + brackets + adjacent + used * math.log2(size + adjacent + 1)
                if tuple(values) not in found or bits < found[tuple(values)][0] - 1e-9:
                    each = []
                    for start, end, kind in values:
                        text = symbols[start:end].replace("@", "w")
                        each.append((start, end, KIND_BITS + (book.plain(text) if kind == "plain" else book.enclosed(text[1:-1]))))
                    found[tuple(values)] = bits, each
    return list(found.values()) or [(0.0, [(0, len(symbols), 0.0)])]


def cheapest(tokens: list[str], options: list[tuple[float, list[tuple[int, int, float]]]], book: CodeBook) -> list[str]:
    """The values of a field under the parse of least description length."""
    best: list[str] = []
    least = math.inf
    for bits, values in options:
        texts = []
        for start, end, skeleton_bits in values:
            raw = "".join(tokens[start:end])
            texts.append(raw)
            spelled = skeleton_bits + CHARACTER_BITS * len(raw)
            if book.values:
                known = book.values.get(zlib.crc32(bare(raw).encode("utf-8", "surrogatepass")))
                spelled = spelled if known is None else min(spelled, KIND_BITS + known)
            bits += spelled
        bits += CHARACTER_BITS * (sum(map(len, tokens)) - sum(map(len, texts)))  # what lies between the values is written, too
        if bits < least - 1e-9:
            best, least = texts, bits
    return best


def bare(value: str) -> str:
    """A value without surrounding white space, enclosing quotes and brackets."""
    while True:
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] == '"' and '"' not in value[1:-1].replace('""', ""):
            value = value[1:-1].replace('""', '"')
            return bare(value) if value.startswith("<") else value.strip()
        if len(value) > 1 and value[0] == "<" and value[-1] == ">" and not ({"<", ">"} & set(value[1:-1])):
            value = value[1:-1]
            return value.strip()
        return value


class Splitter:
    """Splits fields of one column; the parses of a skeleton are made once."""

    def __init__(self, counts: dict[str, int], values: dict[int, int] | None = None) -> None:
        self.book = CodeBook(counts, values)
        self.parses = functools.lru_cache(maxsize=200_000)(lambda s: parses(s, self.book))

    def __call__(self, text: str) -> list[str]:
        tokens = _tokens(text)
        options = self.parses(skeleton(tokens))
        found = cheapest(tokens, options, self.book) if len(options) > 1 else ["".join(tokens[a:b]) for a, b, _ in options[0][1]]
        return [value for raw in found if (value := bare(raw))]


def code_counts(df: DataFrame, fields: dict[str, Column]) -> dict[str, tuple[dict[str, int], dict[int, int]]]:
    """Per field the counts of skeletons and of recurring values (by CRC-32)
    over all fields that every dialect reads as one value.

    One distributed count over all rows; each field contributes at most
    4**COUNTED + HASHED skeletons and 1/RECURS_SHARE values, which come to the
    driver.
    """
    exploded = None
    for name, column in fields.items():
        kind = df.select(column.alias("c")).schema["c"].dataType.typeName()
        each = df.select(F.lit(name).alias("f"), (F.explode(column) if kind == "array" else column).alias("v"))
        exploded = each if exploded is None else exploded.unionByName(each)
    single = exploded.select("f", F.trim("v").alias("v")).where(F.col("v").isNotNull() & (F.col("v") != "") & ~F.col("v").rlike(PACKED))
    bones = F.regexp_replace("v", r'[^\s,;|"<>]+', "w")
    entry = F.when(F.length(bones) <= COUNTED, bones).otherwise(F.concat(F.lit("#"), (F.crc32(F.encode(bones, "UTF-8")) % HASHED).cast("string")))
    out: dict[str, tuple[dict[str, int], dict[int, int]]] = {name: ({}, {}) for name in fields}
    for r in single.groupBy("f", entry.alias("s")).count().toLocalIterator():
        out[r["f"]][0][r["s"]] = r["count"]
    total = max((sum(c.values()) for c, _ in out.values()), default=0)
    value = F.crc32(F.encode(F.regexp_replace("v", r'^"?<|>"?$|^"|"$', ""), "UTF-8"))
    recurring = single.groupBy("f", value.alias("c")).count().where(F.col("count") >= max(RECURS, RECURS_SHARE * total))
    for r in recurring.toLocalIterator():
        out[r["f"]][1][r["c"]] = r["count"]
    return out


def split_packed(df: DataFrame, row_id: str, fields: dict[str, Column], counts: dict[str, tuple[dict[str, int], dict[int, int]]] | None = None) -> DataFrame:
    """One row (row_id, field_name, pos, value) for each value of each field
    that packs more than one.

    A field is a string or an array of strings; an array counts if at least
    one of its elements packs several values, and all its values are numbered
    through. Null, empty and blank fields and elements hold no value; texts
    of any length are read whole; a field that no dialect can split (an open
    quote, say) is one value under the plain dialect unless its delimiters
    split it cheaper. Repeated values keep their places.
    """
    counts = counts if counts is not None else code_counts(df, fields)
    key = df.schema[row_id].dataType.simpleString()
    parts = []
    for name, column in fields.items():
        kind = df.select(column.alias("c")).schema["c"].dataType.typeName()
        as_array = column if kind == "array" else F.array(column)
        may = F.exists(as_array, lambda x: F.trim(x).rlike(PACKED))
        parts.append(F.struct(F.lit(name).alias("name"), F.when(F.coalesce(may, F.lit(False)), as_array).alias("v")))
    candidates = df.select(F.col(row_id).alias("row_id"), F.explode(F.array(*parts)).alias("p")).select("row_id", "p.name", "p.v").where("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = {name: Splitter(*c) for name, c in counts.items()}
        for b in batches:
            names, rows = b.column(1).to_pylist(), b.column(2).to_pylist()
            at, out_names, pos, values = [], [], [], []
            for i, (name, elements) in enumerate(zip(names, rows, strict=True)):
                found = [split[name](e) for e in elements if e]
                if any(len(f) > 1 for f in found):
                    flat = [v for f in found for v in f]
                    at += [i] * len(flat)
                    out_names += [name] * len(flat)
                    pos += range(1, len(flat) + 1)
                    values += flat
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(out_names, pa.string()), pa.array(np.array(pos, np.int32)), pa.array(values, pa.string())], names=["row_id", "field_name", "pos", "value"])

    return candidates.mapInArrow(run, f"row_id {key}, field_name string, pos int, value string")

"""One common form for text that looks the same.

A column becomes one numpy array of code points; lookup tables (built from
the Unicode character database by rule) say what each code point is, and
gathers, expansion offsets and run sums do the rest. No string is handled by
itself.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirefold.functions.codepoints import explode_codepoints, pack_codepoints

LAST = 0xE0200  # beyond it are only characters for private use, which stand for themselves
#: Ranges without a character that needs a look-up: ideographs, syllables, surrogates and private use; and what isn't assigned.
PLAIN_RANGES = ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0xD800, 0xF900), (0x20000, 0x2F800), (0x2FA20, 0x32400))
EMPTY_RANGE = (0x32400, 0xE0000)
# Letters that look like a Latin one, by pairs (letter, Latin).
LATIN_TWINS = (
    "аa вb еe кk мm нh оo рp сc тt уy хx іi їi јj ѕs ԁd һh ԛq ԝw ѵv ӏl ɡg пn гr ьb зz "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW ҺH ӀI ѴV ГT ЬB ЗZ "
    "αa βb γy εe ηn ιi κk νv οo ρp τt υu χx ωw ϲc ϳj "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "
    "օo սu հh ոn յj ցg զq տs ւi ɑa ꞓc"
)
# Signs with a compatibility form that ordinary text uses as they are.
ORDINARY_SIGNS = "…№™℠℡ªº¹²³¼½¾µ´¨¯¸·"
MARK_RANGES = ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "HEBREW", "ARABIC", "CHEROKEE", "GEORGIAN", "COPTIC", "LISU")
LATIN, CYRILLIC = 1, 2


class Tables:
    """Arrays over code points: kind flags, script, and flattened expansions."""

    def __init__(self) -> None:
        self.invisible = np.zeros(LAST + 1, bool)
        self.space = np.zeros(LAST + 1, bool)
        self.variant = np.zeros(LAST + 1, bool)
        self.mark = np.zeros(LAST + 1, bool)
        self.letter = np.zeros(LAST + 1, bool)
        self.order = np.zeros(LAST + 1, np.uint8)  # canonical combining class
        self.script = np.zeros(LAST + 1, np.uint8)  # 0: common
        expansions: dict[int, str] = {}
        pairs: dict[int, int] = {}
        for a, b in MARK_RANGES:
            self.mark[a : b + 1] = True
        for a, b in PLAIN_RANGES:
            self.letter[a:b] = a != 0xD800
        for c in _looked_up():
            s = chr(c)
            kind = unicodedata.category(s)
            if kind == "Cn":
                continue
            self.letter[c] = kind[0] == "L"
            self.order[c] = unicodedata.combining(s)
            if (kind == "Cf" and c > 0x7F and not 0x600 <= c <= 0x8FF) or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF or c in (0x34F, 0x115F, 0x1160, 0x3164, 0xFFA0):
                self.invisible[c] = True
                continue
            if kind == "Zs" and c != 0x20:
                self.space[c] = True
                continue
            if kind[0] == "L" and kind != "Lm":
                word = unicodedata.name(s, "").removeprefix("FULLWIDTH ").removeprefix("HALFWIDTH ").partition(" ")[0]
                self.script[c] = SCRIPTS.index(word) + 1 if word in SCRIPTS else 0
            plain, how = unicodedata.normalize("NFKC", s), unicodedata.decomposition(s)
            if how.startswith("<") and s not in ORDINARY_SIGNS and plain != s and (how.startswith(("<wide>", "<narrow>")) or (plain.isalnum() and c > 0xFF)):
                self.variant[c] = True
                expansions[c] = unicodedata.normalize("NFKD", s)
                if len(plain) == 1:
                    self.script[c] = self.script[ord(plain)] or self.script[c]
            elif how and not how.startswith("<"):
                if unicodedata.normalize("NFC", s) != s:
                    self.variant[c] = " " not in how  # a letter with a second code, as the Kelvin sign
                expansions[c] = unicodedata.normalize("NFD", s)
                parts = [int(x, 16) for x in how.split()]
                if len(parts) == 2 and unicodedata.normalize("NFC", s) == s:
                    pairs[parts[0] << 21 | parts[1]] = c
        self.script[ord("µ")] = 0
        self.length = np.ones(LAST + 1, np.uint8)
        flat: list[int] = []
        self.start = np.zeros(LAST + 1, np.int32)
        for c, text in expansions.items():
            self.length[c], self.start[c] = len(text), len(flat)
            flat += map(ord, text)
        self.flat = np.array(flat, np.uint32)
        for lead in range(19):  # Hangul: a consonant and a vowel, then a consonant after them
            for vowel in range(21):
                both = 0xAC00 + (lead * 21 + vowel) * 28
                pairs[(0x1100 + lead) << 21 | (0x1161 + vowel)] = both
                pairs |= {both << 21 | (0x11A7 + tail): both + tail for tail in range(1, 28)}
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_values = keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)
        self.to_latin, self.to_cyrillic = np.zeros(LAST + 1, np.uint32), np.zeros(LAST + 1, np.uint32)
        for letter, latin in LATIN_TWINS.split():
            self.to_latin[ord(letter)] = ord(latin)
            if self.script[ord(letter)] == CYRILLIC and not self.to_cyrillic[ord(latin)]:
                self.to_cyrillic[ord(latin)] = ord(letter)


def _looked_up() -> Iterator[int]:
    bounds = sorted([*PLAIN_RANGES, EMPTY_RANGE])
    at = 0
    for a, b in bounds:
        yield from range(at, a)
        at = b
    yield from range(at, LAST)


@functools.cache
def tables() -> Tables:
    return Tables()


def _rows(offsets: np.ndarray) -> np.ndarray:
    """The row of each code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _any(flag: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row[flag], minlength=n) > 0


def _letter_runs(t: Tables, c: np.ndarray, row: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of letters and the number of the unbroken run each is in;
    invisible characters and marks (skip) don't break a run.
    """
    seen = np.flatnonzero(~skip)
    letters = t.letter[c[seen]]
    new = np.ones(len(seen), bool)
    new[1:] = ~letters[:-1] | (row[seen][1:] != row[seen][:-1])
    run = np.cumsum(new | ~letters)
    return seen[letters], run[letters]


def variant_flags(column: pa.Array) -> np.ndarray:
    """Per row, as bits: 1 variant forms, 2 accents apart from their letter,
    4 invisible characters, 8 other spaces, 16 letters of several scripts in
    one unbroken run.
    """
    t = tables()
    points, offsets = explode_codepoints(column)
    n, c = len(offsets) - 1, np.minimum(points, LAST)
    row = _rows(offsets)
    out = _any(t.variant[c], row, n) * 1
    mark = t.mark[c]
    if mark.any():
        after = np.zeros(len(c), bool)
        after[1:] = t.letter[c[:-1]] | mark[:-1]
        first = np.zeros(len(c), bool)
        first[offsets[:-1][offsets[:-1] < len(c)]] = True
        out |= _any(mark & after & ~first, row, n) * 2
    out |= _any(t.invisible[c], row, n) * 4
    out |= _any(t.space[c], row, n) * 8
    at, run = _letter_runs(t, c, row, t.invisible[c] | mark)
    if len(at):
        script = t.script[c[at]].astype(np.int64)
        known = script > 0
        at, run, script = at[known], run[known], script[known]
        if len(at):
            start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            mixed = np.maximum.reduceat(script, start) != np.minimum.reduceat(script, start)
            out |= _any(np.isin(np.arange(n), row[at[start[mixed]]])[row], row, n) * 16 if mixed.any() else 0
    return out


def _composed(t: Tables, points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks composed with their starter, from left to right.

    A mark reaches its starter over marks of lower class that stay; each mark
    is tried once. In a round every starter takes the first mark that it
    composes with, so there are as many rounds as the most marks on a letter.
    """
    tried = np.zeros(len(points), bool)
    while len(points) > 1:
        order = t.order[np.minimum(points, LAST)]
        place = np.arange(len(points))
        starts = (order == 0) | np.r_[True, row[1:] != row[:-1]]
        before = np.maximum.accumulate(np.where(starts, place, 0))  # the starter of each mark
        starter = np.where(starts, np.maximum(place - 1, 0), before)
        same = row[starter] == row
        near = starter == place - 1
        reach = near & starts[starter] | ~starts & (np.r_[0, order[:-1]] < order)
        key = points[starter].astype(np.int64) << 21 | points.astype(np.int64)
        where = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        hit = np.flatnonzero((t.pair_keys[where] == key) & same & reach & ~tried & (place > 0))
        if not len(hit):
            break
        consumed = np.zeros(len(points), bool)
        consumed[hit] = starts[hit]
        hit = hit[~consumed[starter[hit]]]  # what is about to join another one waits
        hit = hit[np.r_[True, starter[hit[1:]] != starter[hit[:-1]]]]
        limit = np.zeros(len(points), np.int64)
        limit[starter[hit]] = hit
        tried |= ~starts & (place < limit[before])
        points = points.copy()
        points[starter[hit]] = t.pair_values[where[hit]]
        left = np.ones(len(points), bool)
        left[hit] = False
        points, row, tried = points[left], row[left], tried[left]
    return points, row


def common_form(column: pa.Array) -> pa.Array:
    """The column in its common form; nulls stay null.

    Invisible characters go, other spaces become the ordinary one, variant
    forms their ordinary characters, marks are composed with their letters,
    and in a run of several scripts the letters that have a twin in Latin (or
    else in Cyrillic) take it.
    """
    t = tables()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    points, offsets = explode_codepoints(column)
    n, c = len(offsets) - 1, np.minimum(points, LAST)
    row = _rows(offsets)
    keep = ~t.invisible[c]
    points, c, row = points[keep], c[keep], row[keep]
    points = np.where(t.space[c], np.uint32(0x20), points)
    length = t.length[c]  # expand: gather from the flat table at running offsets
    length = length.astype(np.int64)
    total = np.zeros(len(c) + 1, np.int64)
    np.cumsum(length, out=total[1:])
    source = np.repeat(np.arange(len(c)), length)
    inside = np.arange(total[-1]) - total[source]
    grown = length[source] > 1
    single = (length[source] == 1) & (t.start[c[source]] > 0)
    expanded = np.where(grown | single, t.flat[np.minimum(t.start[c[source]] + inside, max(len(t.flat) - 1, 0))], points[source])
    points, row = expanded.astype(np.uint32), row[source]
    c = np.minimum(points, LAST)
    while True:  # marks in canonical order
        order = t.order[c]
        swap = np.flatnonzero((order[:-1] > order[1:]) & (order[1:] > 0) & (row[:-1] == row[1:])) if len(c) > 1 else np.zeros(0, np.int64)
        if not len(swap):
            break
        swap = swap[np.r_[True, np.diff(swap) > 1]]
        points[swap], points[swap + 1] = points[swap + 1].copy(), points[swap].copy()
        c = np.minimum(points, LAST)
    points, row = _composed(t, points, row)
    c = np.minimum(points, LAST)
    at, run = _letter_runs(t, c, row, t.mark[c])
    if len(at):
        script = t.script[c[at]].astype(np.int64)
        start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        count = np.diff(np.r_[start, len(at)])
        total_of = lambda flag: np.repeat(np.add.reduceat(flag.astype(np.int64), start), count)
        latin, foreign = script == LATIN, (script > 0) & (script != LATIN)
        foldable = foreign & (t.to_latin[c[at]] > 0)
        mixed = (total_of(latin) > 0) & (total_of(foreign) > 0)
        to_latin = mixed & (total_of(foreign & ~foldable) == 0)
        back = latin & (t.to_cyrillic[c[at]] > 0)
        to_cyrillic = mixed & ~to_latin & (total_of(latin & ~back) == 0) & (total_of(foreign & (script != CYRILLIC)) == 0)
        fold = at[to_latin & foldable]
        points[fold] = t.to_latin[c[fold]]
        fold = at[to_cyrillic & back]
        points[fold] = t.to_cyrillic[c[fold]]
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=n), out=ends[1:])
    return pack_codepoints(points, ends, valid)


def normalised(df: DataFrame, column: str, out: str = "common", flags: str = "variant_flags", only_changed: bool = False) -> DataFrame:
    """df with `out`, the common form of a string column, and `flags` (see
    variant_flags; 0 means the text has no variant characters).

    Nulls give a null form and flags 0; empty texts stay empty; texts of any
    length are handled whole; rows and their order within a partition stay as
    they are. `out` and `flags` may
    not be columns of df. `only_changed` keeps only the rows with flags; plain
    ASCII rows are then told apart before any Python runs.
    """
    if {out, flags} & set(df.columns):
        raise ValueError(f"{out} or {flags} is already a column")
    if only_changed:
        df = df.where(F.col(column).rlike(r"[^\x00-\x7F]"))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = variant_flags(b.column(at))
            if only_changed:
                b, found = b.filter(pa.array(found > 0)), found[found > 0]
            yield pa.RecordBatch.from_arrays([*b.columns, common_form(b.column(at)).cast(pa.string()), pa.array(found.astype(np.int32))], names=[*b.schema.names, out, flags])

    return df.mapInArrow(run, f"{schema}, `{out}` string, `{flags}` int")

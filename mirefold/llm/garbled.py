"""Text that was read with the wrong character encoding, found and restored.

1. Twins: segments that are equal without their non-ASCII characters (numbers
   masked) are joined; of each group the most frequent writing is the
   reference, and each other one is aligned with it.
2. Transformations: of a pair the less usual writing is the garbled one. Its
   characters are aligned with the other's between the ASCII text that both
   have. A pair of encodings (read as, meant as) that explains all of them is
   counted as a whole; of pairs that none explains the aligned characters
   themselves are counted, and those that mostly go together make a mapping.
3. Application: what was learned from twins is applied to every word with
   non-ASCII characters. A word is garbled if a transformation makes it out of
   character sequences that are far more usual in the whole corpus.
"""

from __future__ import annotations

import codecs
import functools

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirefold.functions.codepoints import explode_codepoints
from mirefold.session import written

# Names of encodings that mail programs mix up.
READ_AS = ("cp1252", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850", "cp852", "cp866", "iso8859-2", "cp1250", "iso8859-5", "iso8859-15", "mac-cyrillic", "cp1253", "cp1254", "cp1257")
MEANT_AS = ("utf-8", "cp1252", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850", "cp866", "iso8859-2", "cp1250", "iso8859-5")
#: Cells of the hashed counts of three characters in a row: the model's size, whatever the corpus.
CELLS = 1 << 20
#: Pairs of twins that a transformation must explain to be applied, and the share of its pairs in which a character of a mapping stands for the same one.
SUPPORT, MAPPED_SHARE = 2, 0.8
#: Characters of a mapping that come to the driver at most; code charts have no more.
MAPPED_MOST = 1 << 16
#: How much more usual (mean log of counts) the restored word must be, and by how much in total over the field.
MARGIN, TOTAL = 1.2, 2.5
#: What it counts for that all of a word's non-ASCII characters make well-formed UTF-8, which is rare by chance.
WELL_FORMED = 2.0
#: ASCII letters and digits a segment needs for its twins to mean anything.
ANCHORS = 8
_RUN = re.compile(r"[^\x00-\x7f]+")
_LOST = re.compile("[�\x80-\x9f]")
# White space for Python, but part of garbled sequences: no-break space and next-line.
_TOKEN = re.compile("[^ \t\r\n\x00-\x20<>()\"]*[^\x00-\x7f][^ \t\r\n\x00-\x20<>()\"]*")


@functools.cache
def _charmap(name: str) -> tuple[dict[int, int], str]:
    """Encoding and decoding tables; bytes without a character stand for the
    control character of that number, as lenient programs read them.
    """
    table = []
    for b in range(256):
        try:
            table.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            table.append(chr(b))
    encode = {b: b for b in range(128, 160)} | {ord(c): b for b, c in enumerate(table)}
    return encode, "".join(table)


def encode(text: str, name: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _charmap(name)[0])[0]
    except UnicodeEncodeError:
        return None


def decode(raw: bytes, name: str) -> str | None:
    if name != "utf-8":
        return codecs.charmap_decode(raw, "strict", _charmap(name)[1])[0]
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


_MULTI = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf4][\x80-\xbf]{3}")


def transform(run: str, read: str, meant: str, rounds: int, partly: bool = False) -> str | None:
    """A run of non-ASCII characters read again: its bytes under `read` as
    `meant`, `rounds` times. `partly` reads the whole sequences of a damaged run and
    leaves the rest.
    """
    out = run
    for _ in range(rounds):
        raw = encode(out, read)
        if raw is None:
            return None
        back = decode(raw, meant)
        if back is None and partly and meant == "utf-8":
            table = _charmap(read)[1]
            pieces, at, hits = [], 0, 0
            for m in _MULTI.finditer(raw):
                pieces += [codecs.charmap_decode(raw[at : m.start()], "strict", table)[0], m[0].decode("utf-8", "replace")]
                at, hits = m.end(), hits + 1
            if not hits:
                return None
            back = "".join(pieces) + codecs.charmap_decode(raw[at:], "strict", table)[0]
        if back is None or back == out:
            return None
        out = back
    return out


_HINT = re.compile("[ÃÂÐÑâĂÅ├╨╤┬√∂ΓÔ‚][^\x00-\x7f]|[РСГв][^\x00-\x7fа-яА-ЯёЁ]")
_USUAL = ("cp1252", "cp437", "cp1251", "cp850", "mac-roman", "iso8859-2", "cp1250")


def well_formed(text: str) -> str:
    """A text whose lines, where their non-ASCII runs mostly make well-formed
    UTF-8 under one encoding, are read so (twice if need be). It needs no
    corpus and keeps the lines of a text.
    """
    if not _HINT.search(text):
        return text
    return "\n".join(_well_formed(x) if _HINT.search(x) else x for x in text.split("\n"))


def well_formed_texts(column: pa.Array) -> pa.Array:
    """well_formed of each text of a batch; only texts with a hint leave the array."""
    at = np.flatnonzero(pc.match_substring_regex(column, _HINT.pattern.replace("\\x00-\\x7f", "\\x00-\\x7F")).fill_null(False).to_numpy(zero_copy_only=False))
    if not len(at):
        return column
    mask = np.zeros(len(column), bool)
    mask[at] = True
    texts = pa.array([well_formed(t) for t in column.take(pa.array(at)).to_pylist()], column.type)
    return pc.replace_with_mask(column, pa.array(mask), texts)


def _well_formed(line: str) -> str:
    for _ in range(2):
        runs = set(_RUN.findall(line))
        best: dict[str, str] = {}
        for read in _USUAL:
            back = {r: t for r in runs if (t := transform(r, read, "utf-8", 1, partly=True))}
            if len(back) > len(best):
                best = back
        if 2 * len(best) <= len(runs):
            return line
        line = _RUN.sub(lambda m: best.get(m[0], m[0]), line)  # noqa: B023
    return line


GRID = [(r, m, 1) for r in READ_AS for m in MEANT_AS if r != m] + [(r, "utf-8", 2) for r in READ_AS]


@functools.lru_cache(maxsize=200_000)
def _explained(garbled: str, clean: str) -> frozenset[int]:
    """The transformations that turn one run into the other."""
    out = set()
    for read in READ_AS:
        raw = encode(garbled, read)
        if raw is None:
            continue
        for i in _BY_READ[read]:
            _, meant, rounds = GRID[i]
            once = decode(raw, meant)
            if once is not None and (once == clean if rounds == 1 else transform(once, read, meant, rounds - 1) == clean):
                out.add(i)
    return frozenset(out)


_BY_READ = {r: [i for i, g in enumerate(GRID) if g[0] == r] for r in READ_AS}


def explain(garbled: str, clean: str) -> frozenset[int]:
    """The transformations that turn the runs of one text, aligned by the
    ASCII text between them, into those of its twin.
    """
    a, b = _RUN.findall(garbled), _RUN.findall(clean)
    if not a or len(a) != len(b):
        return frozenset()
    left: frozenset[int] | None = None
    for x, y in zip(a, b, strict=True):
        if x != y:
            left = _explained(x, y) if left is None else left & _explained(x, y)
            if not left:
                return left
    return left or frozenset()


def aligned(garbled: str, clean: str) -> dict[str, str] | None:
    """The characters of one text (one or several) that stand for a character
    of its twin, by the runs between the ASCII text of both; None where runs
    can't be aligned or contradict each other.
    """
    a, b = _RUN.findall(garbled), _RUN.findall(clean)
    if not a or len(a) != len(b):
        return None
    out: dict[str, str] = {}
    for x, y in zip(a, b, strict=True):
        width, rest = divmod(len(x), len(y))
        if rest:
            return None
        for i, c in enumerate(y):
            if out.setdefault(x[i * width : (i + 1) * width], c) != c:
                return None
    return {u: c for u, c in out.items() if u != c}


def _foreign(unit: str, char: str) -> bool:
    """Whether a character, or several, can stand for another by a mapping of
    their own: no letter does (encodings and look-alikes have those), and no
    variant form of the same character.
    """
    plain = "".join(c for c in unicodedata.normalize("NFKC", unit) if unicodedata.category(c) != "Cf")
    return not (len(unit) == 1 and unit.isalpha()) and char not in unit and plain != unicodedata.normalize("NFKC", char)


def mapped(run: str, mapping: dict[str, str], longest: int) -> str | None:
    """A run with the mapping applied to all of it; None where a character isn't in it."""
    out, i = [], 0
    while i < len(run):
        for n in range(longest, 0, -1):
            if (c := mapping.get(run[i : i + n])) is not None and len(run) >= i + n:
                out.append(c)
                i += n
                break
        else:
            return None
    return "".join(out)


def _segments(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(seg, count, line): each distinct line with a non-ASCII character, numbers masked, with one of its writings."""
    each = F.flatten(F.array(*[F.coalesce(F.split(c, r"\n"), F.array().cast("array<string>")) for c in fields.values()]))
    masked = F.regexp_replace(F.regexp_replace("line", "[0-9]+", "0"), r"^[\s>]+|\s+$", "")
    lines = df.select(F.explode(each).alias("line")).where(F.octet_length("line") > F.length("line"))
    each_once = lines.select(masked.alias("seg"), "line").groupBy("seg").agg(F.count("*").alias("count"), F.min("line").alias("line"))
    return written(each_once, "segments")


def twins(segments: DataFrame) -> DataFrame:
    """(reference, other): each distinct segment with the most frequent one of
    the same text without non-ASCII characters. Pairs are as many as segments.
    """
    key = F.regexp_replace("seg", r"[^\x20-\x7E]+", "")
    counted = segments.select("seg", "count", key.alias("key")).where(F.length(F.regexp_replace("key", "[^A-Za-z0-9]", "")) >= ANCHORS)
    reference = counted.groupBy("key").agg(F.max_by("seg", F.struct("count", "seg")).alias("reference"), F.count("*").alias("n")).where("n > 1")
    return counted.join(reference.select("key", "reference"), "key").where("seg <> reference").select("reference", F.col("seg").alias("other"))


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _cells(points: np.ndarray) -> np.ndarray:
    """Cells of all three characters in a row."""
    p = points.astype(np.uint64)
    h = (p[:-2] * _A) ^ (p[1:-1] * _B + (p[1:-1] << np.uint64(17))) ^ (p[2:] * _C + _A)
    h = (h ^ (h >> np.uint64(31))) * _B
    return (h >> np.uint64(44)).astype(np.int64)


def _plain(points: np.ndarray) -> np.ndarray:
    """White space (the no-break space too) as one blank, digits as 0."""
    points = np.where((points == 9) | (points == 10) | (points == 13) | (points == 0xA0), 32, points)
    return np.where((points >= 48) & (points <= 57), 48, points)


def learn_counts(segments: DataFrame) -> np.ndarray:
    """Hashed counts of three characters in a row of which one isn't ASCII.

    A segment counts once and once more for each doubling of its copies: a
    text sent a million times weighs as much as twenty others.
    """
    texts = segments.select("line", (F.floor(F.log2("count")) + 1).cast("long").alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            points, offsets = explode_codepoints(b.column(0))
            points = _plain(points)
            spaced = np.insert(points, np.repeat(offsets, 2), 32)  # two blanks around each text
            three = np.maximum(np.maximum(spaced[:-2], spaced[1:-1]), spaced[2:]) > 0x7F
            row = np.r_[0, np.repeat(np.arange(len(b)), np.diff(offsets) + 2)][:-1] if len(b) else np.zeros(0, np.int64)
            weight = b.column(1).to_numpy(zero_copy_only=False)
            total += np.bincount(_cells(spaced)[three], weight[row][three], minlength=CELLS).astype(np.int64)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    sums = texts.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():  # at most CELLS rows
        out[r["cell"]] = r["n"]
    return out


class Restorer:
    """Applies learned transformations where they make a text more usual.

    Words are judged in bulk: all words that weren't seen before are one array
    of code points, which each transformation maps by a table; only words
    whose bytes hold a sequence of UTF-8 are decoded one by one.
    """

    SEEN = 500_000  # words remembered; then all are judged anew

    def __init__(self, transformations: list[tuple[str, str, int]], mapping: dict[str, str], log_counts: np.ndarray) -> None:
        self.transformations, self.mapping, self.log_counts = transformations, mapping, log_counts
        self.longest = max(map(len, mapping), default=0)
        self.both_ways = set(mapping) & set(mapping.values())  # characters of clean text that also stand for another
        self.seen: set[str] = set()
        self.changed: dict[str, tuple[str, float]] = {}
        self.to_byte, self.to_char = {}, {}
        for read, meant, _ in transformations:
            table = np.zeros(0x10000, np.uint8)
            for c, byte in _charmap(read)[0].items():
                if c > 0x7F:
                    table[c] = byte
            self.to_byte[read] = table
            if meant != "utf-8":
                self.to_char[meant] = np.array([ord(c) for c in _charmap(meant)[1]], np.uint32)

    def _scores(self, points: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per word the total of log counts of three characters with a non-ASCII one, and how many they are."""
        value, count = np.zeros(len(points)), np.zeros(len(points), np.int64)
        points = _plain(points)
        three = (np.maximum(np.maximum(points[:-2], points[1:-1]), points[2:]) > 0x7F) & inside[:-2]
        value[:-2][three] = self.log_counts[_cells(points)[three]]
        count[:-2] = three
        return np.add.reduceat(value, starts), np.add.reduceat(count, starts)

    def _score(self, word: str) -> tuple[float, int]:
        points = _plain(np.frombuffer(f" {word} ".encode("utf-32-le", "surrogatepass"), np.uint32))
        three = np.maximum(np.maximum(points[:-2], points[1:-1]), points[2:]) > 0x7F
        return float(self.log_counts[_cells(points)[three]].sum()), int(three.sum())

    def usual(self, text: str) -> float:
        """Mean log count of a text's characters."""
        total, n = self._score(text)
        return total / max(n, 1)

    def judge(self, words: list[str], depth: int = 0) -> None:
        """Finds the best reading of each word that is new, and again of what was read."""
        words = [w for w in dict.fromkeys(words) if w not in self.seen]
        if not words or depth > 2:
            return
        if len(self.seen) > self.SEEN:
            self.seen.clear()
            self.changed.clear()
        self.seen.update(words)
        points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(w) + 2 for w in words])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        inside = np.ones(len(points), bool)  # where three characters in a row stay within a word
        inside[starts + lengths - 1] = inside[starts + lengths - 2] = False
        total, n = self._scores(points, starts, inside)
        usual, high = total / np.maximum(n, 1), points > 0x7F
        small = np.where(points < 0x10000, points, 0)
        best_gain, best, twice = np.zeros(len(words)), [""] * len(words), np.zeros(len(words), bool)
        bytes_of = {}
        for read, meant, rounds in self.transformations:
            if read not in bytes_of:
                raw = np.where(high, self.to_byte[read][small], 0)
                bytes_of[read] = raw, np.logical_or.reduceat(high & (raw == 0), starts)
            raw, unread = bytes_of[read]
            if meant != "utf-8":
                again = np.where(high, self.to_char[meant][raw], points)
                lost = high & ((again == 0xFFFD) | ((again >= 0x80) & (again < 0xA0)))
                usable = ~unread & ~np.logical_or.reduceat(lost, starts) & np.logical_or.reduceat(again != points, starts)
                if not usable.any():
                    continue
                new, k = self._scores(again, starts, inside)
                gain = np.where(usable & (k > 0), new / np.maximum(k, 1) - usual, 0.0)
                better = (gain > MARGIN) & (gain * k > best_gain)
                for i in np.flatnonzero(better):
                    best[i] = again[starts[i] + 1 : starts[i] + lengths[i] - 1].astype(np.uint32).tobytes().decode("utf-32-le")
                best_gain, twice = np.where(better, gain * k, best_gain), twice & ~better
                continue
            follows = (raw >= 0x80) & (raw < 0xC0)
            after, later = np.r_[follows[1:], False], np.r_[follows[2:], False, False]
            sequence = ((raw >= 0xC2) & (raw < 0xE0) & after) | ((raw >= 0xE0) & (raw < 0xF5) & after & later)
            for i in np.flatnonzero(np.logical_or.reduceat(sequence, starts)):
                runs = _RUN.findall(words[i])
                changed = [transform(run, read, meant, rounds) for run in runs]
                well_formed = all(changed)
                changed = [x or transform(run, read, meant, rounds, partly=True) for x, run in zip(changed, runs, strict=True)]
                if not any(changed):
                    continue
                it = iter(changed)
                text = _RUN.sub(lambda m: next(it) or m[0], words[i])  # noqa: B023
                if text == words[i] or _LOST.search(text):
                    continue
                score, k = self._score(text)
                gain = score / k - usual[i] + (WELL_FORMED if well_formed else 0.0) if k else 0.0
                if gain > MARGIN and gain * k > best_gain[i]:
                    best_gain[i], best[i], twice[i] = gain * k, text, True
        for i, word in enumerate(words) if self.mapping else ():
            changed = [mapped(run, self.mapping, self.longest) for run in _RUN.findall(word)]
            if changed and all(changed):
                it = iter(changed)
                text = _RUN.sub(lambda m: next(it), word)  # noqa: B023
                score, k = self._score(text)
                gain = score / k - usual[i] + (0.0 if self.both_ways & set(word) else WELL_FORMED) if k else 0.0
                if gain > MARGIN and gain * k > best_gain[i]:
                    best_gain[i], best[i] = gain * k, text
        better = [(words[i], best[i], float(best_gain[i]), bool(twice[i])) for i in np.flatnonzero(best_gain > 0)]
        self.judge([text for _, text, _, utf8 in better if utf8 and _RUN.search(text)], depth + 1)  # only UTF-8 is wrongly read twice
        for word, text, gain, utf8 in better:
            again, more = self.changed.get(text, (text, 0.0)) if utf8 else (text, 0.0)
            alone = len(word) == 1 and again.isalpha()  # one letter for another proves nothing by itself
            self.changed[word] = again, 0.01 if alone else gain + more

    def __call__(self, text: str) -> tuple[str, str | None]:
        """The restored text, and what was found: restored, partly (some
        characters are lost), lost, or None for a clean text.
        """
        words = _TOKEN.findall(text)
        self.judge(words)
        gains = sum(self.changed[w][1] for w in words if w in self.changed)
        lost = bool(_LOST.search(text))
        if gains < TOTAL and not lost:
            return text, None
        out = _TOKEN.sub(lambda m: self.changed[m[0]][0] if m[0] in self.changed else m[0], text) if gains else text
        lost = bool(_LOST.search(out))
        return out, ("partly" if out != text else "lost") if lost else "restored"


def learn_transformations(segments: DataFrame, log_counts: np.ndarray, support: int = SUPPORT) -> tuple[list[tuple[str, str, int]], dict[str, str]]:
    """Transformations that at least `support` pairs of twins agree with (at
    most the grid's number), and the mapping learned from the other pairs.
    """
    shared = segments.sparkSession.sparkContext.broadcast(log_counts)  # CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Restorer([], {}, shared.value)
        for b in batches:
            count = np.zeros(len(GRID), np.int64)
            units: dict[tuple[str, str], int] = {}
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                usual, other = judge.usual(x), judge.usual(y)
                garbled, clean = (y, x) if other <= usual else (x, y)
                if found := explain(garbled, clean):
                    for i in found:
                        count[i] += 1
                elif abs(usual - other) > MARGIN / 2 and not _LOST.search(x) and not _LOST.search(y):
                    for unit, char in (aligned(garbled, clean) or {}).items():
                        if _foreign(unit, char):
                            units[unit, char] = units.get((unit, char), 0) + 1
            hit = np.flatnonzero(count)
            n = np.r_[count[hit], np.array(list(units.values()), np.int64)].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[hit, np.full(len(units), -1)].astype(np.int32)), pa.array([None] * len(hit) + [u for u, _ in units], pa.string()), pa.array([None] * len(hit) + [c for _, c in units], pa.string()), pa.array(n)], names=["t", "unit", "char", "n"])

    counts = written(twins(segments).mapInArrow(run, "t int, unit string, char string, n bigint").groupBy("t", "unit", "char").agg(F.sum("n").alias("n")), "transformations")
    grid = [GRID[r["t"]] for r in counts.where((F.col("t") >= 0) & (F.col("n") >= support)).orderBy(F.desc("n"), "t").collect()]
    best = counts.where("t < 0").groupBy("unit").agg(F.max_by("char", F.struct("n", "char")).alias("char"), F.max("n").alias("n"), F.sum("n").alias("total"))
    kept = best.where((F.col("n") >= support) & (F.col("n") >= MAPPED_SHARE * F.col("total"))).orderBy(F.desc("n"), "unit").limit(MAPPED_MOST)
    return grid, {r["unit"]: r["char"] for r in kept.collect()}


def learn(df: DataFrame, fields: dict[str, Column], support: int = SUPPORT) -> Restorer:
    """Transformations and counts from all rows of the given fields."""
    segments = _segments(df, fields)
    log_counts = np.log(learn_counts(segments) + 0.5).astype(np.float32)
    return Restorer(*learn_transformations(segments, log_counts, support), log_counts)


def restored(df: DataFrame, row_id: str, fields: dict[str, Column], model: Restorer) -> DataFrame:
    """(row_id, field_name, status, restored_text) of the fields that were
    decoded wrongly in whole or in part.

    Null, empty and plain ASCII fields are never cases; texts of any length
    are read whole; repeated rows are found each. A text with replacement
    characters is lost or partly restored: what they stood for is unknown.
    """
    key = df.schema[row_id].dataType.simpleString()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((model.transformations, model.mapping, model.log_counts))  # CELLS numbers, a part of the grid, MAPPED_MOST characters
    each = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("v")) for n, c in fields.items()])
    rows = df.select(F.col(row_id).alias("row_id"), F.explode(each).alias("f")).select("row_id", "f.name", "f.v").where(F.col("v").rlike(r"[^\x00-\x7F]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*shared.value)
        for b in batches:
            at, status, texts = [], [], []
            column = b.column(2).to_pylist()
            restorer.judge([w for t in column for w in _TOKEN.findall(t)])
            for i, t in enumerate(column):
                out, what = restorer(t)
                if what:
                    at.append(i)
                    status.append(what)
                    texts.append(out)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(status, pa.string()), pa.array(texts, pa.string())], names=["row_id", "field_name", "status", "restored_text"])

    return rows.mapInArrow(run, f"row_id {key}, field_name string, status string, restored_text string")

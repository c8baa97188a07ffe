"""Written dates of any format as one instant in UTC.

Each value is tokenised into a mask of character classes. A mask is mapped to
a parser once in a worker (its spans hold for every value of that mask), and
all values of a mask are converted together in numpy. Local times go through
the transition tables of mirefold.functions.zones.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirefold.functions import zones
from mirefold.functions.codepoints import explode_codepoints

# Names of months and weekdays in the languages of the mails.
MONTHS = (
    "jan january januar janvier janv enero ene января янв",
    "feb february februar février févr fevrier febrero февраля фев",
    "mar march märz maerz mär mars marzo марта мар",
    "apr april avril avr abril abr апреля апр",
    "may mai mayo мая май",
    "jun june juni juin junio июня июн",
    "jul july juli juillet juil julio июля июл",
    "aug august août aout agosto ago августа авг",
    "sep sept september septembre septiembre setiembre сентября сен",
    "oct october oktober okt octobre octubre октября окт",
    "nov november novembre noviembre ноября ноя",
    "dec december dezember dez décembre déc decembre diciembre dic декабря дек",
)
WEEKDAYS = (
    "mon tue tues wed thu thur thurs fri sat sun monday tuesday wednesday thursday friday saturday sunday "
    "montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag mo di mi do fr sa so "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lun mer jeu ven sam dim "
    "lunes martes miércoles jueves viernes sábado domingo mié jue vie sáb dom "
    "понедельник вторник среда четверг пятница суббота воскресенье пн вт ср чт пт сб вс"
)
FILLERS = "de del le el à a las at um uhr г год года den dem of the th st nd rd ч в"
# Minutes east of UTC of zone abbreviations in their usual meaning.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "met": 60, "cest": 120, "mest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "msd": 240, "trt": 180, "sast": 120, "gst": 240, "pkt": 300, "ist": 330, "npt": 345, "wib": 420, "ict": 420,
    "hkt": 480, "sgt": 480, "awst": 480, "pht": 480, "jst": 540, "kst": 540, "acst": 570, "aest": 600, "acdt": 630, "aedt": 660, "nzst": 720, "nzdt": 780,
    "brt": -180, "brst": -120, "art": -180, "clt": -240, "clst": -180, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "hdt": -540,
}

WORDS: dict[str, tuple[str, int]] = {w: ("j", 0) for w in FILLERS.split()}
WORDS |= {w: ("W", 0) for w in WEEKDAYS.split()}
WORDS |= {w: ("Z", m) for w, m in ABBREVIATIONS.items()}
WORDS |= {w: ("B", i + 1) for i, names in enumerate(MONTHS) for w in names.split()}
WORDS |= {"am": ("P", 0), "pm": ("P", 12), "t": ("t", 0)}

_TIME = r"(?P<H>d{1,2}):(?P<M>dd)(?::(?P<S>dd)(?:[.,](?P<f>d+))?)?(?: *(?P<p>P+))?"
_NOTE = r"(?: *(?:\([^()]*\)|\[[^\[\]]*\]))*"
_ZONE = rf"(?: *(?:(?P<o>[+-]dd(?::?dd)?)|(?P<z>Z+)(?P<zo>[+-]d{{1,2}}(?::?dd)?)?|\((?P<zc>Z+)\)|(?P<n>N+)|[\[(](?P<nc>N+)[\])]){_NOTE})?"
_GAP = r"(?:t|[ ,]+(?:j+[.,]* +)?|[.,]+ +)"
_YMD = r"(?P<y>dddd)(?P<s>[-/.])(?P<m>dd?)(?P=s)(?P<d>dd?)"
_TWO = r"(?P<a>dd?)(?P<s>[-/])(?P<b>dd?)(?P=s)(?P<y>dddd|dd)"
_DOT = r"(?P<d>dd?)\.(?P<m>dd?)\.(?P<y>dddd|dd)"
_WEEK = r"(?:W+[.,]* *)?"
_DAY_MONTH = r"(?P<d>dd?)\.?[ -]*(?:j+\.? +)?(?P<B>B+)\.?[ ,-]*(?:j+\.? +)?(?P<y>dddd|dd)"
_MONTH_DAY = r"(?P<B>B+)\.? +(?P<d>dd?)(?:j+)?,? +(?P<y>dddd)"
GRAMMAR = [
    re.compile(x)
    for x in (
        *(_WEEK + date + _GAP + _TIME + _ZONE for date in (_YMD, _DAY_MONTH, _MONTH_DAY, _TWO, _DOT)),
        rf"{_WEEK}(?P<B>B+) +(?P<d>dd?) +{_TIME}{_ZONE} +(?P<y>dddd)",
        rf"(?P<y>dddd)(?P<m>dd)(?P<d>dd)(?:t| +)(?P<H>dd)(?P<M>dd)(?:(?P<S>dd)(?:[.,](?P<f>d+))?)?{_ZONE}",
        r"(?P<e>-?d{1,18})",
    )
]
_RUN = re.compile(r"a+(?:/a+(?:[_-]a+)*)+|a+")


@functools.cache
def _classes() -> np.ndarray:
    """Character class of a code point: d, a (letter), blank, ASCII itself, x."""
    table = np.full(0x3001, ord("x"), dtype=np.uint8)
    for c in range(0x3000):
        s = chr(c)
        table[c] = ord("a" if s.isalpha() else " " if s.isspace() else s if c < 0x80 and c > 32 else "x")
    table[48:58] = ord("d")
    table[ord("x")] = ord("a")
    return table


def _mask(points: np.ndarray) -> np.ndarray:
    return _classes()[np.minimum(points, 0x3000)]


#: Masks and shapes up to this length are remembered; longer ones are parsed each time.
REMEMBERED = 200


def _remembered(f: Callable) -> Callable:
    known = functools.lru_cache(maxsize=100_000)(f)
    return lambda text: known(text) if len(text) <= REMEMBERED else f(text)


@_remembered
def _runs(mask: str) -> tuple[tuple[int, int], ...]:
    return tuple(m.span() for m in _RUN.finditer(mask))


@_remembered
def _parser(shape: str) -> dict[str, tuple[int, int]] | None:
    """The spans of the parts of a date of this shape; None where it is no date."""
    for rule in GRAMMAR:
        if m := rule.fullmatch(shape):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


@functools.lru_cache(maxsize=100_000)
def _word(word: str) -> tuple[str, int]:
    low = word.lower()
    if low in WORDS:
        return WORDS[low]
    if "/" in word:
        return "N", 0
    return "?", 0


def _words(chars: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of one span, and which of them each row has."""
    text = np.ascontiguousarray(chars[:, start:end]).view(f"<U{end - start}")[:, 0]
    return np.unique(text, return_inverse=True)


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (chars[:, i].astype(np.int64) - 48)
    return out


def _offset(chars: np.ndarray, shape: str, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Seconds of a written offset, and where it is possible."""
    start, end = span
    digits = [i for i in range(start + 1, end) if shape[i] == "d"]
    value = [chars[:, i].astype(np.int64) - 48 for i in digits]
    hours = value[0] if len(value) in (1, 3) else value[0] * 10 + value[1]
    minutes = value[-2] * 10 + value[-1] if len(value) > 2 else np.zeros(len(chars), np.int64)
    sign = np.where(chars[:, start] == ord("-"), -1, 1)
    return sign * (hours * 3600 + minutes * 60), (hours <= 15) & (minutes < 60)


def _convert(chars: np.ndarray, shape: str, words: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]], day_first: np.ndarray, zone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instants of the rows of one shape, and which rows hold a readable one.

    day_first: 1 day first, 0 month first, -1 unknown. zone: the local zone's
    name, or None.
    """
    n, at = len(chars), _parser(shape)
    if at is None:
        return np.zeros(n, np.int64), np.zeros(n, bool)
    if "e" in at:
        start, end = at["e"]
        negative = shape[start] == "-"
        value = _number(chars, (start + negative, end)) * (-1 if negative else 1)
        digits = end - start - negative
        scale = 1_000_000 if digits < 12 else 1000 if digits < 15 else 1
        return value * scale, np.ones(n, bool)
    zero = np.zeros(n, np.int64)
    year = _number(chars, at["y"])
    if at["y"][1] - at["y"][0] == 2:
        year = year + 2000
    ok = np.ones(n, bool)
    if "a" in at:
        a, b = _number(chars, at["a"]), _number(chars, at["b"])
        first = np.where(a > 12, 1, np.where(b > 12, 0, np.where(a == b, 1, day_first)))
        ok &= first >= 0
        day, month = np.where(first == 1, a, b), np.where(first == 1, b, a)
    else:
        day = _number(chars, at["d"])
        month = _number(chars, at["m"]) if "m" in at else words[at["B"]][1]
    hour, minute = _number(chars, at["H"]), _number(chars, at["M"])
    second = _number(chars, at["S"]) if "S" in at else zero
    micro = zero
    if "f" in at:
        start, end = at["f"]
        micro = _number(chars, (start, min(end, start + 6))) * 10 ** max(0, 6 - (end - start))
    if "p" in at:
        ok &= (hour >= 1) & (hour <= 12)
        hour = hour % 12 + words[at["p"]][1]
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    ok &= (year >= 1) & (month >= 1) & (month <= 12) & (hour < 24) & (minute < 60) & (second <= 60)
    month = np.where(ok, month, 1)
    ok &= (day >= 1) & (day <= length[month] + ((month == 2) & leap))
    year, day = np.where(ok, year, 2000), np.where(ok, day, 1)
    months = (year - 1970) * 12 + month - 1
    days = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + day - 1
    local = days * 86400 + hour * 3600 + minute * 60 + second
    name_span = at.get("n") or at.get("nc")
    if "o" in at:
        shift, fine = _offset(chars, shape, at["o"])
        utc, ok = local - shift, ok & fine
    elif "z" in at or "zc" in at:
        utc = local - words[at.get("z") or at["zc"]][1] * 60
        if "zo" in at:
            shift, fine = _offset(chars, shape, at["zo"])
            utc, ok = utc - shift, ok & fine
    else:
        if name_span:
            distinct, which = words[name_span][0], words[name_span][2]
            names: list[str | None] = [str(x) for x in distinct]
        else:
            distinct, which = np.unique(np.where(zone == None, "", zone).astype(str), return_inverse=True)  # noqa: E711
            names = [str(x) or None for x in distinct]
        utc = local.copy()
        for i, name in enumerate(names):
            rows, table = which == i, zones.zone_table(name) if name else None
            if table is None:
                ok = ok & ~rows
            else:
                utc[rows] = table.to_utc(local[rows])
    return utc * 1_000_000 + micro, ok


def parse_dates(values: pa.Array, day_order: np.ndarray, tz_name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Instants in microseconds of UTC of a string column, and which are readable."""
    values = pc.utf8_trim_whitespace(values.cast(pa.large_string()))
    points, offsets = explode_codepoints(values)
    masks = pa.Array.from_buffers(pa.large_string(), len(values), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_mask(points).tobytes())])
    kinds = masks.dictionary_encode()
    which = kinds.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[order], np.arange(len(kinds.dictionary) + 1))
    utc, ok = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    first = np.where(day_order == "dmy", 1, np.where(day_order == "mdy", 0, -1))
    for k, mask in enumerate(kinds.dictionary.to_pylist()):
        if not mask:
            continue
        rows = order[starts[k] : starts[k + 1]]
        chars = points[offsets[rows][:, None] + np.arange(len(mask))]
        spans, role, words = _runs(mask), np.zeros(len(rows), np.int64), {}
        for i, (start, end) in enumerate(spans):
            distinct, inverse = _words(chars, start, end)
            meant = [_word(str(x)) for x in distinct]
            words[start, end] = (distinct, np.array([v for _, v in meant])[inverse], inverse, [r for r, _ in meant])
            letters = np.array([ord(r) for r, _ in meant])[inverse]
            role = role * 131 + letters  # equal roles give equal numbers; unequal ones are told apart below
        for r in np.unique(role):
            pick = np.flatnonzero(role == r)
            shape = list(mask)
            for span in spans:
                letter = words[span][3][words[span][2][pick[0]]]
                shape[span[0] : span[1]] = letter * (span[1] - span[0])
            same = np.ones(len(pick), bool)
            for span in spans:
                letters = np.array([ord(x) for x in words[span][3]])[words[span][2][pick]]
                same &= letters == letters[0]
            parts = [pick] if same.all() else [pick[i : i + 1] for i in range(len(pick))]
            for part in parts:
                if part is not pick:
                    for span in spans:
                        shape[span[0] : span[1]] = words[span][3][words[span][2][part[0]]] * (span[1] - span[0])
                own = {s: (w[0], w[1][part], w[2][part]) for s, w in words.items()}
                utc[rows[part]], ok[rows[part]] = _convert(chars[part], "".join(shape), own, first[rows[part]], tz_name[rows[part]])
    return utc, ok


def instants(df: DataFrame, value: str, day_order: str, tz_name: str, out: str = "utc_us", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of df and `out`, the instant of `value`, for the rows
    that hold a complete, readable date and time.

    A written offset or zone counts first; without one the time is local to
    `tz_name`, and `day_order` (dmy or mdy) decides an open order of day and
    month. Nulls, empty and unreadable values, dates without a time, unknown
    zone names, a missing zone where one is needed and a missing day order
    where it is open give no row; repeated rows stay repeated; values of any
    length are read whole. `keep` names the columns to pass on (all
    others by default); `out` may not be one of them.
    """
    keep = [c for c in df.columns if c not in (value, day_order, tz_name)] if keep is None else keep
    if out in keep:
        raise ValueError(f"{out} is already a column")
    release = zones.version()
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if zones.version() != release:
            raise RuntimeError(f"the driver has zone tables {release}, this worker {zones.version()}")
        for batch in batches:
            plain = lambda c: np.array(batch.column(c).to_pylist(), dtype=object)  # noqa: B023, E731
            utc, ok = parse_dates(batch.column("__value"), plain("__order"), plain("__zone"))
            good = pa.array(ok)
            columns = [batch.column(c).filter(good) for c in keep] + [pa.array(utc[ok])]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, out])

    narrow = df.where(F.col(value).isNotNull() & (F.trim(F.col(value)) != "")).select(
        *[F.col(c) for c in keep], F.col(value).alias("__value"), F.col(day_order).alias("__order"), F.col(tz_name).alias("__zone")
    )
    return narrow.mapInArrow(run, f"{schema}, `{out}` bigint" if keep else f"`{out}` bigint")

"""Versioned tables of the offset changes of a time zone."""

from __future__ import annotations

import functools
import io
import os
import struct
import zoneinfo
from datetime import UTC, datetime

import numpy as np

#: The calendar, weekdays included, repeats after so many years and seconds.
CYCLE_YEARS, CYCLE = 400, 146_097 * 86_400


@functools.cache
def version() -> str:
    """The release of the zone database that this process reads."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        for folder in zoneinfo.TZPATH:
            try:
                with open(os.path.join(folder, "tzdata.zi"), encoding="ascii") as f:
                    return f.readline().split()[-1]
            except OSError:
                continue
        return "unknown"


def _bytes(name: str) -> bytes | None:
    if not name or name.startswith(("/", ".")) or ".." in name:
        return None
    parts = name.split("/")
    try:
        from importlib import resources

        return resources.files("tzdata").joinpath("zoneinfo", *parts).read_bytes()
    except (ImportError, OSError, ValueError):
        pass
    for folder in zoneinfo.TZPATH:
        try:
            with open(os.path.join(folder, *parts), "rb") as f:
                return f.read()
        except OSError:
            continue
    return None


def _explicit(raw: bytes) -> tuple[list[int], list[int], int]:
    """Transitions, the offset after each, and the offset before the first (RFC 8536, version 2 block)."""
    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", raw[at + 20 : at + 44])

    isut, isstd, leap, times, types, chars = counts(0)
    at, width = 0, 4
    if raw[4:5] >= b"2":
        at = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut
        isut, isstd, leap, times, types, chars = counts(at)
        width = 8
    at += 44
    when = list(struct.unpack(f">{times}{'q' if width == 8 else 'l'}", raw[at : at + width * times]))
    at += width * times
    kinds = raw[at : at + times]
    at += times
    offsets = [struct.unpack(">lBB", raw[at + 6 * i : at + 6 * i + 6])[0] for i in range(types)]
    return when, [offsets[k] for k in kinds], offsets[0] if offsets else 0


class ZoneTable:
    """Offset changes of one zone: UTC instants, offsets around them, local thresholds."""

    def __init__(self, name: str, raw: bytes) -> None:
        self.name, self.version = name, version()
        when, after, first = _explicit(raw)
        zone = zoneinfo.ZoneInfo.from_file(io.BytesIO(raw), key=name)

        def offset(t: int) -> int:
            return round(datetime.fromtimestamp(t, UTC).astimezone(zone).utcoffset().total_seconds())

        start = max(when[-1] if when else 0, 0) + 1
        self.end = int(datetime(datetime.fromtimestamp(start, UTC).year + CYCLE_YEARS + 1, 1, 1, tzinfo=UTC).timestamp())
        end, step, now = self.end + 7 * 86400, 14 * 86400, offset(start)
        for t in range(start + step, end, step):  # what the rule in the footer says beyond the written changes
            if (then := offset(t)) != now:
                low, high = t - step, t
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (mid, high) if offset(mid) == now else (low, mid)
                when.append(high)
                after.append(then)
                now = then
        self.utc = np.array(when, dtype=np.int64)
        self.offsets = np.array([first, *after], dtype=np.int64)
        self.local = self.utc + np.maximum(self.offsets[:-1], self.offsets[1:])

    def to_utc(self, local_seconds: np.ndarray) -> np.ndarray:
        """UTC seconds of local seconds. A time that occurs twice is the first
        of the two, a skipped one has the offset valid before the change: both
        mean that a change counts from the later of its two local readings.
        Beyond the table the last cycle of the calendar repeats.
        """
        cycles = np.maximum(0, -(-(local_seconds - self.end) // CYCLE)) * CYCLE
        local_seconds = local_seconds - cycles
        return cycles + local_seconds - self.offsets[np.searchsorted(self.local, local_seconds, side="right")]


@functools.lru_cache(maxsize=1024)
def zone_table(name: str) -> ZoneTable | None:
    raw = _bytes(name)
    if raw is None or raw[:4] != b"TZif":
        return None
    return ZoneTable(name, raw)

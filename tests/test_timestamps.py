from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirefold.functions.zones import zone_table
from mirefold.operators.timestamps import instants, parse_dates


def us(*parts, offset=0):
    return int(datetime(*parts, tzinfo=timezone(timedelta(minutes=offset))).timestamp() * 1_000_000)


def one(text, order="dmy", zone="Europe/Berlin"):
    utc, ok = parse_dates(pa.array([text]), np.array([order], object), np.array([zone], object))
    return int(utc[0]) if ok[0] else None


CASES = [
    ("Mon, 01 Jan 2024 12:19:50 +0530", us(2024, 1, 1, 12, 19, 50, offset=330)),
    ("Tue, 02 Jan 2024 20:47:25 -0000", us(2024, 1, 2, 20, 47, 25)),
    ("WED,03  JAN 2024  21:24:03  +0200", us(2024, 1, 3, 21, 24, 3, offset=120)),
    ("Fri, 12 Jan 24 21:36 CST", us(2024, 1, 12, 21, 36, offset=-360)),
    ("Wed, 10 Jan 2024 16:43:18 +0330 (UTC+03:30)", us(2024, 1, 10, 16, 43, 18, offset=210)),
    ("2024-01-28T18:20:01.957654321+02:00", us(2024, 1, 28, 18, 20, 1, 957654, offset=120)),
    ("2025-10-08T19:40:11,055+02", us(2025, 10, 8, 19, 40, 11, 55000, offset=120)),
    ("20250204T091951Z", us(2025, 2, 4, 9, 19, 51)),
    ("2024/11/03 01:46:48 America/Chicago", us(2024, 11, 3, 1, 46, 48, offset=-300)),
    ("2025-09-20T12:55:05+02:00[Europe/Madrid]", us(2025, 9, 20, 12, 55, 5, offset=120)),
    ("1704754791", 1704754791 * 10**6),
    ("1747915767630", 1747915767630 * 1000),
    ("1724569905593670", 1724569905593670),
    ("16.10.25 00:00:40", us(2025, 10, 16, 0, 0, 40, offset=120)),
    ("2026-03-04 10:04", us(2026, 3, 4, 10, 4, offset=60)),
    ("15 de agosto de 2025, 06:18:26", us(2025, 8, 15, 6, 18, 26, offset=120)),
    ("11 марта 2025 г., 09:24:16", us(2025, 3, 11, 9, 24, 16, offset=60)),
    ("1 février 2024 à 03:33:40", us(2024, 2, 1, 3, 33, 40, offset=60)),
    ("12. März 2026 00:17:39", us(2026, 3, 12, 0, 17, 39, offset=60)),
    ("Sun Mar 29 02:40:07 2026", us(2026, 3, 29, 2, 40, 7, offset=60)),  # skipped: the offset before the change
    ("2025-10-26 02:30:00", us(2025, 10, 26, 2, 30, 0, offset=120)),  # twice: the first
    ("12:00 AM", None), ("2024-03-04", None), ("0000-00-00", None), ("Thu, 32 Foo 2025 25:61:00", None), ("2025-13-40T99:00:00Z", None),
    ("TBD", None), ("", None), ("-", None), ("2024-02-30 10:00", None), ("2024/11/03 01:46:48 Mars/Base", None), ("x" * 5000, None),
]


@pytest.mark.parametrize("text,want", CASES)
def test_formats(text, want):
    assert one(text) == want


def test_open_order_of_day_and_month():
    assert one("03/04/2024, 2:05:20 PM", "dmy", "UTC") == us(2024, 4, 3, 14, 5, 20)
    assert one("03/04/2024, 2:05:20 PM", "mdy", "UTC") == us(2024, 3, 4, 14, 5, 20)
    assert one("13/04/2024 12:17:32 AM", "mdy", "UTC") == us(2024, 4, 13, 0, 17, 32)
    assert one("03/04/2024 10:00:00", None, "UTC") is None
    assert one("03.04.2024 10:00:00", "mdy", "UTC") == us(2024, 4, 3, 10)
    assert one("2024-04-03 10:00:00", "dmy", None) is None


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 4_102_444_800), st.sampled_from(["Europe/London", "America/New_York", "Australia/Sydney", "America/Sao_Paulo", "Asia/Kolkata", "Europe/Moscow"]))
def test_local_times_against_zoneinfo(seconds, zone):
    local = datetime.fromtimestamp(seconds, UTC).replace(tzinfo=None)
    want = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(UTC)
    got = zone_table(zone).to_utc(np.array([seconds]))[0]
    assert got == int(want.timestamp())


def test_table(spark):
    rows = [(1, "2024-01-01T00:00:00Z", "dmy", "UTC", "x"), (2, None, "dmy", "UTC", "y"), (3, "", None, None, "z"), (1, "2024-01-01T00:00:00Z", "dmy", "UTC", "x")]
    df = spark.createDataFrame(rows, "id long, v string, o string, z string, note string")
    out = instants(df, "v", "o", "z").collect()
    assert [(r["id"], r["note"], r["utc_us"]) for r in out] == [(1, "x", us(2024, 1, 1))] * 2
    assert instants(df.limit(0), "v", "o", "z").count() == 0
    with pytest.raises(ValueError):
        instants(df.withColumnRenamed("note", "utc_us"), "v", "o", "z")


def test_long_values_and_far_years():
    far = datetime(9000, 7, 1, 12, tzinfo=ZoneInfo("Europe/Berlin"))
    assert one("9000-07-01 12:00:00") == int(far.timestamp()) * 1_000_000
    assert one("9000-01-01 12:00:00") == int(datetime(9000, 1, 1, 12, tzinfo=ZoneInfo("Europe/Berlin")).timestamp()) * 1_000_000
    assert one("2024-01-05 10:00:00 +0000 (" + "x" * 5000 + ")") == us(2024, 1, 5, 10)
    assert one("x" * 100_000) is None and one("86400") == 86_400_000_000 and one("0") == 0 and one("-5") == -5_000_000

"""Rows of Spark and DuckDB in one comparable form."""

from __future__ import annotations

import decimal
from collections import Counter

import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, float | np.floating | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, np.integer):
        return int(v)
    return str(v) if isinstance(v, pd.Timestamp) else v


def rows(frame: pd.DataFrame) -> Counter:
    columns = sorted(frame.columns)
    return Counter(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))

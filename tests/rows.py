"""Rows of a Spark or DuckDB result, in a form that can be compared."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7) + 0.0
    return str(v) if isinstance(v, pd.Timestamp) else v


def counted(df: pd.DataFrame) -> Counter:
    return Counter(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))

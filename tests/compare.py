"""Rows of Spark and DuckDB in one form, for comparison without order."""

import datetime

import numpy as np
import pandas as pd


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return int(x) if float(x).is_integer() else round(float(x), 6)
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (pd.Timestamp, datetime.datetime)):
        return str(pd.Timestamp(x).tz_localize(None))
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)

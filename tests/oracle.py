"""Rows of a Spark query and of its SQL, in one form."""

import datetime
import math

import duckdb
import pandas as pd

from tidemark.sources.tables import TABLES


def connection(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _one(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else f"{v:.9g}"
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return str(pd.Timestamp(v))
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_one(v) or "" for v in r) for r in frame.itertuples(index=False, name=None))

"""Rows of Spark and DuckDB in one form."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pandas as pd

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tables(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _plain(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, (datetime.date, pd.Timestamp)):
        return pd.Timestamp(x).isoformat()
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_plain, r)) for r in df.itertuples(index=False, name=None))

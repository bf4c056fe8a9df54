"""Compare a Spark result with the SQL result on the same tables, order aside."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        v = float(v)
        return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return pd.Timestamp(v).isoformat()
    return str(v)


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def differences(spark_df, connection, sql: str) -> str | None:
    """None when columns, row count and every value agree."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} and {sorted(names)}"
    want = rows(names, result.fetchall())
    have = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(want) != len(have):
        return f"{len(have)} rows, expected {len(want)}"
    bad = [(h, w) for h, w in zip(have, want) if h != w]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else None

"""Holds a query's rows against those of its SQL in DuckDB."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return c


def plain(v):
    if v is None or v is pd.NA or isinstance(v, (float, np.floating)) and v != v:
        return "None"
    if isinstance(v, (float, np.floating)):
        # whole numbers beside nulls come as floats from one side and not from the other
        return str(int(v)) if float(v).is_integer() else repr(round(float(v), 6))
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    return str(bool(v)) if isinstance(v, (bool, np.bool_)) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False))


def same(df, sql, connection):
    names, got = rows(df.toPandas())
    want_names, want = rows(connection.execute(sql).df())
    assert names == want_names
    assert len(got) == len(want)
    assert got == want

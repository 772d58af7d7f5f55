"""Order-insensitive comparison of a Spark result with DuckDB's on the same tables."""

import os

import numpy as np
import pandas as pd


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, np.generic):
        return _plain(v.item())
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (np.ndarray, list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_plain(x)}" for k, x in sorted(v.items())) + "}"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


def normal(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(_plain, r)) for r in df.itertuples(index=False, name=None))

"""Compare a Spark DataFrame with a DuckDB SQL oracle on the same parquet tables.

Mirrors the driver's check: same column names, same row count, and the same
multiset of rows (order-insensitive).  Floats must agree exactly unless a
tolerance is given; the result says how far apart they were.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import duckdb
import numpy as np
import pandas as pd

from riskspark.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@dataclass
class Match:
    ok: bool
    rows: tuple[int, int]
    detail: str
    max_abs_diff: float = 0.0


def _norm(pdf: pd.DataFrame) -> pd.DataFrame:
    out = pdf.copy()
    for c in out.columns:
        s = out[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            out[c] = pd.to_datetime(s).astype(str)
        elif s.dtype == object:
            first = next((v for v in s if v is not None and not (isinstance(v, float) and math.isnan(v))), None)
            if first is not None and hasattr(first, "isoformat"):
                out[c] = pd.to_datetime(s).astype(str)
            elif isinstance(first, (bool, np.bool_)):
                out[c] = s.astype("boolean")
        if pd.api.types.is_bool_dtype(out[c]):
            out[c] = out[c].astype("Int64")
        elif pd.api.types.is_integer_dtype(out[c]):
            out[c] = out[c].astype("Int64")
    return out[sorted(out.columns)]


def compare(spark_df, sql: str, con: duckdb.DuckDBPyConnection, tol: float = 0.0) -> Match:
    left = _norm(spark_df.toPandas())
    right = _norm(con.execute(sql).df())
    if list(left.columns) != list(right.columns):
        return Match(False, (len(left), len(right)), f"columns {list(left.columns)} vs {list(right.columns)}")
    if len(left) != len(right):
        return Match(False, (len(left), len(right)), "row count")
    cols = list(left.columns)
    key = lambda df: df.sort_values(cols, na_position="first", kind="mergesort").reset_index(drop=True)
    a, b = key(left), key(right)
    worst = 0.0
    for c in cols:
        x, y = a[c], b[c]
        if pd.api.types.is_float_dtype(x) or pd.api.types.is_float_dtype(y):
            xv, yv = x.astype(float).to_numpy(), y.astype(float).to_numpy()
            both_nan = np.isnan(xv) & np.isnan(yv)
            diff = np.where(both_nan, 0.0, np.abs(xv - yv))
            diff = np.where(np.isnan(diff), np.inf, diff)
            worst = max(worst, float(diff.max()) if len(diff) else 0.0)
            if (diff > tol).any():
                i = int(np.argmax(diff > tol))
                return Match(False, (len(a), len(b)), f"{c} row {i}: {xv[i]!r} vs {yv[i]!r}", worst)
        else:
            xs = x.astype(object).where(x.notna(), None).tolist()
            ys = y.astype(object).where(y.notna(), None).tolist()
            if xs != ys:
                i = next(k for k, (p, q) in enumerate(zip(xs, ys)) if p != q)
                return Match(False, (len(a), len(b)), f"{c} row {i}: {xs[i]!r} vs {ys[i]!r}", worst)
    return Match(True, (len(a), len(b)), "ok", worst)

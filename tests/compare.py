"""Compare registered queries with their SQL on given tables."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def sql_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con.sql(sql).df()


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: df[c].dtype.kind for c in df.columns}


def normalized(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].where(df[c].notna(), None).astype(str)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql: pd.DataFrame) -> str | None:
    """What differs, or ``None``."""
    if sorted(spark_rows.columns) != sorted(sql.columns):
        return f"columns {sorted(spark_rows.columns)} / {sorted(sql.columns)}"
    if len(spark_rows) != len(sql):
        return f"{len(spark_rows)} / {len(sql)} rows"
    a, b = normalized(spark_rows), normalized(sql)
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind:
            return f"{c}: types {a[c].dtype} / {b[c].dtype}"
        if a[c].dtype.kind == "f":
            same = np.isclose(a[c], b[c], rtol=0, atol=1e-12, equal_nan=True)
        else:
            same = (a[c] == b[c]).to_numpy()
        if not same.all():
            at = int(np.argmin(same))
            return f"{c}: {int((~same).sum())} differ, first {a[c][at]!r:.200} / {b[c][at]!r:.200}"
    return None

"""Comparison of a query with its SQL in DuckDB."""

import duckdb
import pandas as pd


def connect(root):
    c = duckdb.connect()
    for f in root.iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return c


def cell(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str(list(v))
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else cell(v) for v in row) for row in df.itertuples(index=False))


def assert_same(spark, root, query, sql):
    got, want = query(spark, str(root)).toPandas(), connect(root).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)

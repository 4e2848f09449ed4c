"""Compares a Spark result with DuckDB's over the same files."""

import glob
import os

import duckdb
import pandas as pd


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    return format(v, ".9g") if isinstance(v, float) and not v.is_integer() else str(int(v)) if isinstance(v, (int, float)) else str(v)


def same_rows(df, sql, sf_dir):
    db = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    ours, theirs = df.toPandas(), db.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    rows = lambda x: sorted("|".join(map(plain, r)) for r in x[columns].itertuples(index=False, name=None))
    assert rows(ours) == rows(theirs)

"""Compares a query with its SQL in DuckDB over one folder of tables."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    """The rows as sorted tuples of strings; numbers to six digits."""

    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        return repr(round(float(v), 6)) if isinstance(v, int | float) or type(v).__module__ == "numpy" else str(v)

    ordered = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in ordered.astype(object).itertuples(index=False))


def same(got: pd.DataFrame, sql: str, sf_dir: str) -> None:
    want = connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

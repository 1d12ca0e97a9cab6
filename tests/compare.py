"""Comparing a Spark result with DuckDB's."""

import glob
import numbers
import os

import duckdb
import pandas as pd


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return None
        if isinstance(x, numbers.Real) and not isinstance(x, bool):
            return round(float(x), 5)
        return str(x)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)

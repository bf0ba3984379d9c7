"""Compares a query's rows with its SQL's."""

import math
import os

import duckdb
import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    if hasattr(v, "tolist"):
        return plain(v.tolist()) if not hasattr(v, "__len__") else tuple(map(plain, v))
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


def database(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    return c


def agrees(spark, f, sql: str, folder: str) -> None:
    got, want = f(spark, folder).toPandas(), database(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

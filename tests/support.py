"""Comparison of Spark queries with DuckDB on one data folder."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((plain(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)


def duck(sql, folder=DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((plain(tuple(r[i] for i in order)) for r in result.fetchall()), key=repr)

"""Spark and DuckDB side by side, as the driver does it."""

import math
import os

import duckdb


def database(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)

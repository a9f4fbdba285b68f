"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

import glob
import math
import os

import duckdb


def clean(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, list | tuple):
        return tuple(clean(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=str)


def duck_rows(sql, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    return cols, sorted((tuple(clean(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=str)

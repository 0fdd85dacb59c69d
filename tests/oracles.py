"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import glob
import os

import duckdb


def cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


def same_rows(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = sorted("|".join(map(cell, r)) for r in df.select(*cols).collect())
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f).split('.')[0]} as select * from '{f}'")
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert ours == sorted("|".join(cell(r[i]) for i in order) for r in theirs.fetchall())

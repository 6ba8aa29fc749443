"""Runs a query and its SQL twin and compares them as sets of rows."""

import glob
import math
import os

import duckdb


def views(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    return ("nan" if math.isnan(v) else round(v, 5)) if isinstance(v, float) else v


def same(df, con, sql):
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(cols) == sorted(names)
    other = got.fetchall()
    key = lambda rs, cs: sorted(repr([norm(r[cs.index(c)]) for c in sorted(cs)]) for r in rs)
    assert key(rows, cols) == key(other, names)

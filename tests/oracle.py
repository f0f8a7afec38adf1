"""A query's rows against its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


def same_rows(df, sql, con):
    cols = sorted(df.columns)
    got = sorted((tuple(_cell(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    res = con.sql(sql)
    assert sorted(res.columns) == cols, (sorted(res.columns), cols)
    at = [res.columns.index(c) for c in cols]
    want = sorted((tuple(_cell(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(got)

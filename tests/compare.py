"""Runs a query on Spark and its SQL on DuckDB over the same Parquet tables and compares both as multisets."""

import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 8)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v if isinstance(v, (int, bool, str, type(None))) else str(v)


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


def same(spark, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = connect(folder).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])

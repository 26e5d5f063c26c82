"""Compare a query with its SQL: rows as multisets, floats to nine digits."""

import glob
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        g = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{g}')")
    return c


def text(x):
    return "%.9g" % (x + 0.0) if isinstance(x, float) else str(x)


def same(df, connection, sql):
    found = connection.execute(sql)
    cols = [d[0] for d in found.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    a = sorted(tuple(map(text, r)) for r in df.collect())
    b = sorted(tuple(text(r[i]) for i in order) for r in found.fetchall())
    assert a == b
    return len(a)

"""Run a query and its DuckDB form over the tables of a folder and compare the rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def norm(v):
    return (None if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


def same(df, sql, sf_dir):
    names, want = duck(sql, sf_dir)
    order = sorted(names)
    assert sorted(df.columns) == order, (df.columns, names)
    got = sorted(([norm(r[c]) for c in order] for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    want = sorted(([norm(r[i]) for i in at] for r in want), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want, strict=True) if repr(g) != repr(w)]
    assert not bad, (order, len(bad), bad[:3])

"""Run a query and its SQL on the same tables and compare the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "quantize"):
        return float(f"{float(v):.9g}")
    if isinstance(v, list):
        return str([_plain(x) for x in v])
    return v.isoformat() if hasattr(v, "isoformat") else v


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want

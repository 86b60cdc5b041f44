"""Compares a query with its SQL over the same tables."""

import math
import os

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    return x


def differences(df, sql, con):
    """Nothing if both give the same rows and columns, else what differs first."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = sorted([tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()], key=repr)
    got = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=repr)
    if got != want:
        return f"{len(got)} and {len(want)} rows; " + str(next(((a, b) for a, b in zip(got, want) if a != b), ""))
    return "" if got else "no rows"

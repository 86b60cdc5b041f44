"""Compares a query with its SQL over the same tables."""

import os

import duckdb


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}" + ("/*" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted([tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()], key=repr), sorted(names)


def same(df, sql, sf_dir):
    want, names = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == names
    got = sorted([tuple(r[c] for c in names) for r in df.collect()], key=repr)
    assert len(got) == len(want)
    assert got == want, next((a, b) for a, b in zip(got, want) if a != b)

"""Compares a query with its SQL: column names, and rows without their order."""

import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def both(df, con, sql):
    """Sorted rows of the query and of its SQL."""
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    cursor = con.execute(sql)
    at = [d[0] for d in cursor.description]
    assert sorted(at) == names
    want = sorted(tuple(plain(r[at.index(n)]) for n in names) for r in cursor.fetchall())
    return got, want

"""Compares a query's rows with those of its SQL, columns by name and rows in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if hasattr(v, "tzinfo") and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is not None, str(type(x)) if x is None else "", x if x is not None else 0) if not isinstance(x, (bool, list)) else (True, "", str(x)) for x in r))


def differs(df, con, sql):
    """None, or what differs."""
    got = rows_of(df.columns, df.collect())
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    want = rows_of(names, out.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, not {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}; {got[:2]} {want[:2]}"
    return next((f"{a}, not {b}" for a, b in zip(got, want, strict=True) if a != b), None)

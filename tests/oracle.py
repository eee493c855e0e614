"""Compares a query's rows with its DuckDB oracle on the same tables."""

import glob
import math

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return "null" if x is None else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_cell(row[k]) for k in order) for row in rows)


def mismatch(df, con, sql):
    """None if equal, else a text that says how they differ."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = rows_of(names, found.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} for {sorted(names)}"
    got = rows_of(df.columns, df.collect())
    if got == want:
        return None
    a, b = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} rows for {len(want)}; only here {sorted(a)[:3]}; only there {sorted(b)[:3]}"

"""Holds a query's rows against those of its SQL on DuckDB."""

import math
from pathlib import Path

import duckdb


def connected(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v) -> str:
    if isinstance(v, float) and not math.isnan(v):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same_rows(df, sql: str, sf: str) -> None:
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = connected(sf).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall())
    assert got == want

"""Rows of a Spark query and of its SQL in a form in which they can be compared."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(made, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def differences(df, con, sql: str) -> str:
    """What differs, in a line; empty if nothing does."""
    found = con.execute(sql)
    want_names, want = rows_of([d[0] for d in found.description], found.fetchall())
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if names != want_names:
        return f"columns {names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    off = [(a, b) for a, b in zip(got, want, strict=True) if not same(a, b)]
    return f"{len(off)} of {len(got)} rows differ, as {off[0][0]} and {off[0][1]} in {names}" if off else ""


def same(a, b) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 1.1e-5 + 1e-9 * abs(a)
    return a == b

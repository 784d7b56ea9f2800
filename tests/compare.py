"""Spark rows against DuckDB rows, without regard to order."""

from __future__ import annotations

import math
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (int, str)):
        return float(x) if isinstance(x, int) else x
    if isinstance(x, (datetime, date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return float(x) if hasattr(x, "as_tuple") else str(x)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty when both have the same columns and rows."""
    names, want = duck(sql, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want)
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want, strict=True):
        if not all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return ""

"""Runs a query and its SQL on the same tables and compares the rows, order left out."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool, bytes)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else round(v, 6) if abs(v) < 1e6 else float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, sf_dir) -> str | None:
    """None if both agree, else what differs."""
    df = query(spark, sf_dir)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).execute(sql)
    b = rows_of([d[0] for d in rel.description], rel.fetchall())
    if a[0] != b[0]:
        return f"{name}: columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{name}: {len(a[1])} and {len(b[1])} rows"
    norm = lambda rows: [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r) for r in rows]
    x, y = sorted(norm(a[1]), key=repr), sorted(norm(b[1]), key=repr)
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{name}: {len(bad)} of {len(x)} rows differ, as {bad[0]}" if bad else None

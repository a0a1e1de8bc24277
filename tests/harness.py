"""Compare a Spark result with the same query in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _kind(v):
    return type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows]


def compare(spark_df, con, sql):
    """Return a list of differences; empty when both sides agree exactly."""
    rel = con.execute(sql)
    dcols = [c[0] for c in rel.description]
    drows = rel.fetchall()
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    if sorted(dcols) != sorted(scols):
        return [f"columns: spark {sorted(scols)} duck {sorted(dcols)}"]
    if len(drows) != len(srows):
        return [f"rows: spark {len(srows)} duck {len(drows)}"]
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a.sort(key=key)
    b.sort(key=key)
    out = []
    kinds = {(_kind(x), _kind(y)) for r, s in zip(a, b) for x, y in zip(r, s) if x is not None and y is not None}
    odd = [k for k in kinds if k[0] != k[1]]
    if odd:
        out.append(f"types: {odd}")
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        out.append(f"{len(diff)} of {len(a)} rows differ, e.g. {diff[:3]}")
    return out

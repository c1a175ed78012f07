"""Bag comparison of a Spark result with the checking engine's result."""
from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dict):
        return {k: _value(x) for k, x in v.items()}
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_value(r[i]) for i in order]) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; empty if both sides agree."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rel.fetchall()
    ours = df.collect()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    a, b = bag(df.columns, [tuple(r) for r in ours]), bag(names, theirs)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2] + ["--"] + [x for x in b if x not in set(a)][:2]
        return [f"rows {len(a)} / {len(b)}", *extra]
    return [f"{x}\n   / {y}" for x, y in zip(a, b) if x != y][:2]

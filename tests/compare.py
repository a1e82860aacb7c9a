"""Compares a Spark result with a DuckDB result: columns, types, rows."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    described = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(types) != sorted(described):
        return f"columns {sorted(types)} vs {sorted(described)}"
    wrong = {n: (types[n], described[n]) for n in types if TYPES.get(types[n]) != described[n]}
    if wrong:
        return f"types {wrong}"
    names = sorted(types)
    ours = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    cur = con.execute(sql)
    order = [d[0] for d in cur.description]
    index = [order.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in index) for r in cur.fetchall()), key=_key)
    if not ours and not theirs:
        return "both empty"
    bad = [(a, b) for a, b in zip(ours, theirs) if not all(_same(x, y) for x, y in zip(a, b))]
    if len(ours) != len(theirs) or bad:
        lone = list((set(ours) - set(theirs)))[:2], list((set(theirs) - set(ours)))[:2]
        return f"{len(ours)} vs {len(theirs)} rows, {len(bad)} differ; columns {names}\n  only spark: {lone[0]}\n  only sql: {lone[1]}"
    return None

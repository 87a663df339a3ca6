"""Runs registered queries against their SQL in DuckDB, as the driver does: rows compared without order, columns by name."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, bool) or value is None:
        return value
    if hasattr(value, "asDict"):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(plain(x) for x in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if type(value).__name__ == "Decimal":
        return int(value) if value == int(value) else float(value)
    return value


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if results are equal, else what differs."""
    names = sorted(df.columns)
    got = Counter(tuple(plain(row[c]) for c in names) for row in df.collect())
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    at = [columns.index(c) for c in names]
    want = Counter(tuple(plain(row[i]) for i in at) for row in found.fetchall())
    if got == want:
        return "" if got else "both are empty"
    return f"{sum(got.values())} and {sum(want.values())} rows; only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"

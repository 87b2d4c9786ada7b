"""Holds a query's rows against its DuckDB SQL: same columns, same rows in any order, repeats counted."""

from __future__ import annotations

import glob
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        files = glob.glob(f"{sf_dir}/{t}.parquet/*.parquet") or [f"{sf_dir}/{t}.parquet"]
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x if x != int(x) or abs(x) > 1e15 else int(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(value(r[k]) for k in order) for r in data)


def differences(df, con, sql: str) -> str:
    got = con.sql(sql)
    if sorted(df.columns) != sorted(got.columns):
        return f"columns {sorted(df.columns)} and {sorted(got.columns)}"
    a, b = rows(df.columns, df.collect()), rows(got.columns, got.fetchall())
    if a == b:
        return ""
    return f"{a.total()} and {b.total()} rows; only in Spark {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"

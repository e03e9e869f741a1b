"""Side by side: a query's rows in Spark and its SQL's rows in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings raw_text semantic_blocks canonical_resume relationships job_titles items mix_targets split_limits".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def value(x):
    """A value that compares equal across both engines."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int):
        return float(f"{x:.9g}") if abs(x) < 1e9 else x
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    if isinstance(x, dict):
        return tuple((k, value(v)) for k, v in x.items())
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in data)


def differences(spark_frame, con, sql) -> str:
    """Empty if both have the same columns and rows, else what differs."""
    theirs = con.execute(sql)
    names = [c[0] for c in theirs.description]
    if sorted(names) != sorted(spark_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(names)}"
    a, b = rows(spark_frame.columns, [tuple(r) for r in spark_frame.collect()]), rows(names, theirs.fetchall())
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"

"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 9)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def difference(spark, con, sf: str, query, sql: str) -> str:
    """'' if both agree in column names and rows, else what differs."""
    frame = query(spark, sf)
    got_names = frame.columns
    result = con.execute(sql)
    want_names = [d[0] for d in result.description]
    want = rows_of(want_names, result.fetchall())
    got = rows_of(got_names, [tuple(r) for r in frame.collect()])
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(set(got_names) ^ set(want_names))}"
    if got == want:
        return "" if got else "no rows"
    extra, missing = list((got - want).items()), list((want - got).items())
    return f"{sum(got.values())} rows against {sum(want.values())}; extra {extra[:2]}; missing {missing[:2]}"

"""Runs a query and its SQL on the same tables and compares rows, columns sorted by name."""

from __future__ import annotations

import math
import os

import duckdb


def tables(sf_dir: str):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def _clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(_clean(r[k]) for k in order) for r in data), key=repr)


def compare(spark, connection, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = connection.sql(sql)
    want = rows(r.columns, r.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    return next((f"{a} and {b}" for a, b in zip(got[1], want[1]) if a != b), "")[:400]

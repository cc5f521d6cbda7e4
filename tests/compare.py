"""Runs registered queries next to their SQL and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _key(row):
    return [(v is None, type(v).__name__, str(v)) for v in row]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_key)


KIND = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def compare(spark, con, query, sql, sf_dir) -> str | None:
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_cols, want = rows_of(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    kinds = {c: KIND.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    spark_kinds = {c: t for c, t in df.dtypes if kinds[c] != t}
    if spark_kinds:
        return f"types {spark_kinds} vs { {c: kinds[c] for c in spark_kinds} }"
    if got != want:
        a = [r for r in got if r not in set(want)][:3]
        b = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} vs {len(want)} rows; only Spark {a}; only SQL {b}"
    return None

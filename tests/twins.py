"""Comparing a query with its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "∅" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (float, Decimal)) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(spark, sf: str, query, sql: str) -> None:
    t = query(spark, sf).toArrow()
    got = canonical(t.column_names, list(zip(*[c.to_pylist() for c in t.columns], strict=True)) if t.num_rows else [])
    r = connect(sf).execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(t.column_names) == sorted(names)
    assert got == canonical(names, r.fetchall())

"""Compare a Spark result with DuckDB SQL over the same tables, ignoring row order."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def cell(v) -> str:
    return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def same(df, con, sql: str) -> None:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = sorted(tuple(cell(r[i]) for i in order) for r in result.fetchall())
    got = sorted(tuple(map(cell, r)) for r in df.collect())
    assert len(got) == len(want)
    assert got == want

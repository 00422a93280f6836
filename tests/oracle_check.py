"""Compare registered queries with their SQL on DuckDB: rows, columns, values."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def canon(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, int):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name, fn, sql, con):
    """(ok, message)"""
    t = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t_spark = time.time() - t
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {t_spark:.1f}s"
    t = time.time()
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    note = f"{len(got)} rows, spark {t_spark:.1f}s, sql {time.time() - t:.1f}s"
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return False, (f"{note}; expected {len(want)} rows; {len(a)} only in Spark, {len(b)} only in SQL\n"
                       f"   spark: {[tuple(c[:300] for c in r) for r in sorted(a)[:2]]}\n"
                       f"   sql:   {[tuple(c[:300] for c in r) for r in sorted(b)[:2]]}")
    return True, note

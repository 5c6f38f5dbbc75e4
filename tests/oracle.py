"""Run registered queries and their SQL twins side by side and compare the rows."""

from __future__ import annotations

import glob
import math
import os
from datetime import date, datetime

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime | date):
        return value.isoformat()
    if isinstance(value, list | tuple):
        return "[" + ",".join(_plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{_plain(v)}" for k, v in sorted(value.items())) + "}"
    return repr(value)


def spark_rows(df):
    columns = sorted(df.columns)
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return columns, sorted("|".join(_plain(r[c]) for c in columns) for r in rows)


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = cursor.fetchall()
    return sorted(names), sorted("|".join(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    columns, mine = spark_rows(df)
    names, theirs = duck_rows(con, sql)
    if columns != names:
        return f"columns {columns} != {names}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, first:\n  spark {wrong[0][0]}\n  sql   {wrong[0][1]}"
    return None

"""Queries over the given tables, each with its SQL twin where SQL can say it.

A query is a function ``(spark, sf_dir) -> DataFrame`` registered under the
operator's ID; the twin is a string DuckDB runs on the same tables. Bars are
built from the tables by ``bars1`` (daily, from orders), ``bars2`` (4 hours,
from events) and ``bars3`` (daily, many series, from lineitem).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.series import Series
from barspark.sources.bars import bars_from_ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAILY = Series(keys=("symbol",), step=86_400)
FOUR_HOURS = Series(keys=("symbol",), step=4 * 3600)


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars1(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_ticks(
        table(spark, sf, "orders"), {"symbol": F.col("o_orderpriority")}, F.col("o_orderdate"), F.col("o_totalprice"),
        F.col("o_orderkey"), "row",
    )


def bars2(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_ticks(
        table(spark, sf, "events"), {"symbol": F.col("event_type")}, F.col("ts"), F.col("value"),
        F.struct("ts", "event_id"), "4 hours",
    )


def bars3(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return bars_from_ticks(
        table(spark, sf, "lineitem"), {"symbol": F.col("l_suppkey")}, F.col("l_shipdate"), price,
        F.struct("l_orderkey", "l_linenumber", "l_partkey", price), "row", F.col("l_quantity"),
    )


_PICK = """{first}(p, o) AS open, max(p) AS high, min(p) AS low, {last}(p, o) AS close, sum(v) AS volume"""
_AGG = _PICK.format(first="min_by", last="max_by")
BARS = f"""
b1 AS (SELECT symbol, ts, {_AGG} FROM (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice AS p,
       o_orderkey AS o, 1.0::DOUBLE AS v FROM orders) GROUP BY ALL),
b2 AS (SELECT symbol, ts, {_AGG} FROM (SELECT event_type AS symbol, time_bucket(INTERVAL '4 hours', ts) AS ts,
       value AS p, row(ts, event_id) AS o, 1.0::DOUBLE AS v FROM events) GROUP BY ALL),
b3 AS (SELECT symbol, ts, {_AGG} FROM (SELECT l_suppkey AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS p,
       row(l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity) AS o, l_quantity AS v FROM lineitem) GROUP BY ALL),
p1 AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM b1 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
p2 AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM b2 WINDOW w AS (PARTITION BY symbol ORDER BY ts))
"""
W = "(PARTITION BY symbol ORDER BY ts)"


def frame(back: int, end: int = 0) -> str:
    """A window over the rows from ``back`` behind to ``end`` (0: current, negative: behind)."""
    last = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {back} PRECEDING AND {last})"


UPTO = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ONWARD = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(({expression})::DOUBLE, {digits}) + 0.0 AS {name}"


def sql(*ctes_and_select: str) -> str:
    """WITH bars, more CTEs, then the final SELECT."""
    *ctes, select = ctes_and_select
    return "WITH " + ",\n".join([BARS.strip(), *ctes]) + "\n" + select


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, special.get(c, digits)) for c in doubles})


def keep(df: DataFrame, *columns: str, digits: int = 6, **special: int) -> DataFrame:
    return rounded(df.select(*columns), digits, **special)

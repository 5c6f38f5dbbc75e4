"""Trades: stretches of constant non-zero weight, numbered in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.series import Rolling, Running, Series, running, windowed

# Trade table columns, in file order.
TRADE_COLUMNS = (
    "trade_id", "entry_ts", "exit_ts", "direction", "entry_weight", "exit_weight",
    "gross_return_simple", "net_return_simple", "bars", "turnover_sum", "cost_sum",
)


def trade_ids(df: DataFrame, spec: Series, weight: str = "weight") -> DataFrame:
    """Add ``trade_id``: the number of trade starts so far (meaningful where weight is not 0)."""
    w_now = F.col(weight)
    start = Rolling(
        lambda w: ((w_now != 0) & (F.coalesce(F.lag(weight).over(w), F.lit(0.0)) != w_now)).cast("int"), back=1
    )
    out = windowed(df, spec, {"__start": start})
    return running(out, spec, {"trade_id": Running("sum", F.col("__start"))}).drop("__start")


def trade_table(df: DataFrame, spec: Series) -> DataFrame:
    """One row per trade from the rows of ``evaluate_returns``."""
    ts = F.col(spec.ts)
    return (
        trade_ids(df, spec)
        .filter(F.col("weight") != 0)
        .groupBy(*spec.by("trade_id"))
        .agg(
            F.min(ts).alias("entry_ts"),
            F.max(ts).alias("exit_ts"),
            F.min_by("weight", ts).alias("entry_weight"),
            F.max_by("weight", ts).alias("exit_weight"),
            (F.product(1 + F.col("strategy_simple_r")) - 1).alias("gross_return_simple"),
            (F.product(1 + F.col("strategy_simple_r_net")) - 1).alias("net_return_simple"),
            F.count(F.lit(1)).alias("bars"),
            F.sum("turnover").alias("turnover_sum"),
            F.sum("cost_simple").alias("cost_sum"),
        )
        .withColumn("direction", F.when(F.col("entry_weight") > 0, F.lit("long")).otherwise(F.lit("short")))
        .select(*spec.keys, *TRADE_COLUMNS)
    )


def trade_returns(df: DataFrame, spec: Series, column: str = "strategy_simple_r_net") -> DataFrame:
    """Compounded return of each trade."""
    return (
        trade_ids(df, spec)
        .filter(F.col("weight") != 0)
        .groupBy(*spec.by("trade_id"))
        .agg((F.product(1 + F.col(column)) - 1).alias("trade_return"))
    )

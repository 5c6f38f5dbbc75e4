"""The returns and cost block: price + signal to weighted, net-of-cost returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import fee_rate, net_log_return
from barspark.operators import windows as W
from barspark.operators.sizing import _HELPERS, size_positions, sizing_layers
from barspark.series import Series, stage, windowed


def _return_layer(price: str) -> dict:
    return {"r": W.forward_log_return(price), "simple_r": W.forward_simple_return(price)}


def _net_columns(rate: float | Column) -> list[tuple[str, Column]]:
    return [
        ("strategy_r", F.col("r") * F.col("weight")),
        ("strategy_simple_r", F.col("simple_r") * F.col("weight")),
        ("cost_simple", (F.lit(rate) if isinstance(rate, float) else rate) * F.col("turnover")),
        ("strategy_simple_r_net", F.col("strategy_simple_r") - F.col("cost_simple")),
        ("strategy_r_net", net_log_return(F.col("strategy_simple_r_net"))),
    ]


def evaluate_returns(
    df: DataFrame,
    spec: Series,
    price: str = "close",
    tf: str | None = None,
    sizing: str = "full_notional",
    sizing_params: dict | None = None,
    fee_bps: float | None = None,
    slippage_bps: float = 0.0,
    mode: str = "spot",
    rate: Column | None = None,
    drop_open_end: bool = True,
) -> DataFrame:
    """Add r, simple_r, weight, turnover, cost and gross/net returns to rows with ``signal``.

    Bounded sizing modes share one shuffle with the returns. ``rate`` replaces
    the fee arguments by a per-row cost rate (a swept parameter, for example).
    ``drop_open_end`` drops the last bar, which has no forward return.
    """
    turnover = {"turnover": W.turnover("weight")}
    if sizing == "fixed_notional":
        out = stage(windowed(df, spec, _return_layer(price)))
        out = windowed(size_positions(out, spec, sizing, sizing_params, tf), spec, turnover)
    else:
        out = windowed(df, spec, _return_layer(price), *sizing_layers(sizing, sizing_params, tf), turnover).drop(*_HELPERS)
    for name, column in _net_columns(rate if rate is not None else fee_rate(fee_bps, slippage_bps, mode)):
        out = out.withColumn(name, column)
    return out.dropna(subset=["r", "strategy_r"]) if drop_open_end else out

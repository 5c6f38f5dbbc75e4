"""Evaluation plans: in-sample, walk-forward, sweeps."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators import metrics as M
from barspark.operators import windows as W
from barspark.operators.folds import lead_in, walk_forward_signals
from barspark.operators.permute import cut_back
from barspark.operators.prices import with_price
from barspark.operators.returns import evaluate_returns
from barspark.operators.signals import ma_long_flat_layers
from barspark.operators.strategies import Strategy
from barspark.operators.trades import trade_table
from barspark.series import Series, ensure_positions, stage, windowed


@dataclass(frozen=True)
class Run:
    """Settings of one evaluation."""

    start: str | None = None
    end: str | None = None
    tf: str = "1d"
    fee_bps: float | None = None
    slippage_bps: float = 0.0
    mode: str = "spot"
    sizing: str = "full_notional"
    sizing_params: dict = field(default_factory=dict)

    def costs(self) -> dict:
        return {
            "tf": self.tf,
            "sizing": self.sizing,
            "sizing_params": self.sizing_params,
            "fee_bps": self.fee_bps,
            "slippage_bps": self.slippage_bps,
            "mode": self.mode,
        }


def date_slice(df: DataFrame, spec: Series, start: str | None, end: str | None) -> DataFrame:
    """start <= ts < end; the filter reaches the parquet scan. Positions are dropped, as they changed."""
    ts = F.col(spec.ts)
    if start:
        df = df.filter(ts >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.filter(ts < F.lit(end).cast("timestamp_ntz"))
    return cut_back(df) if start or end else df


def crossover_summary(bars: DataFrame, spec: Series, price: str = "close", fast: int = 10, slow: int = 30) -> DataFrame:
    """The minimum slice: long/flat crossover to profit factor and Sharpe per series, in one windowed pass."""
    rows = windowed(
        bars.select(*spec.by(spec.ts, price)),
        spec,
        {**ma_long_flat_layers(price, fast, slow, "signal")[0], "r": W.forward_log_return(price)},
        ma_long_flat_layers(price, fast, slow, "signal")[1],
    )
    earned = F.col("signal") * F.col("r")
    return rows.groupBy(*spec.keys).agg(
        F.round(M.profit_factor(earned), 6).alias("profit_factor"), F.round(M.sharpe(earned), 6).alias("sharpe")
    )


def in_sample_returns(bars: DataFrame, spec: Series, strategy: Strategy, run: Run, params: DataFrame | None = None) -> DataFrame:
    """Fit and score on one slice: the returns block of every bar."""
    rows = ensure_positions(date_slice(bars, spec, run.start, run.end), spec)
    rows = with_price(rows, spec, strategy.price)
    if params is None:
        rows = stage(rows)
    fitted = strategy.fit(rows, spec) if params is None else params
    return evaluate_returns(strategy.signals(rows, fitted, spec), spec, strategy.price, **run.costs())


def walk_forward_returns(bars: DataFrame, spec: Series, strategy: Strategy, run: Run, length: int, step: int) -> DataFrame:
    """Out-of-sample returns block: lead-in slice, fold signals, costs on the padded slice, then trim."""
    rows = lead_in(bars, spec, run.start, run.end, length) if run.start else ensure_positions(bars, spec)
    rows = with_price(rows, spec, strategy.price)
    signals = walk_forward_signals(rows, spec, strategy, length, step)
    scored = evaluate_returns(signals, spec, strategy.price, **run.costs())
    if run.start:
        scored = scored.filter(F.col(spec.ts) >= F.lit(run.start).cast("timestamp_ntz"))
    return scored


def all_metrics(rows: DataFrame, spec: Series, tf: str) -> DataFrame:
    """Every metric of a returns block, one row per series.

    ``rows`` is read by four aggregates; stage it first when it is expensive.
    Its positions stay valid: only rows at the ends of a series were dropped.
    """
    keys = list(spec.keys)
    base = rows.groupBy(*keys).agg(*M.return_stats(tf), *M.cost_stats(tf))
    falls = W.drawdown(rows, spec, "strategy_simple_r_net").groupBy(*keys).agg(
        (F.avg("drawdown") * 100).alias("avg_net_drawdown_pct"), (F.min("drawdown") * 100).alias("max_net_drawdown_pct")
    )
    trades = M.trade_stats(trade_table(rows, spec), spec)
    parts = [base, falls, M.tail_risk(rows, spec, "strategy_simple_r_net")]
    joined = reduce(lambda a, b: a.join(b, keys), parts).join(trades, keys, "left")
    return joined.withColumn("num_trades", F.coalesce("num_trades", F.lit(0)))


def in_sample(bars: DataFrame, spec: Series, strategy: Strategy, run: Run, params: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(staged returns block, metrics)."""
    rows = stage(in_sample_returns(bars, spec, strategy, run, params))
    return rows, all_metrics(rows, spec, run.tf)


def walk_forward(bars: DataFrame, spec: Series, strategy: Strategy, run: Run, length: int, step: int) -> tuple[DataFrame, DataFrame]:
    rows = stage(walk_forward_returns(bars, spec, strategy, run, length, step))
    return rows, all_metrics(rows, spec, run.tf)

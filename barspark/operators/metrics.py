"""Performance aggregates. All are partial aggregates: one shuffle of one row per key and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import annualisation, parse_minutes
from barspark.operators.quantiles import exact_quantiles, salted_values
from barspark.series import Running, Series, running, spread_join, stage


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def gains(x: Column | str) -> Column:
    x = _col(x)
    return F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0))


def losses(x: Column | str) -> Column:
    x = _col(x)
    return F.coalesce(F.sum(F.when(x < 0, -x)), F.lit(0.0))


def profit_ratio(gain: Column, loss: Column) -> Column:
    """Gain over loss; infinite with gains only, 0 with neither."""
    return F.when(loss > 0, F.try_divide(gain, loss)).when(gain > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def profit_factor(x: Column | str) -> Column:
    return profit_ratio(gains(x), losses(x))


def sharpe(x: Column | str, annual: float | Column = 1.0) -> Column:
    x = _col(x)
    return F.try_divide(F.avg(x), F.stddev_samp(x)) * annual


def total_log(x: Column | str) -> Column:
    return F.sum(_col(x))


def total_simple(x: Column | str) -> Column:
    return F.product(1 + _col(x)) - 1


def final_capital(x: Column | str, start: float = 100_000.0) -> Column:
    return start * F.product(1 + _col(x))


def log_max_drawdown(df: DataFrame, spec: Series, x: str) -> DataFrame:
    """Largest fall of the cumulative log return below its expanding maximum."""
    out = stage(running(df, spec, {"__cum": Running("sum", F.col(x))}).select(*spec.by("blk", "pos", "n_rows", "__cum")))
    out = running(out, spec, {"__top": Running("max", F.col("__cum"))})
    return out.groupBy(*spec.keys).agg(F.min(F.col("__cum") - F.col("__top")).alias("max_drawdown"))


def tail_risk(df: DataFrame, spec: Series, x: str, level: float = 0.05) -> DataFrame:
    """Value at risk and expected shortfall in percent: exact quantile, then the mean at or below it."""
    keys = list(spec.keys)
    values = salted_values(df, keys, x)
    cut = exact_quantiles(df, keys, x, [level], values=values).select(*keys, F.element_at("quantiles", 1).alias("__q"))
    tail = spread_join(values, cut, keys).filter(F.col("__x") <= F.col("__q"))
    return tail.groupBy(*keys).agg(
        (-F.first("__q") * 100).alias("var95_net_pct"),
        (-F.avg("__x") * 100).alias("cvar95_net_pct"),
    )


def trade_stats(trades: DataFrame, spec: Series, net: str = "net_return_simple") -> DataFrame:
    """Win rate, mean win and loss, count and expectancy over trades, in percent."""
    x = F.col(net)
    wins = F.count_if(x > 0) / F.count(F.lit(1))
    mean_win, mean_loss = F.avg(F.when(x > 0, x)) * 100, F.avg(F.when(x < 0, x)) * 100
    return trades.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("num_trades"),
        (wins * 100).alias("win_rate_net_pct"),
        mean_win.alias("avg_win_net_pct"),
        mean_loss.alias("avg_loss_net_pct"),
        (wins * mean_win + (1 - wins) * mean_loss).alias("expectancy_tharp_net_pct"),
    )


def cost_stats(tf: str, cost: str = "cost_simple") -> list[Column]:
    per_day = max(1.0, 24.0 / ((parse_minutes(tf) or 60) / 60))
    turnover = F.sum("turnover")
    return [
        F.avg("turnover").alias("avg_turnover_per_bar"),
        (F.avg("turnover") * per_day).alias("avg_turnover_per_day"),
        F.sum(cost).alias("total_cost_simple"),
        turnover.alias("total_turnover"),
        (F.when(turnover > 0, F.try_divide(F.sum("strategy_simple_r"), turnover)) * 10_000).alias(
            "breakeven_fee_bps_per_side"
        ),
    ]


def return_stats(tf: str, net_log: str = "strategy_r_net", net_simple: str = "strategy_simple_r_net") -> list[Column]:
    annual = annualisation(tf)
    return [
        F.count(F.lit(1)).alias("bars"),
        profit_factor("strategy_r").alias("pf_gross"),
        profit_factor(net_log).alias("pf_net"),
        sharpe("strategy_r", annual).alias("sharpe_gross"),
        sharpe(net_log, annual).alias("sharpe_net"),
        (total_log("r") * 100).alias("pct_return_asset_log"),
        (total_log("strategy_r") * 100).alias("pct_return_log_gross"),
        (total_log(net_log) * 100).alias("pct_return_log_net"),
        (total_simple("simple_r") * 100).alias("pct_return_asset_simple"),
        (total_simple("strategy_simple_r") * 100).alias("pct_return_simple_gross"),
        (total_simple(net_simple) * 100).alias("pct_return_simple_net"),
    ]


def compare_market(df: DataFrame, spec: Series, market: str = "r", strategy: str = "strategy_r") -> DataFrame:
    """Log-space table of market against strategy: one row per series and side."""
    sides = df.select(
        *spec.by(spec.ts),
        F.explode(
            F.array(
                F.struct(F.lit("market").alias("side"), F.col(market).alias("x")),
                F.struct(F.lit("strategy").alias("side"), F.col(strategy).alias("x")),
            )
        ).alias("__s"),
    ).select(*spec.by(spec.ts), "__s.side", "__s.x")
    keyed = spec.extend("side")
    stats = sides.groupBy(*keyed.keys).agg(
        total_log("x").alias("total_return"),
        sharpe("x").alias("sharpe_ratio"),
        F.stddev_samp("x").alias("volatility"),
        profit_factor("x").alias("profit_factor"),
    )
    return stats.join(log_max_drawdown(sides, keyed, "x"), list(keyed.keys))

"""Reports: one row per run with parameters and metrics, and its series as a long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.functions.scalars import annualisation, floor_at, json_safe, sharpe_window
from barspark.operators import windows as W
from barspark.series import POS, Running, Series, running, stage, windowed


def series_table(rows: DataFrame, spec: Series, price: str, tf: str) -> DataFrame:
    """The long table behind a report: cumulative returns, equities, drawdowns, rolling Sharpe."""
    n, annual = sharpe_window(tf), annualisation(tf)
    ratios = {"__rs_gross": "strategy_r", "__rs_net": "strategy_r_net"}
    out = W.without_helpers(windowed(rows, spec, *W.sharpe_layers(ratios, n, annual)))
    out = running(
        out,
        spec,
        {
            "cum_log_asset": Running("sum", F.col("r")),
            "cum_log_gross": Running("sum", F.col("strategy_r")),
            "cum_log_net": Running("sum", F.col("strategy_r_net")),
            "equity_asset": Running("product", 1 + F.col("simple_r")),
            "rolling_sharpe_gross": Running("next", F.col("__rs_gross")),
            "rolling_sharpe_net": Running("next", F.col("__rs_net")),
        },
    ).drop("__rs_gross", "__rs_net")
    out = stage(W.drawdown(stage(out), spec, "strategy_simple_r", "equity_gross", "drawdown_gross"))
    out = W.drawdown(out, spec, "strategy_simple_r_net", "equity_net", "drawdown_net")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.withColumns(
        {
            "rolling_sharpe_gross": zero("rolling_sharpe_gross"),
            "rolling_sharpe_net": zero("rolling_sharpe_net"),
            "price": F.col(price),
        }
    )


def report_series(rows: DataFrame, spec: Series, run_type: str, price: str, tf: str) -> DataFrame:
    """The long table of a report: one row per run and bar, whatever the length of a series.

    Nulls become 0 in return series; equity starts at 1 and never falls below 0.
    """
    long = series_table(rows, spec, price, tf)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    equity = lambda c: floor_at(F.coalesce(F.col(c), F.lit(1.0)), 0.0)
    columns = {
        "timestamp": F.date_format(spec.ts, "yyyy-MM-dd'T'HH:mm:ss"),
        "asset_ret_log": zero("r"),
        "asset_ret_simple": zero("simple_r"),
        "asset_cum_log": zero("cum_log_asset"),
        "asset_cum_simple": zero("equity_asset") - 1,
        "asset_equity": equity("equity_asset"),
        "asset_price": zero("price"),
        "gross_ret_log": zero("strategy_r"),
        "gross_ret_simple": zero("strategy_simple_r"),
        "gross_cum_log": zero("cum_log_gross"),
        "gross_cum_simple": zero("equity_gross") - 1,
        "gross_equity": equity("equity_gross"),
        "gross_drawdown": zero("drawdown_gross"),
        "gross_rolling_sharpe": zero("rolling_sharpe_gross"),
        "net_ret_log": zero("strategy_r_net"),
        "net_ret_simple": zero("strategy_simple_r_net"),
        "net_cum_log": zero("cum_log_net"),
        "net_cum_simple": zero("equity_net") - 1,
        "net_equity": equity("equity_net"),
        "net_drawdown": zero("drawdown_net"),
        "net_rolling_sharpe": zero("rolling_sharpe_net"),
        "turnover": zero("turnover"),
    }
    return long.select(*spec.keys, F.lit(run_type).alias("run_type"), POS, *[c.alias(n) for n, c in columns.items()])


def report_runs(metrics: DataFrame, spec: Series, params: dict, run_type: str) -> DataFrame:
    """One row per run: its parameters and its metrics (infinite and missing numbers made safe for JSON)."""
    numbers = [f.name for f in metrics.schema.fields if f.name not in spec.keys]
    counts = {f.name for f in metrics.schema.fields if isinstance(f.dataType, T.IntegralType)}
    safe = F.struct(*[F.col(n) if n in counts else json_safe(n).alias(n) for n in numbers])
    return metrics.select(*spec.keys, F.lit(run_type).alias("run_type"), params_map(params).alias("params"), safe.alias("metrics"))


def report(
    rows: DataFrame, metrics: DataFrame, spec: Series, params: dict, run_type: str, price: str, tf: str
) -> tuple[DataFrame, DataFrame]:
    """A report as two tables: one row per run, and one row per run and bar (``pos`` in order)."""
    return report_runs(metrics, spec, params, run_type), report_series(rows, spec, run_type, price, tf)


def params_map(params: dict) -> Column:
    pairs = [F.lit(str(x)) for kv in params.items() for x in kv]
    return F.create_map(*pairs).cast("map<string,string>")

"""Evaluation, metrics, trades, grids, walk-forward, sweeps, reports."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from barspark.operators import folds as K
from barspark.operators import metrics as M
from barspark.operators import report as R
from barspark.operators import windows as W
from barspark.operators.quantiles import exact_quantiles
from barspark.operators.returns import evaluate_returns
from barspark.operators.signals import ma_long_flat
from barspark.operators.strategies import Donchian, MovingAverage, PandasStrategy
from barspark.operators.trades import trade_returns, trade_table
from barspark.plans import evaluate as E
from barspark.plans import sweep as SW
from barspark.series import _shared_folder, positions, stage, windowed
from checks import DAILY, FOUR_HOURS, bars1, bars2, check, keep, r, rounded, sql, table
from checks import sqltext as T

RUN = E.Run(tf="1d", slippage_bps=5.0)
RATE = "0.0015"


def _e1(spark, sf):
    """Returns block of the long/flat 10/30 rule on daily bars, 10 + 5 bps."""
    return evaluate_returns(ma_long_flat(bars1(spark, sf), DAILY), DAILY, **RUN.costs())


_LF = [
    "lf AS (SELECT *, NULL::DOUBLE AS r, coalesce(fast > slow, false)::DOUBLE AS signal FROM (SELECT *, CASE WHEN pos >= 9 THEN avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 9 PRECEDING) END AS fast,"
    " CASE WHEN pos >= 29 THEN avg(close) OVER (PARTITION BY symbol ORDER BY pos ROWS 29 PRECEDING) END AS slow FROM p1))",
    T.returns("e1", "lf", "symbol", RATE),
]


@check(
    "e01_returns_block",
    sql(
        *_LF,
        f"SELECT symbol, ts, {r('r', 'r')}, {r('simple_r', 'simple_r')}, weight, {r('gross_log', 'strategy_r')}, {r('gross', 'strategy_simple_r')}, turnover, {r('cost', 'cost_simple')}, {r('net', 'strategy_simple_r_net')}, {r('net_log', 'strategy_r_net')} FROM e1",
    ),
)
def e01_returns_block(spark, sf):
    return keep(
        _e1(spark, sf), "symbol", "ts", "r", "simple_r", "weight", "strategy_r", "strategy_simple_r", "turnover", "cost_simple",
        "strategy_simple_r_net", "strategy_r_net",
    )


@check("e00_crossover_summary", sql(*_LF, f"SELECT symbol, {r(T.pf_of('gross_log'), 'profit_factor')}, {r('avg(gross_log) / stddev_samp(gross_log)', 'sharpe')} FROM e1 GROUP BY symbol"))
def e00_crossover_summary(spark, sf):
    return E.crossover_summary(bars1(spark, sf), DAILY)


_LF3 = ["p3 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM b3)", *[c.replace("FROM p1", "FROM p3") for c in _LF]]


@check("e00_crossover_many_series", sql(*_LF3, f"SELECT symbol, {r(T.pf_of('gross_log'), 'profit_factor')}, {r('avg(gross_log) / stddev_samp(gross_log)', 'sharpe')} FROM e1 GROUP BY symbol"))
def e00_crossover_many_series(spark, sf):
    from checks import bars3

    return E.crossover_summary(bars3(spark, sf), DAILY)


@check("j01_aligned_arithmetic", sql(*_LF, f"SELECT symbol, ts, {r('gross_log', 'strategy_r')}, {r('gross', 'strategy_simple_r')} FROM e1"))
def j01_aligned_arithmetic(spark, sf):
    return keep(_e1(spark, sf), "symbol", "ts", "strategy_r", "strategy_simple_r")


@check("a01_profit_factor", sql(*_LF, f"SELECT symbol, {r(T.pf_of('gross_log'), 'pf_gross')}, {r(T.pf_of('net_log'), 'pf_net')} FROM e1 GROUP BY symbol"))
def a01_profit_factor(spark, sf):
    return rounded(_e1(spark, sf).groupBy("symbol").agg(M.profit_factor("strategy_r").alias("pf_gross"), M.profit_factor("strategy_r_net").alias("pf_net")))


@check("a02_sharpe", sql(*_LF, f"SELECT symbol, {r('avg(net_log) / nullif(stddev_samp(net_log), 0) * sqrt(365)', 'sharpe_net')} FROM e1 GROUP BY symbol"))
def a02_sharpe(spark, sf):
    return rounded(_e1(spark, sf).groupBy("symbol").agg(M.sharpe("strategy_r_net", 365**0.5).alias("sharpe_net")))


@check(
    "a03_total_returns",
    sql(*_LF, f"SELECT symbol, {r('sum(net_log)', 'total_log')}, {r('product(1 + gross) - 1', 'total_simple')}, {r('ln(100000 * product(1 + gross))', 'log_capital')} FROM e1 GROUP BY symbol"),
)
def a03_total_returns(spark, sf):
    out = _e1(spark, sf).groupBy("symbol").agg(
        M.total_log("strategy_r_net").alias("total_log"), M.total_simple("strategy_simple_r").alias("total_simple"),
        F.log(M.final_capital("strategy_simple_r")).alias("log_capital"),
    )
    return rounded(out)


_TAIL = "q AS (SELECT symbol, quantile_cont(net, 0.05) AS q FROM e1 GROUP BY symbol)"


@check("a04_tail_risk", sql(*_LF, _TAIL, f"SELECT symbol, {r('-any_value(q) * 100', 'var95_net_pct')}, {r('-avg(net) FILTER (net <= q) * 100', 'cvar95_net_pct')} FROM e1 JOIN q USING (symbol) GROUP BY symbol"))
def a04_tail_risk(spark, sf):
    return rounded(M.tail_risk(_e1(spark, sf), DAILY, "strategy_simple_r_net"))


_STATS = f"""SELECT symbol, count(*) AS num_trades, {r('avg((net_return_simple > 0)::INT) * 100', 'win_rate_net_pct')}, {r('avg(net_return_simple) FILTER (net_return_simple > 0) * 100', 'avg_win_net_pct')},
{r('avg(net_return_simple) FILTER (net_return_simple < 0) * 100', 'avg_loss_net_pct')}, {r('avg((net_return_simple > 0)::INT) * avg(net_return_simple) FILTER (net_return_simple > 0) * 100 + (1 - avg((net_return_simple > 0)::INT)) * avg(net_return_simple) FILTER (net_return_simple < 0) * 100', 'expectancy_tharp_net_pct')} FROM tr GROUP BY symbol"""


@check("a05_trade_stats", sql(*_LF, T.trades("tr", "e1", "symbol"), _STATS))
def a05_trade_stats(spark, sf):
    return rounded(M.trade_stats(trade_table(_e1(spark, sf), DAILY), DAILY))


@check(
    "a06_cost_stats",
    sql(
        *_LF,
        f"SELECT symbol, {r('avg(turnover)', 'avg_turnover_per_bar')}, {r('avg(turnover)', 'avg_turnover_per_day')}, {r('sum(cost)', 'total_cost_simple')}, {r('sum(turnover)', 'total_turnover')}, {r('sum(gross) / nullif(sum(turnover), 0) * 10000', 'breakeven_fee_bps_per_side', 4)} FROM e1 GROUP BY symbol",
    ),
)
def a06_cost_stats(spark, sf):
    return rounded(_e1(spark, sf).groupBy("symbol").agg(*M.cost_stats("1d")), 6, breakeven_fee_bps_per_side=4)


_UP = "OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING)"


@check("a07_drawdown_summary", sql(*_LF, f"x AS (SELECT symbol, pos, product(1 + gross) {_UP} AS eq FROM e1), d AS (SELECT symbol, eq / max(eq) {_UP} - 1 AS d FROM x)", f"SELECT symbol, {r('avg(d)', 'mean_dd')}, {r('min(d)', 'max_dd')} FROM d GROUP BY symbol"))
def a07_drawdown_summary(spark, sf):
    rows = E.cut_back(_e1(spark, sf))
    out = W.drawdown(rows, DAILY, "strategy_simple_r").groupBy("symbol")
    return rounded(out.agg(F.avg("drawdown").alias("mean_dd"), F.min("drawdown").alias("max_dd")))


@check("a07_log_drawdown", sql(*_LF, f"x AS (SELECT symbol, pos, sum(gross_log) {_UP} AS c FROM e1), d AS (SELECT symbol, c - max(c) {_UP} AS d FROM x)", f"SELECT symbol, {r('min(d)', 'max_drawdown')} FROM d GROUP BY symbol"))
def a07_log_drawdown(spark, sf):
    return rounded(M.log_max_drawdown(E.cut_back(_e1(spark, sf)), DAILY, "strategy_r"))


@check("e07_trade_table", sql(*_LF, T.trades("tr", "e1", "symbol"), f"SELECT symbol, trade_id, entry_ts, exit_ts, CASE WHEN entry_weight > 0 THEN 'long' ELSE 'short' END AS direction, entry_weight, exit_weight, {r('gross_return_simple', 'gross_return_simple')}, {r('net_return_simple', 'net_return_simple')}, bars, {r('turnover_sum', 'turnover_sum')}, {r('cost_sum', 'cost_sum')} FROM tr"))
def e07_trade_table(spark, sf):
    return rounded(trade_table(_e1(spark, sf), DAILY))


@check("e08_trade_returns", sql(*_LF, T.trades("tr", "e1", "symbol"), f"SELECT symbol, trade_id, {r('net_return_simple', 'trade_return')} FROM tr"))
def e08_trade_returns(spark, sf):
    return rounded(trade_returns(_e1(spark, sf), DAILY))


@check("x02_compound_per_group", sql(f"SELECT symbol, year(ts) AS year, {r('ln(product(1 + x))', 'log_growth')} FROM (SELECT symbol, ts, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS x FROM b1) WHERE x IS NOT NULL GROUP BY symbol, year"))
def x02_compound_per_group(spark, sf):
    out = windowed(bars1(spark, sf), DAILY, {"x": W.forward_simple_return("close")}).dropna(subset=["x"])
    return rounded(out.groupBy("symbol", F.year("ts").alias("year")).agg(F.log(M.total_simple("x") + 1).alias("log_growth")))


@check("a15_quantile_edges", f"SELECT event_type AS symbol, [round(q, 6) for q in quantile_cont(value, [0.2, 0.4, 0.6, 0.8])] AS edges FROM events GROUP BY 1")
def a15_quantile_edges(spark, sf):
    e = table(spark, sf, "events").withColumn("symbol", F.col("event_type"))
    out = exact_quantiles(e, ["symbol"], "value", [0.2, 0.4, 0.6, 0.8])
    return out.select("symbol", F.transform("quantiles", lambda q: F.round(q, 6)).alias("edges"))


# --- in-sample evaluation -----------------------------------------------------


def _fixed(spark, sf, bars, fast=10, slow=30):
    return bars.select("symbol").distinct().withColumns({"fast": F.lit(fast).cast("long"), "slow": F.lit(slow).cast("long")})


_IS = [
    T.averages("av", "p1", "symbol", 30),
    "bp AS (SELECT DISTINCT symbol, 10 AS fast, 30 AS slow FROM b1)",
    T.ma_signal("sg", "av", "symbol", "bp"),
    T.returns("e1", "sg", "symbol", RATE),
]
_LOGS = ["pct_return_asset_simple", "pct_return_simple_gross"]


@check(
    "e02_in_sample",
    sql(
        *_IS,
        _TAIL,
        T.trades("tr", "e1", "symbol"),
        "ts AS (SELECT symbol, count(*) AS num_trades, avg((net_return_simple > 0)::INT) * 100 AS win_rate_net_pct FROM tr GROUP BY symbol)",
        f"x AS (SELECT symbol, pos, product(1 + greatest(net, -0.99)) {_UP} AS eq FROM e1)",
        f"""SELECT symbol, count(*) AS bars, {r(T.pf_of('gross_log'), 'pf_gross')}, {r(T.pf_of('net_log'), 'pf_net')}, {r('avg(gross_log) / stddev_samp(gross_log) * sqrt(365)', 'sharpe_gross')},
        {r('avg(net_log) / stddev_samp(net_log) * sqrt(365)', 'sharpe_net')}, {r('sum(r) * 100', 'pct_return_asset_log')}, {r('sum(gross_log) * 100', 'pct_return_log_gross')}, {r('sum(net_log) * 100', 'pct_return_log_net')},
        {r('ln(product(1 + simple_r))', 'log_growth_asset')}, {r('avg(turnover)', 'avg_turnover_per_bar')}, {r('sum(cost)', 'total_cost_simple')}, {r('-any_value(q) * 100', 'var95_net_pct')},
        {r('-avg(net) FILTER (net <= q) * 100', 'cvar95_net_pct')}, any_value(num_trades) AS num_trades, {r('any_value(win_rate_net_pct)', 'win_rate_net_pct')} FROM e1 JOIN q USING (symbol) JOIN ts USING (symbol) GROUP BY symbol""",
    ),
)
def e02_in_sample(spark, sf):
    bars = bars1(spark, sf)
    _, metrics = E.in_sample(bars, DAILY, MovingAverage(max_window=30), RUN, params=_fixed(spark, sf, bars))
    out = metrics.withColumn("log_growth_asset", F.log(F.col("pct_return_asset_simple") / 100 + 1))
    names = [
        "bars", "pf_gross", "pf_net", "sharpe_gross", "sharpe_net", "pct_return_asset_log", "pct_return_log_gross", "pct_return_log_net",
        "log_growth_asset", "avg_turnover_per_bar", "total_cost_simple", "var95_net_pct", "cvar95_net_pct", "num_trades", "win_rate_net_pct",
    ]
    return keep(out, "symbol", *names)


@check(
    "e02_in_sample_fitted",
    sql(
        T.averages("av", "p2", "symbol", 20), T.pairs(20), T.ma_scores("sc", "av", "symbol"), T.best("bp", "sc", "symbol", "fast, slow"),
        T.ma_signal("sg", "av", "symbol", "bp"), T.returns("e1", "sg", "symbol", RATE),
        f"SELECT symbol, {r(T.pf_of('gross_log'), 'pf_gross')}, {r(T.pf_of('net_log'), 'pf_net')}, {r('sum(turnover)', 'total_turnover')} FROM e1 GROUP BY symbol",
    ),
)
def e02_in_sample_fitted(spark, sf):
    rows = E.in_sample_returns(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=20), RUN)
    return rounded(rows.groupBy("symbol").agg(M.profit_factor("strategy_r").alias("pf_gross"), M.profit_factor("strategy_r_net").alias("pf_net"), F.sum("turnover").alias("total_turnover")))


# --- grids --------------------------------------------------------------------


@check("g05_ma_grid", sql(T.averages("av", "p2", "symbol", 99), T.pairs(99), T.ma_scores("sc", "av", "symbol"), f"SELECT symbol, fast, slow, {r('gain', 'gain')}, {r('loss', 'loss')}, {r('pf', 'pf')} FROM sc"))
def g05_ma_grid(spark, sf):
    return rounded(MovingAverage().scores(positions(bars2(spark, sf), FOUR_HOURS), FOUR_HOURS))


@check(
    "g05_ma_best",
    sql(T.averages("av", "p2", "symbol", 99), T.pairs(99), T.ma_scores("sc", "av", "symbol"), T.best("bp", "sc", "symbol", "fast, slow"), f"SELECT symbol, fast, slow, {r('pf', 'metric')} FROM bp"),
)
def g05_ma_best(spark, sf):
    return rounded(MovingAverage().fit(positions(bars2(spark, sf), FOUR_HOURS), FOUR_HOURS))


_DON = [
    "lb AS (SELECT lb FROM range(2, 169) t(lb))",
    """dr AS (SELECT a.symbol, a.pos, lb, any_value(ln(a.nx) - ln(a.close)) AS r, CASE WHEN any_value(a.pos) >= lb - 1 THEN
    CASE WHEN any_value(a.close) < min(b.close) THEN -1.0 WHEN any_value(a.close) > max(b.close) THEN 1.0 END END AS raw
    FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY pos) AS nx FROM p2) a, lb, p2 b
    WHERE b.symbol = a.symbol AND b.pos BETWEEN a.pos - lb + 1 AND a.pos - 1 GROUP BY a.symbol, a.pos, lb)""",
    "ds AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol, lb ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s FROM dr)",
    f"""dg AS (SELECT *, {T.PF} AS pf FROM (SELECT symbol, lb AS lookback, coalesce(sum(s * r) FILTER (s * r > 0), 0) AS gain, coalesce(-sum(s * r) FILTER (s * r < 0), 0) AS loss FROM ds GROUP BY symbol, lb))""",
]


@check("g06_donchian_grid", sql(*_DON, f"SELECT symbol, lookback, {r('gain', 'gain')}, {r('loss', 'loss')}, {r('pf', 'pf')} FROM dg"))
def g06_donchian_grid(spark, sf):
    return rounded(Donchian().scores(positions(bars2(spark, sf), FOUR_HOURS), FOUR_HOURS))


@check("g06_donchian_best", sql(*_DON, T.best("bp", "dg", "symbol", "lookback", "true"), f"SELECT symbol, lookback, {r('pf', 'metric')} FROM bp"))
def g06_donchian_best(spark, sf):
    return rounded(Donchian().fit(positions(bars2(spark, sf), FOUR_HOURS), FOUR_HOURS))


@check("g06_donchian_fitted_signal", sql(*_DON, T.best("bp", "dg", "symbol", "lookback", "loss > 0"), "SELECT p2.symbol, p2.ts, s::DOUBLE AS signal FROM p2 JOIN bp USING (symbol) LEFT JOIN ds ON ds.symbol = p2.symbol AND ds.pos = p2.pos AND ds.lb = bp.lookback"))
def g06_donchian_fitted_signal(spark, sf):
    from barspark.operators.strategies import fit_and_signal

    rows = positions(bars2(spark, sf), FOUR_HOURS)
    return fit_and_signal(Donchian(lossless_wins=False), rows, FOUR_HOURS).select("symbol", "ts", "signal")


@check("a18_grid_argmax", sql(T.averages("av", "p1", "symbol", 12), T.pairs(12), T.ma_scores("sc", "av", "symbol"), T.best("bp", "sc", "symbol", "fast, slow"), f"SELECT symbol, fast, slow, {r('pf', 'metric')} FROM bp"))
def a18_grid_argmax(spark, sf):
    return rounded(MovingAverage(max_window=12).fit(positions(bars1(spark, sf), DAILY), DAILY))


@check("j06_bars_by_grid", sql("SELECT symbol, ts, lookback FROM b2, range(2, 12) t(lookback)"))
def j06_bars_by_grid(spark, sf):
    return bars2(spark, sf).select("symbol", "ts", F.explode(F.expr("sequence(2L, 11L)")).alias("lookback"))


# --- walk-forward -----------------------------------------------------------------

L, S, TOP = 60, 20, 12


@check("j05_fold_rows", sql(f"SELECT symbol, ts, fold FROM p1, range(0, 1000) t(fold) WHERE fold * {S} <= pos AND pos < fold * {S} + {L} AND fold < ceil((n - {L}) / {S})"))
def j05_fold_rows(spark, sf):
    return K.fold_rows(bars1(spark, sf), DAILY, L, S, "train").select("symbol", "ts", "fold")


@check("e06_fold_report", sql(f"SELECT symbol, count(*) AS bars, ceil((count(*) - {L}) / {S})::BIGINT AS folds, false AS no_fold_ran FROM b1 GROUP BY symbol"))
def e06_fold_report(spark, sf):
    return K.fold_report(bars1(spark, sf), DAILY, L, S)


_WF = [T.averages("av", "p1", "symbol", TOP), T.pairs(TOP), *T.walk("wf", "av", "symbol", L, S, TOP)]


@check("e03_walk_forward_signals", sql(*_WF, f"SELECT symbol, ts, pos, fold, fast::DOUBLE AS fast, slow::DOUBLE AS slow, {r('metric', 'metric')}, signal::DOUBLE AS signal FROM wf_sig"))
def e03_walk_forward_signals(spark, sf):
    out = K.walk_forward_signals(bars1(spark, sf), DAILY, MovingAverage(max_window=TOP), L, S)
    return keep(out, "symbol", "ts", "pos", "fold", "fast", "slow", "metric", "signal")


@check("e04_full_history_signals", sql(*_WF, "SELECT symbol, ts, signal::DOUBLE AS signal FROM wf_sig"))
def e04_full_history_signals(spark, sf):
    return K.full_history_signals(bars1(spark, sf), DAILY, MovingAverage(max_window=TOP), L, S).select("symbol", "ts", "signal")


_SLICE = [
    f"c AS (SELECT symbol, greatest(0, count(*) FILTER (ts < TIMESTAMP '1995-01-01') - {L}) AS cut FROM p1 GROUP BY symbol)",
    """sl AS (SELECT symbol, ts, open, high, low, close, volume, pos - cut AS pos, count(*) OVER (PARTITION BY symbol) AS n
    FROM p1 JOIN c USING (symbol) WHERE pos >= cut AND ts < TIMESTAMP '1997-01-01')""",
]


@check(
    "e05_walk_forward_metrics",
    sql(
        *_SLICE, T.averages("av", "sl", "symbol", TOP), T.pairs(TOP), *T.walk("wf", "av", "symbol", L, S, TOP), T.returns("e0", "wf_sig", "symbol", RATE),
        "e1 AS (SELECT * FROM e0 WHERE ts >= TIMESTAMP '1995-01-01')", _TAIL,
        f"""SELECT symbol, count(*) AS bars, {r(T.pf_of('gross_log'), 'pf_gross')}, {r(T.pf_of('net_log'), 'pf_net')}, {r('avg(net_log) / stddev_samp(net_log) * sqrt(365)', 'sharpe_net')},
        {r('sum(net_log) * 100', 'pct_return_log_net')}, {r('avg(turnover)', 'avg_turnover_per_bar')}, {r('-any_value(q) * 100', 'var95_net_pct')} FROM e1 JOIN q USING (symbol) GROUP BY symbol""",
    ),
)
def e05_walk_forward_metrics(spark, sf):
    run = E.Run(start="1995-01-01", end="1997-01-01", tf="1d", slippage_bps=5.0)
    _, metrics = E.walk_forward(bars1(spark, sf), DAILY, MovingAverage(max_window=TOP), run, L, S)
    return keep(metrics, "symbol", "bars", "pf_gross", "pf_net", "sharpe_net", "pct_return_log_net", "avg_turnover_per_bar", "var95_net_pct")


@check(
    "e03_donchian_walk_forward",
    sql(
        f"""cx AS (SELECT p.*, fold, CASE WHEN pos < fold * {S} + {L} - 1 THEN ln(nx) - ln(close) END AS r FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY pos) AS nx FROM p1) p,
        range(0, 100000) f(fold) WHERE fold * {S} <= pos AND pos < fold * {S} + {L + S} AND fold < ceil((n - {L}) / {S}))""",
        *T.donchian("d", "cx", "symbol, fold", 20, f"fold * {S}"), T.best("bp", "d_sc", "symbol, fold", "lookback", "true").replace("ORDER BY pf", "ORDER BY round(pf, 9)"),  # sums of equal terms tie
        f"""SELECT symbol, ts, CASE WHEN pos >= {L} THEN (pos - {L}) // {S} END AS fold, bp.lookback::DOUBLE AS lookback, {r('bp.pf', 'metric')}, s::DOUBLE AS signal FROM p1
        LEFT JOIN bp ON bp.symbol = p1.symbol AND pos >= {L} AND bp.fold = (pos - {L}) // {S}
        LEFT JOIN d_sg ON d_sg.symbol = bp.symbol AND d_sg.fold = bp.fold AND d_sg.lookback = bp.lookback AND d_sg.pos = p1.pos""".replace("SELECT symbol, ts", "SELECT p1.symbol, p1.ts").replace("CASE WHEN pos", "CASE WHEN p1.pos").replace("(pos -", "(p1.pos -").replace("AND pos >=", "AND p1.pos >="),
    ),
)
def e03_donchian_walk_forward(spark, sf):
    out = K.walk_forward_signals(bars1(spark, sf), DAILY, Donchian(high=20), L, S)
    return keep(out, "symbol", "ts", "fold", "lookback", "metric", "signal")


# --- sweeps -----------------------------------------------------------------------


def _fee_sweep(spark, sf):
    points = SW.grid(fee_bps=[2.0, 10.0, 25.0], slippage_bps=[0.0, 5.0])
    return SW.sweep(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=12), E.Run(tf="4h"), points)


_SW = [T.averages("av", "p2", "symbol", 12), T.pairs(12), T.ma_scores("sc", "av", "symbol"), T.best("bp", "sc", "symbol", "fast, slow"), T.ma_signal("sg", "av", "symbol", "bp")]
_FEES = [*_SW, "gr AS (SELECT sg.*, fee_bps, slippage_bps FROM sg, (VALUES (2.0), (10.0), (25.0)) f(fee_bps), (VALUES (0.0), (5.0)) s(slippage_bps))", T.returns("e1", "gr", "symbol, fee_bps, slippage_bps", "((fee_bps + slippage_bps) / 10000)")]


@check("e09_fee_sweep", sql(*_FEES, f"SELECT symbol, fee_bps::DOUBLE AS fee_bps, slippage_bps::DOUBLE AS slippage_bps, {r(T.pf_of('net_log'), 'pf_net')}, {r('sum(net_log) * 100', 'pct_return_log_net')} FROM e1 GROUP BY ALL"))
def e09_fee_sweep(spark, sf):
    return keep(_fee_sweep(spark, sf), "symbol", "fee_bps", "slippage_bps", "pf_net", "pct_return_log_net")


@check("e09_sweep_matrix", sql(*_FEES, "m AS (SELECT symbol, fee_bps, slippage_bps, " + T.pf_of("net_log") + " AS pf FROM e1 GROUP BY ALL)", f"""SELECT symbol, slippage_bps::DOUBLE AS slippage_bps, {r('max(pf) FILTER (fee_bps = 2)', 'fee_bps_2_0')}, {r('max(pf) FILTER (fee_bps = 10)', 'fee_bps_10_0')}, {r('max(pf) FILTER (fee_bps = 25)', 'fee_bps_25_0')} FROM m GROUP BY ALL"""))
def e09_sweep_matrix(spark, sf):
    return rounded(SW.sweep_matrix(_fee_sweep(spark, sf), ["symbol"], "fee_bps", "slippage_bps", "pf_net", [2.0, 10.0, 25.0]))


@check(
    "e09_parameter_sweep",
    sql(
        T.averages("av", "p2", "symbol", 12), "gr AS (SELECT av.*, f AS fast, s AS slow FROM av, (VALUES (2), (3)) x(f), (VALUES (8), (12)) y(s))",
        """sg AS (SELECT * EXCLUDE (raw), last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol, fast, slow ORDER BY pos ROWS UNBOUNDED PRECEDING) AS signal FROM (
        SELECT *, CASE WHEN a[fast] > a[slow] THEN 1.0 WHEN a[fast] < a[slow] THEN -1.0 END AS raw FROM gr))""",
        T.returns("e1", "sg", "symbol, fast, slow"),
        f"SELECT symbol, fast::BIGINT AS fast, slow::BIGINT AS slow, {r(T.pf_of('net_log'), 'pf_net')}, {r('sum(turnover)', 'total_turnover')} FROM e1 GROUP BY ALL",
    ),
)
def e09_parameter_sweep(spark, sf):
    out = SW.sweep(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=12), E.Run(tf="4h"), SW.grid(fast=[2, 3], slow=[8, 12]))
    return keep(out.withColumns({c: F.col(c).cast("long") for c in ("fast", "slow")}), "symbol", "fast", "slow", "pf_net", "total_turnover")


_WEIGHT = "coalesce(signal, 0)::DOUBLE"
_SIZED = [*_SW, T.returns("r1", "sg", "symbol", weight=f"{_WEIGHT} * 0.2"), T.returns("r2", "sg", "symbol", weight=f"{_WEIGHT} * 0.4"), T.returns("r3", "sg", "symbol", "0.0025", weight=f"{_WEIGHT} * 0.2"), T.returns("r4", "sg", "symbol", "0.0025", weight=f"{_WEIGHT} * 0.4")]
_OF = f"{r(T.pf_of('net_log'), 'pf_net')}, {r('sum(net_log) * 100', 'pct_return_log_net')}, {r('sum(turnover)', 'total_turnover')}"


@check(
    "e09_sizing_sweep",
    sql(*_SIZED, " UNION ALL ".join(f"SELECT symbol, {risk}::DOUBLE AS sizing_params_risk_per_trade_frac, {fee}::DOUBLE AS fee_bps, {_OF} FROM {src} GROUP BY symbol" for src, risk, fee in (("r1", 0.01, 10), ("r2", 0.02, 10), ("r3", 0.01, 25), ("r4", 0.02, 25)))),
)
def e09_sizing_sweep(spark, sf):
    run = E.Run(tf="4h", sizing="risk_stop", sizing_params={"stop_loss_pct": 0.05})
    points = SW.grid(sizing_params__risk_per_trade_frac=[0.01, 0.02], fee_bps=[10.0, 25.0])
    out = SW.sweep(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=12), run, points)
    return keep(out, "symbol", "sizing_params_risk_per_trade_frac", "fee_bps", "pf_net", "pct_return_log_net", "total_turnover")


def _priced(tag: str, price: str, top: int) -> list[str]:
    at = f"x{tag}"
    return [
        f"{at} AS (SELECT *, {price} AS px FROM p2)", T.averages(f"a{tag}", at, "symbol", top, "px"), f"pairs{tag} AS (SELECT f, s FROM range(1, {top + 1}) x(f), range(1, {top + 1}) y(s) WHERE s > f)",
        T.ma_scores(f"s{tag}", f"a{tag}", "symbol").replace("pairs GROUP", f"pairs{tag} GROUP"), T.best(f"b{tag}", f"s{tag}", "symbol", "fast, slow"),
        T.ma_signal(f"g{tag}", f"a{tag}", "symbol", f"b{tag}"), T.returns(f"e{tag}", f"g{tag}", "symbol", price="px"),
    ]


_PRICES = {"close": "close", "median": "(high + low) / 2", "typical": "(high + low + close) / 3"}


@check(
    "e09_price_and_strategy_sweep",
    sql(
        *[c for p, e in _PRICES.items() for top in (6, 12) for c in _priced(f"_{p}{top}", e, top)],
        " UNION ALL ".join(f"SELECT symbol, '{p}' AS price, {top} AS strategy_max_window, {_OF} FROM e_{p}{top} GROUP BY symbol" for p in _PRICES for top in (6, 12)),
    ),
)
def e09_price_and_strategy_sweep(spark, sf):
    points = SW.grid(price=list(_PRICES), strategy__max_window=[6, 12])
    out = SW.sweep(bars2(spark, sf), FOUR_HOURS, MovingAverage(), E.Run(tf="4h"), points)
    return keep(out, "symbol", "price", "strategy_max_window", "pf_net", "pct_return_log_net", "total_turnover")


@check(
    "e09_time_frame_sweep",
    sql(
        *[c for t, src in (("4h", "p2"), ("1d", "q2")) for c in [
            *([] if t == "4h" else ["q1 AS (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS ts, max_by(close, ts) AS close FROM b2 GROUP BY ALL)", "q2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM q1)"]),
            T.averages(f"a{t}", src, "symbol", 5), *([T.pairs(5)] if t == "4h" else []), T.ma_scores(f"s{t}", f"a{t}", "symbol"), T.best(f"b{t}", f"s{t}", "symbol", "fast, slow"), T.ma_signal(f"g{t}", f"a{t}", "symbol", f"b{t}"),
            T.returns(f"e{t}", f"g{t}", "symbol"),
        ]],
        " UNION ALL ".join(f"SELECT symbol, '{t}' AS tf, {_OF}, {r(f'avg(net_log) / stddev_samp(net_log) * sqrt({f})', 'sharpe_net')} FROM e{t} GROUP BY symbol" for t, f in (("4h", 365 * 6), ("1d", 365))),
    ),
)
def e09_time_frame_sweep(spark, sf):
    fine = bars2(spark, sf)
    days = fine.groupBy("symbol", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.max_by("close", "ts").alias("close"))
    sources = {"4h": (fine, FOUR_HOURS), "1d": (days, DAILY)}
    out = SW.sweep(sources, FOUR_HOURS, MovingAverage(max_window=5), E.Run(tf="4h"), SW.grid(tf=["4h", "1d"]))
    return keep(out, "symbol", "tf", "pf_net", "pct_return_log_net", "total_turnover", "sharpe_net")


@check(
    "s13_sweep_csv",
    sql(
        *_FEES,
        f"SELECT symbol, 'fee_bps' AS x_param, fee_bps::DOUBLE AS x_value, NULL::VARCHAR AS y_param, NULL::DOUBLE AS y_value, {r(T.pf_of('net_log'), 'pf_net')} FROM e1 WHERE slippage_bps = 0 GROUP BY symbol, fee_bps "
        f"UNION ALL SELECT symbol, 'fee_bps', fee_bps::DOUBLE, 'slippage_bps', slippage_bps::DOUBLE, {r(T.pf_of('net_log'), 'pf_net')} FROM e1 GROUP BY symbol, fee_bps, slippage_bps",
    ),
)
def s13_sweep_csv(spark, sf):
    table_ = stage(_fee_sweep(spark, sf))
    one = SW.sweep_rows(table_.filter("slippage_bps = 0").drop("slippage_bps"), "fee_bps", ["pf_net"])
    two = SW.sweep_rows(table_, "fee_bps", ["pf_net"], y="slippage_bps")
    path = f"{_shared_folder(spark)}/sweep-{uuid4().hex}"
    one.unionByName(two, allowMissingColumns=True).write.option("header", True).csv(path)
    back = spark.read.option("header", True).schema("symbol string, x_param string, x_value double, pf_net double, y_param string, y_value double").csv(path)
    return rounded(back)


# --- reports and files ---------------------------------------------------------------


@check("s12_trades_csv", sql(*_LF, T.trades("tr", "e1", "symbol"), f"SELECT symbol, trade_id, entry_ts, exit_ts, {r('net_return_simple', 'net_return_simple')}, bars FROM tr"))
def s12_trades_csv(spark, sf):
    trades = trade_table(_e1(spark, sf), DAILY)
    path = f"{_shared_folder(spark)}/trades-{uuid4().hex}"
    trades.write.option("header", True).csv(path)
    back = spark.read.option("header", True).schema(trades.schema).csv(path)
    return keep(back, "symbol", "trade_id", "entry_ts", "exit_ts", "net_return_simple", "bars")


def _report(spark, sf):
    bars = bars2(spark, sf)
    run = E.Run(tf="4h", slippage_bps=5.0)
    rows, metrics = E.in_sample(bars, FOUR_HOURS, MovingAverage(max_window=30), run, params=_fixed(spark, sf, bars, 5, 20))
    return R.report(rows, metrics, FOUR_HOURS, {"strategy": "ma", "timeframe": "4h"}, "in_sample", "close", "4h")


_REP = [T.averages("av", "p2", "symbol", 20), "bp AS (SELECT DISTINCT symbol, 5 AS fast, 20 AS slow FROM b2)", T.ma_signal("sg", "av", "symbol", "bp"), T.returns("e1", "sg", "symbol", RATE)]


@check(
    "r01_report",
    sql(
        *_REP, f"c AS (SELECT *, sum(r) {_UP} AS cr FROM e1)", f"m AS (SELECT symbol, {r(T.pf_of('net_log'), 'pf_net')} FROM e1 GROUP BY symbol)",
        f"""SELECT symbol, 'in_sample' AS run_type, 'ma' AS strategy, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, {r('coalesce(r, 0)', 'ret_log')},
        {r('cr', 'cum_log')}, {r('turnover', 'turnover')}, pf_net FROM c JOIN m USING (symbol)""",
    ),
)
def r01_report(spark, sf):
    runs, series = _report(spark, sf)
    head = runs.select("symbol", F.col("params")["strategy"].alias("strategy"), F.col("metrics.pf_net").alias("pf_net"))
    return rounded(series.join(head, "symbol").select(
        "symbol", "run_type", "strategy", "timestamp", F.col("asset_ret_log").alias("ret_log"), F.col("asset_cum_log").alias("cum_log"), "turnover", "pf_net",
    ))


def _stored_report(spark, sf):
    """Both tables written as JSON and read again."""
    base, back = f"{_shared_folder(spark)}/report-{uuid4().hex}", []
    for name, df in zip(("runs", "series"), _report(spark, sf), strict=True):
        df.write.json(f"{base}/{name}")
        back.append(spark.read.schema(df.schema).json(f"{base}/{name}"))
    return back


@check("s14_report_json", sql(*_REP, f"SELECT symbol, 'in_sample' AS run_type, {r(T.pf_of('net_log'), 'pf_net')}, count(*) AS bars FROM e1 GROUP BY symbol"))
def s14_report_json(spark, sf):
    runs, series = _stored_report(spark, sf)
    bars = series.groupBy("symbol").agg(F.count("*").alias("bars"))
    return rounded(runs.select("symbol", "run_type", "metrics.pf_net").join(bars, "symbol"))


@check("s15_report_metrics", sql(*_REP, f"SELECT symbol, count(*) AS bars, {r(T.pf_of('gross_log'), 'pf_gross')}, {r(T.pf_of('net_log'), 'pf_net')}, {r('avg(net_log) / stddev_samp(net_log) * sqrt(2190)', 'sharpe_net')} FROM e1 GROUP BY symbol"))
def s15_report_metrics(spark, sf):
    back = _stored_report(spark, sf)[0].select("symbol", "metrics.*")
    return keep(back, "symbol", "bars", "pf_gross", "pf_net", "sharpe_net")


@check("u04_compare_runs", sql(*_LF, f"SELECT symbol, unnest(['a', 'b']) AS run, {r(T.pf_of('gross_log'), 'pf')} FROM e1 GROUP BY symbol"))
def u04_compare_runs(spark, sf):
    one = _e1(spark, sf).groupBy("symbol").agg(M.profit_factor("strategy_r").alias("pf"))
    return rounded(one.withColumn("run", F.lit("a")).unionByName(one.withColumn("run", F.lit("b"))))


# --- plug-ins -------------------------------------------------------------------------


def _level_strategy():
    """A user's pandas strategy: long above the training mean, short below it."""
    import numpy as np

    return PandasStrategy(lambda train: ({"level": train["close"].mean()}, 1.0), lambda ctx, p: np.sign(ctx["close"] - p["level"]), ("level",))


@check(
    "g08_x01_x03_plugin_strategy",
    sql(
        f"""lv AS (SELECT symbol, fold, avg(close) AS level FROM p1, range(0, 1000) t(fold) WHERE fold * {S} <= pos AND pos < fold * {S} + {L} AND fold < ceil((n - {L}) / {S}) GROUP BY symbol, fold)""",
        f"""SELECT p1.symbol, ts, CASE WHEN pos >= {L} THEN (pos - {L}) // {S} END AS fold, {r('ln(level)', 'log_level')}, sign(close - level)::DOUBLE AS signal
        FROM p1 LEFT JOIN lv ON lv.symbol = p1.symbol AND pos >= {L} AND lv.fold = (pos - {L}) // {S}""",
    ),
)
def g08_x01_x03_plugin_strategy(spark, sf):
    out = K.walk_forward_signals(bars1(spark, sf), DAILY, _level_strategy(), L, S)
    return keep(out.withColumn("log_level", F.log("level")), "symbol", "ts", "fold", "log_level", "signal")


@check("k03_top_parameter", sql(*_DON, T.best("bp", "dg", "symbol", "lookback", "loss > 0"), f"SELECT symbol, lookback, {r('pf', 'metric')} FROM bp"))
def k03_top_parameter(spark, sf):
    return rounded(Donchian(lossless_wins=False).fit(positions(bars2(spark, sf), FOUR_HOURS), FOUR_HOURS))


@check(
    "u03_rows_with_different_keys",
    sql(
        T.averages("av", "p2", "symbol", 12), T.pairs(12), T.ma_scores("sc", "av", "symbol"), *_DON,
        f"SELECT symbol, fast, slow, NULL::BIGINT AS lookback, {r('pf', 'pf')} FROM sc UNION ALL SELECT symbol, NULL, NULL, lookback, {r('pf', 'pf')} FROM dg",
    ),
)
def u03_rows_with_different_keys(spark, sf):
    rows = stage(positions(bars2(spark, sf), FOUR_HOURS))
    ma, channel = MovingAverage(max_window=12).scores(rows, FOUR_HOURS), Donchian().scores(rows, FOUR_HOURS)
    return keep(ma.unionByName(channel, allowMissingColumns=True), "symbol", "fast", "slow", "lookback", "pf")

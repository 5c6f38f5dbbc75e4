"""Permutations and significance."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from barspark.operators import permute as P
from barspark.operators import report as R
from barspark.operators import significance as Q
from barspark.operators.strategies import Donchian, MovingAverage
from barspark.plans import evaluate as E
from barspark.plans import montecarlo as MC
from barspark.series import _shared_folder, positions, running
from barspark.series import Running as Scan
from checks import DAILY, FOUR_HOURS, bars1, bars2, check, keep, r, rounded, sql
from checks import sqltext as T

KEYED = FOUR_HOURS.extend("seed")


def _p2(spark, sf):
    return positions(bars2(spark, sf), FOUR_HOURS)


@check("m01_decompose", sql(T.decomposed("d", "p2", "symbol"), f"SELECT symbol, ts, {r('gap', 'gap')}, {r('rel_high', 'rel_high')}, {r('rel_low', 'rel_low')}, {r('rel_close', 'rel_close')} FROM d"))
def m01_decompose(spark, sf):
    return keep(P.decompose(_p2(spark, sf), FOUR_HOURS), "symbol", "ts", "gap", "rel_high", "rel_low", "rel_close")


@check(
    "m02_slots",
    sql(
        "s AS (SELECT symbol, pos, seed FROM p2, range(0, 3) t(seed) WHERE pos > 10)",
        "SELECT symbol, seed, pos, row_number() OVER (PARTITION BY symbol, seed ORDER BY md5(seed || ':bar:' || pos)) - 1 AS slot FROM s",
    ),
)
def m02_slots(spark, sf):
    rows = _p2(spark, sf).filter("pos > 10").withColumn("movable", F.col("n_rows") - 11)
    return P.shuffled_slots(P.with_seeds(rows, 3), FOUR_HOURS, "bar").select("symbol", "seed", "pos", "slot")


_LOG = ", ".join(r(f"ln({c})", f"log_{c}") for c in ("open", "high", "low", "close"))


def _logs(df, *keys):
    return rounded(df.select(*keys, *[F.log(c).alias(f"log_{c}") for c in ("open", "high", "low", "close")], "volume"))


@check("m03_rebuild", sql(*T.permuted("pm", "p2", "symbol", 5, 5, "20"), f"SELECT symbol, ts, {_LOG}, volume FROM pm"))
def m03_rebuild(spark, sf):
    return _logs(P.permuted_bars(_p2(spark, sf), FOUR_HOURS, [5], 20), "symbol", "ts")


@check("m04_many", sql(*T.permuted("pm", "p1", "symbol", 0, 3), f"SELECT symbol, seed, ts, {_LOG}, volume FROM pm"))
def m04_many(spark, sf):
    return _logs(P.permuted_bars(positions(bars1(spark, sf), DAILY), DAILY, 4), "symbol", "seed", "ts")


@check("j07_bars_by_seed", sql("SELECT symbol, ts, seed FROM b2, range(0, 8) t(seed)"))
def j07_bars_by_seed(spark, sf):
    return P.with_seeds(bars2(spark, sf).select("symbol", "ts"), 8)


@check("m05_start", sql("SELECT symbol, greatest(0, count(*) FILTER (ts < TIMESTAMP '1995-06-01') - 60) AS perm_start FROM b1 GROUP BY symbol"))
def m05_start(spark, sf):
    return P.permutation_start(bars1(spark, sf), DAILY, "1995-06-01", 60)


@check("m04_permuted_returns", sql(*T.permuted("pm", "p2", "symbol", 1, 2), f"SELECT symbol, seed, ts, pos, {r('ln(lead(close) OVER (PARTITION BY symbol, seed ORDER BY pos)) - ln(close)', 'r')} FROM pm"))
def m04_permuted_returns(spark, sf):
    return rounded(P.permuted_returns(_p2(spark, sf), FOUR_HOURS, [1, 2]))


# --- tests ---

N, TOP, RATE = 8, 12, "0.0015"
RUN = E.Run(tf="4h", slippage_bps=5.0)


def _pf(prefix: str, src: str, k: str, name: str, x: str = "net_log") -> list[str]:
    return [
        T.averages(f"{prefix}_av", src, k, TOP),
        T.ma_scores(f"{prefix}_sc", f"{prefix}_av", k),
        T.best(f"{prefix}_bp", f"{prefix}_sc", k, "fast, slow"),
        T.ma_signal(f"{prefix}_sg", f"{prefix}_av", k, f"{prefix}_bp"),
        T.returns(f"{prefix}_e1", f"{prefix}_sg", k, RATE),
        f"{prefix} AS (SELECT {k}, {T.pf_of(x)} AS {name} FROM {prefix}_e1 GROUP BY {k})",
    ]


_IS = [T.pairs(TOP), *T.permuted("pm", "p2", "symbol", 1, N - 1), *_pf("rl", "p2", "symbol", "real_pf"), *_pf("sh", "pm", "symbol, seed", "pf")]
_PV = f"SELECT symbol, {r('real_pf', 'real_pf')}, draws, better, {r('p_value', 'p_value')}, p_value <= 0.05 AS significant FROM pv"


@check("m06_in_sample_factors", sql(*_IS, f"SELECT symbol, seed, {r('pf', 'pf')} FROM sh"))
def m06_in_sample_factors(spark, sf):
    return rounded(MC.in_sample_test(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=TOP), RUN, N)[0])


@check("m06_in_sample_test", sql(*_IS, T.p_value("pv", "sh", "rl", "symbol"), _PV))
def m06_in_sample_test(spark, sf):
    return rounded(MC.in_sample_test(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=TOP), RUN, N)[1])


WL, WS, WN = 60, 20, 5


def _wf(prefix: str, src: str, k: str, name: str) -> list[str]:
    return [
        T.averages(f"{prefix}_av", src, k, TOP),
        *T.walk(f"{prefix}_w", f"{prefix}_av", k, WL, WS, TOP),
        T.returns(f"{prefix}_e1", f"{prefix}_w_sig", k, RATE),
        f"{prefix} AS (SELECT {k}, {T.pf_of('net_log')} AS {name} FROM {prefix}_e1 GROUP BY {k})",
    ]


_OOS = [T.pairs(TOP), *T.permuted("pm", "p2", "symbol", 0, WN - 1, str(WL)), *_wf("rl", "p2", "symbol", "real_pf"), *_wf("sh", "pm", "symbol, seed", "pf")]


@check("m07_walk_forward_factors", sql(*_OOS, f"SELECT symbol, seed, {r('pf', 'pf')} FROM sh"))
def m07_walk_forward_factors(spark, sf):
    return rounded(MC.walk_forward_test(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=TOP), RUN, WL, WS, WN)[0])


@check("m07_walk_forward_test", sql(*_OOS, T.p_value("pv", "sh", "rl", "symbol"), _PV))
def m07_walk_forward_test(spark, sf):
    return rounded(MC.walk_forward_test(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=TOP), RUN, WL, WS, WN)[1])


def _opt(prefix: str, src: str, k: str, name: str) -> list[str]:
    return [
        T.averages(f"{prefix}_av", src, k, TOP),
        T.ma_scores(f"{prefix}_sc", f"{prefix}_av", k),
        T.best(f"{prefix}_bp", f"{prefix}_sc", k, "fast, slow"),
        f"{prefix} AS (SELECT {k}, pf AS {name} FROM {prefix}_bp)",
    ]


_LEG = [T.pairs(TOP), *T.permuted("pm", "p2", "symbol", 1, N - 1), *_opt("rl", "p2", "symbol", "real_pf"), *_opt("sh", "pm", "symbol, seed", "pf")]


@check("m08_optimiser_test", sql(*_LEG, T.p_value("pv", "sh", "rl", "symbol"), _PV))
def m08_optimiser_test(spark, sf):
    return rounded(MC.in_sample_test(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=TOP), RUN, N, metric="opt_pf", slice_first=True)[1])


@check(
    "m09_permutation_curves",
    sql(
        T.pairs(TOP), *T.permuted("pm", "p2", "symbol", 0, 2, str(WL)), T.averages("av", "pm", "symbol, seed", TOP), *T.walk("w", "av", "symbol, seed", WL, WS, TOP),
        T.returns("e1", "w_sig", "symbol, seed", RATE), f"SELECT symbol, seed, ts, {r('sum(gross_log) OVER (PARTITION BY symbol, seed ORDER BY pos ROWS UNBOUNDED PRECEDING)', 'cum')} FROM e1",
    ),
)
def m09_permutation_curves(spark, sf):
    return rounded(MC.permutation_curves(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=TOP), RUN, WL, WS, 3))


@check(
    "m09_curves_wide",
    sql(
        T.pairs(TOP), *T.permuted("pm", "p2", "symbol", 0, 2, str(WL)), T.averages("av", "pm", "symbol, seed", TOP), *T.walk("w", "av", "symbol, seed", WL, WS, TOP),
        T.returns("e1", "w_sig", "symbol, seed", RATE), "c AS (SELECT symbol, seed, ts, sum(gross_log) OVER (PARTITION BY symbol, seed ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum FROM e1)",
        "SELECT symbol, ts, " + ", ".join(r(f"max(cum) FILTER (seed = {i})", f"perm_{i}") for i in range(3)) + " FROM c GROUP BY symbol, ts",
    ),
)
def m09_curves_wide(spark, sf):
    curves = MC.permutation_curves(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=TOP), RUN, WL, WS, 3)
    return rounded(MC.curves_wide(curves, FOUR_HOURS, 3))


# --- distributions of the factors of an in-sample test ---

_TEST, _AS_PF = _IS, "pf AS (SELECT symbol, seed, pf FROM sh)"


def _factors(spark, sf):
    pfs, result = MC.in_sample_test(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=TOP), RUN, N)
    return pfs, result.select("symbol", "real_pf")


@check("a10_p_value", sql(*_TEST, _AS_PF, T.p_value("pv", "pf", "rl", "symbol"), f"SELECT symbol, {r('real_pf', 'real_pf')}, draws, better, {r('p_value', 'p_value')} FROM pv"))
def a10_p_value(spark, sf):
    pfs, real = _factors(spark, sf)
    return rounded(Q.p_value(pfs, real, FOUR_HOURS).drop("significant"))


@check("a11_significance", sql(*_TEST, _AS_PF, T.p_value("pv", "pf", "rl", "symbol"), "SELECT symbol, p_value <= 0.5 AS significant FROM pv"))
def a11_significance(spark, sf):
    pfs, real = _factors(spark, sf)
    return Q.p_value(pfs, real, FOUR_HOURS, level=0.5).select("symbol", "significant")


@check(
    "a12_histogram",
    sql(
        *_TEST, _AS_PF, "e AS (SELECT symbol, min(pf) AS lo, max(pf) AS hi, greatest(10, count(*) // 3) AS k FROM pf GROUP BY symbol)",
        "SELECT symbol, least(floor((pf - lo) / (hi - lo) * k), k - 1)::INT AS bin, count(*) AS n FROM pf JOIN e USING (symbol) GROUP BY ALL",
    ),
)
def a12_histogram(spark, sf):
    pfs, _ = _factors(spark, sf)
    return Q.histogram(pfs, ["symbol"], "pf", Q.pf_bins(F.col("__n")))


@check("a12_return_histogram", sql("x AS (SELECT ln(lead(close) OVER (PARTITION BY symbol ORDER BY pos)) - ln(close) AS x FROM p1), e AS (SELECT min(x) AS lo, max(x) AS hi FROM x)", "SELECT least(floor((x - lo) / (hi - lo) * 50), 49)::INT AS bin, count(*) AS n FROM x, e WHERE x IS NOT NULL GROUP BY ALL"))
def a12_return_histogram(spark, sf):
    from barspark.operators.windows import forward_log_return
    from barspark.series import windowed

    rows = windowed(bars1(spark, sf), DAILY, {"x": forward_log_return("close")}).select("x").dropna()
    return Q.histogram(rows, [], "x", 50)


@check("a13_empirical_cdf", sql(*_TEST, _AS_PF, "u AS (SELECT symbol, pf, false AS is_real FROM pf UNION ALL SELECT symbol, real_pf, true FROM rl)", f"SELECT symbol, {r('pf', 'pf')}, is_real, {r('(row_number() OVER (PARTITION BY symbol ORDER BY pf, is_real DESC) - 1) / count(*) OVER (PARTITION BY symbol)', 'cumulative')} FROM u"))
def a13_empirical_cdf(spark, sf):
    return rounded(Q.empirical_cdf(*_factors(spark, sf), FOUR_HOURS))




def _don(prefix: str, src: str, k: str, name: str) -> list[str]:
    """The best factor of all lookbacks up to 20."""
    return [
        f"{prefix}_in AS (SELECT *, ln(lead(close) OVER (PARTITION BY {k} ORDER BY pos)) - ln(close) AS r FROM {src})", *T.donchian(prefix, f"{prefix}_in", k, 20),
        T.best(f"{prefix}_bp", f"{prefix}_sc", k, "lookback", "true"), f"{prefix} AS (SELECT {k}, pf AS {name} FROM {prefix}_bp)",
    ]


def _compared(shuffles: int) -> str:
    row = lambda name, pv: f"SELECT symbol, '{name}' AS strategy, {r('real_pf', 'real_pf')}, draws, better, {r('p_value', 'p_value')}, p_value <= 0.05 AS significant FROM {pv}"
    return sql(
        T.pairs(TOP), *T.permuted("pm", "p2", "symbol", 1, shuffles), *_opt("rl", "p2", "symbol", "real_pf"), *_opt("sh", "pm", "symbol, seed", "pf"), T.p_value("pv", "sh", "rl", "symbol"),
        *_don("rd", "p2", "symbol", "real_pf"), *_don("sd", "pm", "symbol, seed", "pf"), T.p_value("pd", "sd", "rd", "symbol"), f"{row('ma', 'pv')} UNION ALL {row('donchian', 'pd')}",
    )


@check("a22_compare_strategies", _compared(4))
def a22_compare_strategies(spark, sf):
    strategies = {"ma": MovingAverage(max_window=TOP), "donchian": Donchian(high=20)}
    return rounded(MC.compare_strategies(bars2(spark, sf), FOUR_HOURS, strategies, RUN, 5))


@check("a22_compare_ma_ranges", sql(
    T.pairs(TOP), *T.permuted("pm", "p2", "symbol", 1, 4), *_opt("rl", "p2", "symbol", "real_pf"), *_opt("sh", "pm", "symbol, seed", "pf"), T.p_value("pv", "sh", "rl", "symbol"),
    "pairs6 AS (SELECT * FROM pairs WHERE s <= 6)", *[c.replace("pairs GROUP", "pairs6 GROUP") for c in [*_opt("rs", "p2", "symbol", "real_pf"), *_opt("ss", "pm", "symbol, seed", "pf")]], T.p_value("pw", "ss", "rs", "symbol"),
    f"SELECT symbol, 'wide' AS strategy, {r('real_pf', 'real_pf')}, draws, better, {r('p_value', 'p_value')}, p_value <= 0.05 AS significant FROM pv UNION ALL "
    f"SELECT symbol, 'narrow', {r('real_pf', 'real_pf')}, draws, better, {r('p_value', 'p_value')}, p_value <= 0.05 FROM pw",
))
def a22_compare_ma_ranges(spark, sf):
    strategies = {"wide": MovingAverage(max_window=TOP), "narrow": MovingAverage(max_window=6)}
    return rounded(MC.compare_strategies(bars2(spark, sf), FOUR_HOURS, strategies, RUN, 5))


@check("a21_market_table", sql(
    T.averages("av", "p2", "symbol", TOP), T.pairs(TOP), T.ma_scores("sc", "av", "symbol"), T.best("bp", "sc", "symbol", "fast, slow"), T.ma_signal("sg", "av", "symbol", "bp"), T.returns("e1", "sg", "symbol", RATE),
    "x AS (SELECT symbol, pos, unnest(['market', 'strategy']) AS side, unnest([r, gross_log]) AS x FROM e1), c AS (SELECT *, sum(x) OVER (PARTITION BY symbol, side ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM x), d AS (SELECT *, c - max(c) OVER (PARTITION BY symbol, side ORDER BY pos ROWS UNBOUNDED PRECEDING) AS fall FROM c)",
    f"SELECT symbol, side, 'ma' AS strategy, {r('sum(x)', 'total_return')}, {r('avg(x) / stddev_samp(x)', 'sharpe_ratio')}, {r('stddev_samp(x)', 'volatility')}, {r(T.pf_of('x'), 'profit_factor')}, {r('min(fall)', 'max_drawdown')} FROM d GROUP BY symbol, side",
))
def a21_market_table(spark, sf):
    return rounded(MC.full_analysis(bars2(spark, sf), FOUR_HOURS, {"ma": MovingAverage(max_window=TOP)}, RUN, 3)[0])


@check("e11_full_analysis", _compared(3))
def e11_full_analysis(spark, sf):
    return rounded(MC.full_analysis(bars2(spark, sf), FOUR_HOURS, {"ma": MovingAverage(max_window=TOP), "donchian": Donchian(high=20)}, RUN, 4)[1])


_MC_RUN = "symbol, '{0}' AS run_type, 'ma' AS strategy"


def _told(report):
    """A test's two report tables, written as JSON lines and read back, as one row per shuffle."""
    runs, shuffles = report
    root = f"{_shared_folder(runs.sparkSession)}/report-{uuid4().hex}"
    for table_, name in ((runs, "runs"), (shuffles, "shuffles")):
        table_.write.json(f"{root}/{name}")
    spark = runs.sparkSession
    back = spark.read.schema(runs.schema).json(f"{root}/runs").select("symbol", "run_type", F.col("params.strategy").alias("strategy"), "metrics.*")
    return rounded(back.join(spark.read.schema(shuffles.schema).json(f"{root}/shuffles"), ["symbol", "run_type"]))


@check(
    "s14_in_sample_test_report",
    sql(*_IS, T.p_value("pv", "sh", "rl", "symbol"), f"gr AS (SELECT symbol, {T.pf_of('gross_log')} AS g FROM rl_e1 GROUP BY symbol)", f"SELECT {_MC_RUN.format('in_sample_permutation')}, {r('g', 'pf_gross')}, {r('pv.real_pf', 'pf_net')}, {r('p_value', 'p_value_net')}, seed, {r('pf', 'permutation_pf_net')} FROM pv JOIN gr USING (symbol) JOIN sh USING (symbol)"),
)
def s14_in_sample_test_report(spark, sf):
    bars, strategy = bars2(spark, sf), MovingAverage(max_window=TOP)
    pfs, result = MC.in_sample_test(bars, FOUR_HOURS, strategy, RUN, N)
    rows = E.in_sample_returns(bars, FOUR_HOURS, strategy, RUN)
    return _told(MC.test_report(pfs, result, rows, FOUR_HOURS, {"strategy": "ma"}, "in_sample_permutation"))


@check(
    "s14_walk_forward_test_report",
    sql(*_OOS, T.p_value("pv", "sh", "rl", "symbol"), f"gr AS (SELECT symbol, {T.pf_of('gross_log')} AS g FROM rl_e1 GROUP BY symbol)", f"SELECT {_MC_RUN.format('oos_walkforward_permutation')}, {r('g', 'pf_gross')}, {r('pv.real_pf', 'pf_net')}, {r('p_value', 'p_value_net')}, seed, {r('pf', 'permutation_pf_net')} FROM pv JOIN gr USING (symbol) JOIN sh USING (symbol)"),
)
def s14_walk_forward_test_report(spark, sf):
    bars, strategy = bars2(spark, sf), MovingAverage(max_window=TOP)
    pfs, result = MC.walk_forward_test(bars, FOUR_HOURS, strategy, RUN, WL, WS, WN)
    rows = E.walk_forward_returns(bars, FOUR_HOURS, strategy, RUN, WL, WS)
    return _told(MC.test_report(pfs, result, rows, FOUR_HOURS, {"strategy": "ma"}, "oos_walkforward_permutation"))


@check(
    "s14_walk_forward_report",
    sql(*_OOS, f"m AS (SELECT symbol, {T.pf_of('gross_log')} AS g, {T.pf_of('net_log')} AS t FROM rl_e1 GROUP BY symbol)", f"SELECT symbol, 'oos_walkforward' AS run_type, {r('g', 'pf_gross')}, {r('t', 'pf_net')}, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, {r('sum(net_log) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING)', 'net_cum_log')} FROM rl_e1 JOIN m USING (symbol)"),
)
def s14_walk_forward_report(spark, sf):
    rows, metrics = E.walk_forward(bars2(spark, sf), FOUR_HOURS, MovingAverage(max_window=TOP), RUN, WL, WS)
    runs, series = R.report(rows, metrics, FOUR_HOURS, {"strategy": "ma"}, "oos_walkforward", "close", "4h")
    both = series.select("symbol", "run_type", "timestamp", "net_cum_log").join(runs.select("symbol", "metrics.pf_gross", "metrics.pf_net"), "symbol")
    return rounded(both)


@check("w07_seeded_scan", sql(*T.permuted("pm", "p2", "symbol", 0, 1), f"SELECT symbol, seed, pos, {r('sum(volume) OVER (PARTITION BY symbol, seed ORDER BY pos ROWS UNBOUNDED PRECEDING)', 'total')} FROM pm"))
def w07_seeded_scan(spark, sf):
    bars = P.permuted_bars(_p2(spark, sf), FOUR_HOURS, 2)
    return rounded(running(bars, KEYED, {"total": Scan("sum", F.col("volume"))}).select("symbol", "seed", "pos", "total"))

"""Window functions, signals, sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import scalars as S
from barspark.operators import features as X
from barspark.operators import signals as G
from barspark.operators import sizing as Z
from barspark.operators import windows as W
from barspark.operators.prices import vwap
from barspark.series import positions, running, windowed
from checks import DAILY, FOUR_HOURS, ONWARD, UPTO, bars1, bars2, check, frame, keep, r, rounded, sql
from checks import W as OVER


def _relative(df, name):
    return df.withColumn(name, F.col(name) / F.col("close"))


def _full(expression: str, n: int, back: int | None = None, end: int = 0, what: str = "close") -> str:
    """SQL value over a frame, null until the frame is full."""
    over = frame(n - 1 if back is None else back, end)
    return f"CASE WHEN count({what}) OVER {over} >= {n} THEN {expression} OVER {over} END"


@check("w01_rolling_vwap", sql(f"SELECT symbol, ts, {r(f'sum((high+low+close)/3*volume) OVER {frame(9)} / sum(volume) OVER {frame(9)} / close', 'vwap_ratio')} FROM b1"))
def w01_rolling_vwap(spark, sf):
    out = vwap(bars1(spark, sf), DAILY, 10, "vwap_10")
    return rounded(out.select("symbol", "ts", (F.col("vwap_10") / F.col("close")).alias("vwap_ratio")))


@check("w02_forward_log_return", sql(f"SELECT symbol, ts, {r(f'ln(lead(close) OVER {OVER}) - ln(close)', 'r')} FROM b1"))
def w02_forward_log_return(spark, sf):
    return keep(windowed(bars1(spark, sf), DAILY, {"r": W.forward_log_return("close")}), "symbol", "ts", "r")


@check("w03_forward_simple_return", sql(f"SELECT symbol, ts, {r(f'lead(close) OVER {OVER} / close - 1', 'simple_r')} FROM b1"))
def w03_forward_simple_return(spark, sf):
    return keep(windowed(bars1(spark, sf), DAILY, {"simple_r": W.forward_simple_return("close")}), "symbol", "ts", "simple_r")


@check("w04_changes", sql(f"SELECT symbol, ts, {r(f'close - lag(close) OVER {OVER}', 'diff1', 3)}, {r(f'close / lag(close, 7) OVER {OVER} - 1', 'pct7')} FROM b1"))
def w04_changes(spark, sf):
    out = windowed(bars1(spark, sf), DAILY, {"diff1": W.diff("close"), "pct7": W.pct_change("close", 7)})
    return keep(out, "symbol", "ts", "diff1", "pct7", diff1=3)


_GAPPY = "CASE WHEN pos % 5 = 0 THEN close END"


@check("w05_fills", sql(f"x AS (SELECT symbol, ts, {_GAPPY} AS x FROM p1)", f"SELECT symbol, ts, last_value(x IGNORE NULLS) OVER {UPTO} AS filled, first_value(x IGNORE NULLS) OVER {ONWARD} AS back FROM x"))
def w05_fills(spark, sf):
    rows = positions(bars1(spark, sf), DAILY)
    x = F.when(F.col("pos") % 5 == 0, F.col("close"))
    return running(rows, DAILY, {"filled": W.fill_forward(x), "back": W.fill_backward(x)}).select("symbol", "ts", "filled", "back")


@check("w06_sma", sql(f"SELECT symbol, ts, {', '.join(r(_full('avg(close)', n) + ' / close', f'sma_{n}_ratio') for n in (5, 10, 20, 30, 99))} FROM b1"))
def w06_sma(spark, sf):
    windows = (5, 10, 20, 30, 99)
    out = windowed(bars1(spark, sf), DAILY, {f"sma_{n}": W.sma("close", n) for n in windows})
    return rounded(out.select("symbol", "ts", *[(F.col(f"sma_{n}") / F.col("close")).alias(f"sma_{n}_ratio") for n in windows]))


@check("w07_cumulative", sql(f"x AS (SELECT symbol, ts, volume, coalesce(close / lag(close) OVER {OVER} - 1, 0) / 20 AS x FROM b1)", f"SELECT symbol, ts, sum(volume) OVER {UPTO} AS total, {r(f'ln(product(1 + x) OVER {UPTO})', 'log_equity')} FROM x"))
def w07_cumulative(spark, sf):
    out = windowed(bars1(spark, sf), DAILY, {"x": W.pct_change("close")}).withColumn("x", F.coalesce("x", F.lit(0.0)) / 20)
    out = running(out, DAILY, {"total": W.cumulative_sum("volume"), "equity": W.cumulative_product(1 + F.col("x"))})
    return keep(out.withColumn("log_equity", F.log("equity")), "symbol", "ts", "total", "log_equity")


@check("w08_drawdown", sql(f"x AS (SELECT symbol, ts, coalesce(close / lag(close) OVER {OVER} - 1, 0) / 20 AS x FROM b1), e AS (SELECT *, product(1 + x) OVER {UPTO} AS equity FROM x)", f"SELECT symbol, ts, {r(f'equity / max(equity) OVER {UPTO} - 1', 'drawdown')} FROM e"))
def w08_drawdown(spark, sf):
    out = windowed(bars1(spark, sf), DAILY, {"x": W.pct_change("close")}).withColumn("x", F.coalesce("x", F.lit(0.0)) / 20)
    return keep(W.drawdown(out, DAILY, "x"), "symbol", "ts", "drawdown")


_RS = f"""x AS (SELECT symbol, ts, ln(close) - ln(lag(close) OVER {OVER}) AS x FROM b2)"""


@check(
    "w09_rolling_sharpe",
    sql(
        _RS,
        f"s AS (SELECT symbol, ts, CASE WHEN count(x) OVER {frame(179)} >= 180 THEN avg(x) OVER {frame(179)} / stddev_samp(x) OVER {frame(179)} * sqrt(2190) END AS s FROM x)",
        f"SELECT symbol, ts, {r(f'coalesce(first_value(s IGNORE NULLS) OVER {ONWARD}, 0)', 'rolling_sharpe')} FROM s",
    ),
)
def w09_rolling_sharpe(spark, sf):
    n, annual = S.sharpe_window("4h"), S.annualisation("4h")
    x = F.log("close")
    out = windowed(bars2(spark, sf), FOUR_HOURS, {"x": W.diff(x)}, *W.sharpe_layers({"s": "x"}, n, annual))
    out = running(out, FOUR_HOURS, {"rolling_sharpe": W.fill_backward("s")})
    return keep(out.withColumn("rolling_sharpe", F.coalesce("rolling_sharpe", F.lit(0.0))), "symbol", "ts", "rolling_sharpe")


_RET = f"x AS (SELECT symbol, ts, close, volume, close / lag(close) OVER {OVER} - 1 AS x, close - lag(close) OVER {OVER} AS d FROM b1)"


def _ret(spark, sf):
    return windowed(bars1(spark, sf), DAILY, {"x": W.pct_change("close"), "d": W.diff("close")})


@check("w10_rolling_std", sql(_RET, f"SELECT symbol, ts, {r(_full('stddev_samp(x)', 20, what='x'), 'std20')} FROM x"))
def w10_rolling_std(spark, sf):
    return keep(windowed(_ret(spark, sf), DAILY, {"std20": W.rolling_std("x", 20)}), "symbol", "ts", "std20")


@check("w11_mean_abs", sql(_RET, f"SELECT symbol, ts, {r('greatest(m, 1e-6)', 'mean_abs')} FROM (SELECT symbol, ts, {_full('avg(abs(x))', 20, what='x')} AS m FROM x) WHERE m IS NOT NULL"))
def w11_mean_abs(spark, sf):
    out = windowed(_ret(spark, sf), DAILY, {"mean_abs": W.rolling_mean_abs("x", 20, floor=1e-6)})
    return keep(out.dropna(subset=["mean_abs"]), "symbol", "ts", "mean_abs")


@check("w12_prior_range", sql(f"SELECT symbol, ts, {_full('max(close)', 19, 19, -1)} AS upper, {_full('min(close)', 19, 19, -1)} AS lower FROM b1"))
def w12_prior_range(spark, sf):
    out = windowed(bars1(spark, sf), DAILY, {"upper": W.prior_max("close", 20), "lower": W.prior_min("close", 20)})
    return out.select("symbol", "ts", "upper", "lower")


@check("w13_rolling_median", sql(f"SELECT symbol, ts, {r(_full('quantile_cont(close, 0.5)', 21) + ' / close', 'median_ratio')} FROM b1"))
def w13_rolling_median(spark, sf):
    out = W.with_rolling_median(bars1(spark, sf), DAILY, "close", 21, "m")
    return rounded(out.select("symbol", "ts", (F.col("m") / F.col("close")).alias("median_ratio")))


@check(
    "w14_ema",
    sql(
        f"""SELECT a.symbol, a.ts, {r('sum(CASE WHEN b.pos = 0 THEN b.close ELSE b.close * 2 / 21 END * pow(19.0 / 21, a.pos - b.pos)) / any_value(a.close)', 'ema_ratio')}
        FROM p1 a JOIN p1 b ON a.symbol = b.symbol AND b.pos <= a.pos GROUP BY a.symbol, a.ts"""
    ),
)
def w14_ema(spark, sf):
    out = W.ema(bars1(spark, sf), DAILY, "close", 20, "ema")
    return rounded(out.select("symbol", "ts", (F.col("ema") / F.col("close")).alias("ema_ratio")))


_RSI = f"""g AS (SELECT symbol, ts, {_full('avg(greatest(d, 0))', 14, what='d')} AS g, {_full('avg(greatest(-d, 0))', 14, what='d')} AS l,
{_full('avg(greatest(d, 0))', 7, what='d')} AS g7, {_full('avg(greatest(-d, 0))', 7, what='d')} AS l7 FROM x)"""


@check(
    "w15_rsi",
    sql(
        _RET,
        _RSI,
        f"SELECT symbol, ts, {r('CASE WHEN l = 0 AND g > 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END', 'rsi_14')}, {r('coalesce((100 - 100 / (1 + g7 / (l7 + 1e-8)) - 50) / 50, 0)', 'rsi_centred_7')} FROM g",
    ),
)
def w15_rsi(spark, sf):
    out = windowed(_ret(spark, sf), DAILY, {"rsi_14": W.rsi("d", 14), "rsi_centred_7": W.rsi_centred("d", 7)})
    return keep(out, "symbol", "ts", "rsi_14", "rsi_centred_7")


@check("w16_average_volume", sql(f"SELECT symbol, ts, {r(_full('avg(volume)', 20, what='volume'), 'volume_20')} FROM b1"))
def w16_average_volume(spark, sf):
    return keep(windowed(bars1(spark, sf), DAILY, {"volume_20": W.sma("volume", 20)}), "symbol", "ts", "volume_20")


_SIDE = "CASE WHEN close > open THEN 1.0 WHEN close < open THEN -1.0 ELSE 0.0 END"


def _side(spark, sf):
    c, o = F.col("close"), F.col("open")
    return bars1(spark, sf).withColumn("side", F.when(c > o, F.lit(1.0)).when(c < o, F.lit(-1.0)).otherwise(F.lit(0.0)))


@check("w17_turnover", sql(f"x AS (SELECT symbol, ts, {_SIDE} AS side FROM b1)", f"SELECT symbol, ts, {r(f'abs(side - coalesce(lag(side) OVER {OVER}, 0))', 'turnover')} FROM x"))
def w17_turnover(spark, sf):
    return keep(windowed(_side(spark, sf), DAILY, {"turnover": W.turnover("side")}), "symbol", "ts", "turnover")


@check("w18_run_ids", sql(f"x AS (SELECT symbol, ts, {_SIDE} AS side FROM b1), c AS (SELECT *, CASE WHEN side = lag(side) OVER {OVER} THEN 0 ELSE 1 END AS c FROM x)", f"SELECT symbol, ts, (sum(c) OVER {UPTO})::BIGINT AS run_id FROM c"))
def w18_run_ids(spark, sf):
    return W.run_ids(_side(spark, sf), DAILY, "side").select("symbol", "ts", "run_id")


@check("w19_positions", sql("SELECT symbol, ts, pos, n AS n_rows FROM p1"))
def w19_positions(spark, sf):
    return positions(bars1(spark, sf), DAILY).select("symbol", "ts", "pos", "n_rows")


@check("w20_lead_label", sql(f"SELECT symbol, ts, lead(close, 6) OVER {OVER} AS ahead FROM b1"))
def w20_lead_label(spark, sf):
    return windowed(bars1(spark, sf), DAILY, {"ahead": W.lead("close", 6)}).select("symbol", "ts", "ahead")


@check("w21_expanding_max", sql(f"SELECT symbol, ts, max(close) OVER {UPTO} AS top FROM b1"))
def w21_expanding_max(spark, sf):
    return running(bars1(spark, sf), DAILY, {"top": W.expanding_max("close")}).select("symbol", "ts", "top")


@check("w22_hold", sql(f"x AS (SELECT symbol, ts, {_SIDE} AS side FROM b1)", f"SELECT symbol, ts, coalesce(last_value(nullif(side, 0) IGNORE NULLS) OVER {UPTO}, 0)::DOUBLE AS held FROM x"))
def w22_hold(spark, sf):
    return W.hold_until_opposite(_side(spark, sf), DAILY, "side", "held").select("symbol", "ts", "held")


@check("w23_markers", sql(f"x AS (SELECT symbol, ts, {_SIDE} AS side FROM b1)", f"SELECT symbol, ts, {r(f'sign(side - lag(side) OVER {OVER})', 'marker')} FROM x"))
def w23_markers(spark, sf):
    return keep(G.markers(_side(spark, sf), DAILY, "side"), "symbol", "ts", "marker")


@check(
    "w24_vol_regime",
    sql(
        _RET,
        f"s AS (SELECT symbol, ts, {_full('stddev_samp(x)', 20, what='x')} AS s FROM x), m AS (SELECT symbol, ts, s, {_full('quantile_cont(s, 0.5)', 40, what='s')} AS m FROM s)",
        "SELECT symbol, ts, coalesce(s > m, false)::DOUBLE AS vol_regime FROM m",
    ),
)
def w24_vol_regime(spark, sf):
    return X.volatility_regime(_ret(spark, sf), DAILY, "x", 20).select("symbol", "ts", "vol_regime")


# --- signals ---

_MA = f"m AS (SELECT symbol, ts, close, {_full('avg(close)', 10)} AS fast, {_full('avg(close)', 30)} AS slow FROM b1)"


@check("g01_ma_crossover", sql(_MA, f"SELECT symbol, ts, last_value(CASE WHEN fast > slow THEN 1.0::DOUBLE WHEN fast < slow THEN -1.0::DOUBLE END IGNORE NULLS) OVER {UPTO} AS signal FROM m"))
def g01_ma_crossover(spark, sf):
    return G.ma_crossover(bars1(spark, sf), DAILY).select("symbol", "ts", "signal")


@check("g02_ma_long_flat", sql(_MA, "SELECT symbol, ts, coalesce(fast > slow, false)::DOUBLE AS signal FROM m"))
def g02_ma_long_flat(spark, sf):
    return G.ma_long_flat(bars1(spark, sf), DAILY).select("symbol", "ts", "signal")


@check("g03_ma_long_short", sql(_MA, "SELECT symbol, ts, CASE WHEN fast > slow THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS signal FROM m"))
def g03_ma_long_short(spark, sf):
    return G.ma_long_short(bars1(spark, sf), DAILY).select("symbol", "ts", "signal")


_DON = f"c AS (SELECT symbol, ts, close, {_full('max(close)', 19, 19, -1)} AS upper, {_full('min(close)', 19, 19, -1)} AS lower FROM b1)"


@check("g04_donchian", sql(_DON, f"SELECT symbol, ts, last_value(CASE WHEN close < lower THEN -1.0::DOUBLE WHEN close > upper THEN 1.0::DOUBLE END IGNORE NULLS) OVER {UPTO} AS signal FROM c"))
def g04_donchian(spark, sf):
    return G.donchian(bars1(spark, sf), DAILY, lookback=20).select("symbol", "ts", "signal")


@check("a14_signal_counts", sql(_MA, "x AS (SELECT symbol, CASE WHEN fast > slow THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS signal FROM m)", "SELECT symbol, signal, count(*) AS n FROM x GROUP BY ALL"))
def a14_signal_counts(spark, sf):
    return G.signal_counts(G.ma_long_short(bars1(spark, sf), DAILY), DAILY)


# --- sizing ---

_SIZED = f"""z AS (SELECT symbol, ts, pos, coalesce(s, 0) AS s, coalesce(rr, 0) AS rr, low FROM (SELECT symbol, ts, pos, low,
CASE WHEN close > open THEN 1.0 WHEN close < open THEN -1.0 END AS s, (lead(close) OVER {OVER} / close - 1) / 20 AS rr FROM p1))"""


def _sized(spark, sf, mode, **params):
    c, o = F.col("close"), F.col("open")
    rows = bars1(spark, sf).withColumn("signal", F.when(c > o, F.lit(1.0)).when(c < o, F.lit(-1.0)))
    rows = windowed(rows, DAILY, {"simple_r": W.forward_simple_return("close")}).withColumn("simple_r", F.col("simple_r") / 20)
    return keep(Z.size_positions(rows, DAILY, mode, params, "1d"), "symbol", "ts", "weight")


@check("z01_full_notional", sql(_SIZED, "SELECT symbol, ts, s::DOUBLE AS weight FROM z"))
def z01_full_notional(spark, sf):
    return _sized(spark, sf, "full_notional")


@check("z02_fixed_fraction", sql(_SIZED, "SELECT symbol, ts, (s * 0.25)::DOUBLE AS weight FROM z"))
def z02_fixed_fraction(spark, sf):
    return _sized(spark, sf, "fixed_fraction", fraction=0.25)


@check("z03_vol_target", sql(_SIZED, f"v AS (SELECT symbol, ts, s, {_full('stddev_samp(rr)', 50, what='rr')} * sqrt(365) AS v FROM z)", f"SELECT symbol, ts, {r('greatest(least(s * coalesce(0.2 / nullif(v, 0), 0), 3), -3)', 'weight')} FROM v"))
def z03_vol_target(spark, sf):
    return _sized(spark, sf, "vol_target")


@check(
    "z04_fixed_notional",
    sql(
        _SIZED,
        """q AS (SELECT symbol, ts, s, 1 + 1.5 * coalesce(sum(s * rr) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS equity FROM z),
        d AS (SELECT *, min(equity) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS low FROM q)""",
        f"SELECT symbol, ts, {r('CASE WHEN low <= 0 THEN 0 ELSE 1.5 / equity * s END', 'weight')} FROM d",
    ),
)
def z04_fixed_notional(spark, sf):
    return _sized(spark, sf, "fixed_notional", fixed_notional=1.5)


@check("z05_risk_stop", sql(_SIZED, f"v AS (SELECT symbol, ts, s, {_full('avg(abs(rr))', 20, what='rr')} AS v FROM z)", f"SELECT symbol, ts, {r('greatest(least(s * coalesce(0.01 / greatest(v, 1e-6) + 0 * v, 0), 3), -3)', 'weight')} FROM v"))
def z05_risk_stop(spark, sf):
    return _sized(spark, sf, "risk_stop")

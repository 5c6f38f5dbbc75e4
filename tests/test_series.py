"""Blocks give the same results as whole series; scans and quantiles match pandas."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from fixtures import HOURLY, collected, frame, random_walk
from pyspark.sql import functions as F

from barspark.operators import ledger as L
from barspark.operators import permute as P
from barspark.operators import quantiles as Q
from barspark.operators import windows as W
from barspark.operators.quantiles import exact_quantiles
from barspark.operators.signals import donchian, ma_crossover, ma_long_flat
from barspark.operators.sizing import size_positions
from barspark.operators.strategies import Donchian, MovingAverage
from barspark.operators.trades import trade_ids
from barspark.plans.evaluate import Run, in_sample_returns
from barspark.series import Running, positions, running, spread_join, windowed

SMALL = replace(HOURLY, block=37)
N = 300


@pytest.fixture(scope="module")
def pdf():
    return random_walk(N)


def _same(left, right, columns, order=("symbol", "ts")):
    a, b = collected(left, *order), collected(right, *order)
    assert len(a) == len(b)
    for c in columns:
        x, y = a[c].to_numpy(float), b[c].to_numpy(float)
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-12, equal_nan=True, err_msg=c)


def test_positions_number_rows_across_chunks(spark, pdf):
    got = collected(positions(frame(spark, pdf), SMALL), "symbol", "ts")
    assert got.pos.tolist() == list(range(N)) * 2
    assert set(got.n_rows) == {N}


def test_positions_with_gaps_and_many_rows_per_chunk(spark):
    times = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:01", "2024-01-01 00:00:02", "2030-05-01 00:00:00", "2031-01-01 00:00:00"])
    pdf = random_walk(5, symbols=("A",)).assign(ts=times)
    got = collected(positions(frame(spark, pdf), replace(HOURLY, block=1)), "ts")
    assert got.pos.tolist() == [0, 1, 2, 3, 4]


def test_blocked_windows_equal_whole_series(spark, pdf):
    bars = frame(spark, pdf)
    layers = [
        {"sma": W.sma("close", 50), "lead": W.lead("close", 90), "r": W.forward_log_return("close"), "d": W.diff("close")},
        {"std": W.rolling_std("r", 80), "rsi": W.rsi("d", 14), "top": W.prior_max("close", 60)},
    ]
    names = ["med", *[n for layer in layers for n in layer]]
    small, whole = (W.with_rolling_median(windowed(bars, s, *layers), s, "std", 45, "med") for s in (SMALL, HOURLY))
    _same(small, whole, names)


def test_blocked_scans_equal_pandas(spark, pdf):
    bars = frame(spark, pdf)
    sparse = F.when(F.col("volume") > 45, F.col("close"))
    scans = {
        "total": Running("sum", F.col("close")), "top": Running("max", F.col("close")), "low": Running("min", F.col("close")),
        "growth": Running("product", F.col("close") / 100), "fwd": Running("last", sparse), "back": Running("next", sparse),
    }
    got = collected(running(bars, SMALL, scans), "symbol", "ts")
    g = pdf.groupby("symbol").close
    gappy = pdf.close.where(pdf.volume > 45).groupby(pdf.symbol)
    want = {
        "total": g.cumsum(), "top": g.cummax(), "low": g.cummin(), "growth": (pdf.close / 100).groupby(pdf.symbol).cumprod(),
        "fwd": gappy.ffill(), "back": gappy.bfill(),
    }
    for name, values in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), values.to_numpy(float), rtol=1e-9, equal_nan=True, err_msg=name)


@pytest.mark.parametrize("n", [2, 5, 60])
def test_sharpe_by_prefix_sums_equals_the_frame(spark, pdf, n):
    x = pdf.close.pct_change().where(np.arange(len(pdf)) % 50 > 12, 0.0)  # with flat stretches
    df = frame(spark, pdf.assign(volume=x.fillna(0.0)))
    df = df.withColumn("x", F.when(F.col("ts") != F.lit("2024-01-02").cast("timestamp_ntz"), F.col("volume")))
    wide = collected(W.without_helpers(windowed(df, SMALL, *W.sharpe_layers({"s": "x"}, n, 3.0))), "symbol", "ts")
    plain_ = collected(windowed(df, SMALL, {"s": W.rolling_sharpe("x", n, 3.0)}), "symbol", "ts")
    np.testing.assert_allclose(wide.s.to_numpy(float), plain_.s.to_numpy(float), rtol=1e-6, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("span", [1, 3, 20])
def test_ema_is_the_recursion(spark, pdf, span):
    got = collected(W.ema(frame(spark, pdf), SMALL, "close", span, "e"), "symbol", "ts")
    want = pdf.groupby("symbol").close.transform(lambda s: s.ewm(span=span, adjust=False).mean())
    np.testing.assert_allclose(got.e, want, rtol=1e-12)


@pytest.mark.parametrize("span", [1, 2, 20, 200])
def test_ema_with_missing_prices_at_any_block_size(spark, pdf, span):
    gaps = pdf.assign(close=pdf.close.where(np.arange(len(pdf)) % 7 > 2))
    gaps.loc[gaps.groupby("symbol").head(9).index, "close"] = np.nan
    gaps.loc[gaps.groupby("symbol").cumcount().between(SMALL.block * 2, SMALL.block * 4), "close"] = np.nan  # whole blocks
    want = gaps.groupby("symbol").close.transform(lambda s: s.ewm(span=span, adjust=False).mean())
    for spec in (SMALL, replace(SMALL, block=SMALL.block * 3)):
        got = collected(W.ema(frame(spark, gaps), spec, "close", span, "e"), "symbol", "ts")
        np.testing.assert_allclose(got.e.to_numpy(float), want, rtol=1e-11, equal_nan=True)


def test_drawdown_with_ruin(spark, pdf):
    rng = np.random.default_rng(3)
    pdf = pdf.assign(close=rng.normal(0, 0.3, len(pdf)) - (np.arange(len(pdf)) % 97 == 0) * 1.5)
    got = collected(W.drawdown(frame(spark, pdf), SMALL, "close"), "symbol", "ts")
    equity = (1 + pdf.close).groupby(pdf.symbol).cumprod()
    np.testing.assert_allclose(got.equity, equity, rtol=1e-9)
    np.testing.assert_allclose(got.drawdown, equity / equity.groupby(pdf.symbol).cummax() - 1, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize(
    "make",
    [
        lambda b, s: ma_crossover(b, s, fast=3, slow=40), lambda b, s: donchian(b, s, lookback=60), lambda b, s: ma_long_flat(b, s),
        lambda b, s: W.run_ids(b.withColumn("signal", F.signum(F.col("close") - F.col("open"))), s, "signal").withColumn("signal", F.col("run_id")),
    ],
)
def test_blocked_signals(spark, pdf, make):
    bars = frame(spark, pdf)
    _same(make(bars, SMALL), make(bars, HOURLY), ["signal"])


@pytest.mark.parametrize("mode", ["vol_target", "risk_stop", "fixed_notional", "full_notional"])
def test_blocked_returns_block(spark, pdf, mode):
    bars = frame(spark, pdf)
    run = Run(tf="1h", sizing=mode, sizing_params={"lookback": 20})
    strategy = MovingAverage(max_window=8, grid_block=29)
    a, b = in_sample_returns(bars, SMALL, strategy, run), in_sample_returns(bars, HOURLY, MovingAverage(max_window=8), run)
    _same(a, b, ["r", "weight", "turnover", "strategy_r_net"])


def test_blocked_grids(spark, pdf):
    rows = positions(frame(spark, pdf), HOURLY)
    for small, large, keys in (
        (MovingAverage(max_window=20, grid_block=31), MovingAverage(max_window=20), ["fast", "slow"]),
        (Donchian(high=45, grid_block=31), Donchian(high=45), ["lookback"]),
    ):
        _same(small.scores(rows, HOURLY), large.scores(rows, HOURLY), ["gain", "loss", "pf"], ("symbol", *keys))


def test_blocked_trades_and_ledger(spark, pdf):
    bars = frame(spark, pdf)
    signals = {s: ma_long_flat(bars, s, fast=3, slow=9) for s in (SMALL, HOURLY)}
    a, b = (trade_ids(signals[s].withColumn("weight", F.col("signal")), s) for s in (SMALL, HOURLY))
    _same(a, b, ["trade_id"])
    a, b = (L.ledger(signals[s], s, loss_limit=5.0) for s in (SMALL, HOURLY))
    _same(a, b, ["equity", "peak", "drawdown", "gross_pnl", "position_qty"])


def test_permutation_ranks_do_not_depend_on_buckets(spark, pdf, monkeypatch):
    bars = positions(frame(spark, pdf), HOURLY)
    whole = P.permuted_bars(bars, HOURLY, 2, 10)
    monkeypatch.setattr(P, "RANK_BUCKET", 16)
    _same(P.permuted_bars(bars, SMALL, 2, 10), whole, ["open", "high", "low", "close", "volume"], ("symbol", "seed", "ts"))


def test_exact_quantiles_on_ties_and_skew(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(
        {"k": ["hot"] * 5000 + ["b"] * 7 + ["one"], "x": np.concatenate([np.where(rng.random(5000) < 0.4, 0.0, rng.normal(0, 1, 5000) ** 3), np.arange(7.0), [4.0]])}
    )
    qs = [0.0, 0.05, 0.1, 0.5, 0.9, 1.0]
    got = {r.k: r.quantiles for r in exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", qs, accuracy=50).collect()}
    for k, part in pdf.groupby("k"):
        np.testing.assert_allclose(got[k], np.quantile(part.x, qs), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("n", [2, 3, 33, 47, 64, 100, 129])
def test_wide_extremes_and_medians_equal_the_frame(spark, pdf, n):
    holes = pdf.copy()
    holes.loc[holes.index % 37 == 5, "close"] = np.nan
    for source, spec in ((pdf, replace(HOURLY, block=16)), (holes, replace(HOURLY, block=50))):
        bars = frame(spark, source).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
        out = windowed(bars, spec, {"high_": W.prior_max("close", n), "low_": W.prior_min("close", n)})
        got = collected(W.with_rolling_median(out, spec, "close", n, "mid"), "symbol", "ts")
        assert not [c for c in got.columns if c.startswith("__")]
        for _, part in got.groupby("symbol"):
            x = part.close.astype(float)
            for name, want in (("high_", x.rolling(n - 1).max().shift(1)), ("low_", x.rolling(n - 1).min().shift(1)), ("mid", x.rolling(n).median())):
                np.testing.assert_allclose(part[name].astype(float), want, err_msg=name)


@pytest.mark.parametrize("ranked", [1, 7, 300])
def test_quantiles_in_levels(spark, monkeypatch, ranked):
    """Intervals of more than ``RANKED`` rows are cut again, whatever the values' distribution; no rank is put in order among more."""
    monkeypatch.setattr(Q, "RANKED", ranked)
    monkeypatch.setattr(Q, "PARTS", 9)
    rng = np.random.default_rng(6)
    x = np.concatenate([np.exp(rng.normal(0, 40, 3000)), -np.exp(rng.normal(0, 40, 2000)), np.full(2500, 1.5), np.repeat(rng.normal(size=40), 30), [np.inf, -0.0, 5e-324]])
    qs = [0.0, 0.001, 0.2, 0.5, 0.51, 0.9999, 1.0]
    got = exact_quantiles(spark.createDataFrame(pd.DataFrame({"x": x})).withColumn("k", F.lit("hot")), ["k"], "x", qs, accuracy=40).first().quantiles
    np.testing.assert_allclose(got[:-2], np.quantile(x, qs)[:-2], rtol=1e-14)
    assert exact_quantiles(spark.createDataFrame([], "k string, x double"), ["k"], "x", qs).count() == 0


def test_joins_to_one_long_series_are_spread(spark, pdf, monkeypatch):
    """Every share of a long series gets one copy, a short series one in all, and the copies meet every row."""
    from barspark import series as S

    monkeypatch.setattr(S, "SHARE", 100)
    bars = positions(frame(spark, pdf), HOURLY)
    small = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "symbol string, p double")
    joined = spread_join(bars, small, ["symbol"])
    assert joined.count() == 2 * N and joined.filter("p is null").isEmpty() and joined.columns == [*bars.columns, "p"]
    wide = bars.withColumn(S.SALT, F.floor(F.col("pos") / 100))
    assert spread_join(wide, small, ["symbol"]).groupBy("symbol", S.SALT).count().filter("count > 100").isEmpty()


def test_spread_join_keeps_every_row(spark, pdf):
    bars = frame(spark, pdf)
    small = spark.createDataFrame([("A", 1.0)], "symbol string, p double")
    assert spread_join(bars, small, ["symbol"]).count() == N
    assert spread_join(bars, small, ["symbol"], "left").count() == 2 * N


def test_sizing_on_unknown_mode_is_the_signal(spark, pdf):
    bars = ma_long_flat(frame(spark, pdf), HOURLY).withColumn("simple_r", F.lit(0.0))
    got = collected(size_positions(bars, HOURLY, "no such mode"), "symbol", "ts")
    assert (got.weight == got.signal).all()

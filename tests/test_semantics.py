"""Micro series, known results and brute force."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from fixtures import HOURLY, collected, frame, random_walk, series
from pyspark.sql import functions as F

from barspark.functions import scalars as S
from barspark.operators import features as X
from barspark.operators import kernels
from barspark.operators import ledger as L
from barspark.operators import metrics as M
from barspark.operators import permute as P
from barspark.operators import windows as W
from barspark.operators.folds import fold_report, fold_rows, full_history_signals, walk_forward_signals
from barspark.operators import networks as N
from barspark.operators.forecaster import Features, Forecaster
from barspark.operators.direction import DirectionClassifier
from barspark.operators.models import fit_logistic
from barspark.operators.prices import vwap, with_price
from barspark.operators.quality import series_quality
from barspark.operators.returns import evaluate_returns
from barspark.operators.signals import donchian
from barspark.operators.significance import p_value
from barspark.operators.sizing import fixed_notional
from barspark.operators.strategies import Donchian, MovingAverage, PandasStrategy, Strategy
from barspark.operators.trades import trade_table
from barspark.plans import evaluate as E
from barspark.plans import montecarlo as MC
from barspark.series import positions, windowed

# --- micro series ---


def test_constant_price(spark):
    bars = series(spark, [100.0] * 12)
    out = windowed(bars, HOURLY, {"d": W.diff("close")}, {"rsi": W.rsi("d", 5), "std": W.rolling_std("close", 4), "c": W.rsi_centred("d", 5)})
    got = collected(out, "ts")
    assert got.rsi.isna().all() and (got["std"].dropna() == 0).all() and (got.c[5:] == -1).all()
    assert donchian(bars, HOURLY, lookback=4).filter("signal is not null").count() == 0
    rows = evaluate_returns(bars.withColumn("signal", F.lit(1.0)), HOURLY, tf="1h")
    assert rows.agg(M.profit_factor("strategy_r")).first()[0] == 0


def test_rising_price(spark):
    bars = series(spark, np.arange(1.0, 13.0))
    got = collected(windowed(bars, HOURLY, {"d": W.diff("close")}, {"rsi": W.rsi("d", 5)}), "ts")
    assert (got.rsi.dropna() == 100).all() and got.rsi.notna().sum() == 7
    rows = evaluate_returns(bars.withColumn("signal", F.lit(1.0)), HOURLY, tf="1h")
    assert rows.agg(M.profit_factor("strategy_r")).first()[0] == float("inf")
    stats = M.trade_stats(trade_table(rows, HOURLY), HOURLY).first()
    assert stats.num_trades == 1 and stats.win_rate_net_pct == 100 and stats.expectancy_tharp_net_pct is None


def test_flips_make_three_trades(spark):
    weights = [0.0, 1, 1, -1, -1, 0, 0, 1, 1, 1]
    bars = series(spark, np.linspace(100, 110, 10)).withColumn("i", (F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) % 1000)
    first = bars.agg(F.min("i")).first()[0]
    signal = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") - first).cast("int"))
    rows = evaluate_returns(bars.withColumn("signal", signal), HOURLY, tf="1h", slippage_bps=10, drop_open_end=False)
    got = collected(rows, "ts")
    assert got.turnover.tolist() == [0, 1, 0, 2, 0, 1, 0, 1, 0, 0]
    trades = collected(trade_table(rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("strategy_simple_r", "strategy_simple_r_net")}), HOURLY), "trade_id")
    assert trades.trade_id.tolist() == [1, 2, 3]
    assert trades.direction.tolist() == ["long", "short", "long"]
    assert trades.bars.tolist() == [2, 2, 3]
    np.testing.assert_allclose(trades.cost_sum, 0.002 * trades.turnover_sum)


def test_vwap_repeats_over_zero_volume(spark):
    bars = series(spark, [10.0, 11, 12, 13, 14, 15, 16, 17], volume=[0, 0, 0, 2, 0, 0, 0, 1])
    got = collected(vwap(bars, HOURLY, 2, "v"), "ts").v
    assert got[:3].isna().all()
    typical = (bars.toPandas().eval("(high + low + close) / 3")).tolist()
    np.testing.assert_allclose(got[3:7], [typical[3]] * 4)


def test_fixed_notional_stops_at_ruin(spark):
    r = np.array([0.1, -1.2, 0.5, 0.5, -0.3])
    bars = series(spark, np.ones(5)).withColumn("k", F.dayofmonth("ts") * 0 + F.hour("ts"))
    bars = bars.withColumns({"signal": F.lit(1.0), "simple_r": F.get(F.array(*[F.lit(x) for x in r]), F.col("k"))})
    got = collected(fixed_notional(bars, HOURLY, 1.0), "ts").weight
    equity, want = 1.0, []
    for x in r:
        w = 1.0 / equity if equity > 0 else 0.0
        want.append(w)
        equity *= 1 + w * x
    np.testing.assert_allclose(got, want)


def test_gap_is_strictly_more_than_two_steps(spark):
    times = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00", "2024-01-01 04:00", "2024-01-01 06:00"])
    got = series_quality(series(spark, [1.0, 2, 3, 4], times=times), HOURLY).first()
    assert got.large_gaps_detected == 1 and got.data_coverage_pct == round(4 / 6 * 100, 2)


def test_complete_daily_series_exceeds_full_coverage(spark):
    from dataclasses import replace

    bars = series(spark, np.ones(2921), step_hours=24)
    assert series_quality(bars, replace(HOURLY, step=86_400)).first().data_coverage_pct == 100.03


def test_too_few_bars_give_no_fold(spark):
    bars = series(spark, np.arange(1.0, 31.0))
    assert fold_report(bars, HOURLY, 30, 5).first().no_fold_ran
    out = walk_forward_signals(bars, HOURLY, MovingAverage(max_window=5), 30, 5)
    assert out.count() == 30 and out.filter("signal is not null").count() == 0


# --- known results ---


def test_known_p_value(spark):
    """9 of 20 shuffles at least as good as 2.5265 give 10/21."""
    real = spark.createDataFrame([("A", 2.5265005398670617)], "symbol string, real_pf double")
    factors = [
        2.943, 2.873, 3.0482, 2.0777, 3.2752, 1.6579, 2.0763, 2.9288, 2.257, 2.3823, 2.3037, 2.784, 2.0713, 2.5461, 2.0099,
        2.5252, 2.6444, 2.1155, 2.3962, 2.5537,
    ]
    pfs = spark.createDataFrame([("A", i, pf) for i, pf in enumerate(factors)], "symbol string, seed long, pf double")
    got = p_value(pfs, real, HOURLY).first()
    assert got.better == 9 and got.p_value == pytest.approx(0.47619047619047616)


@pytest.mark.parametrize("tf,bars", [("1h", 8760), ("4h", 2190), ("1d", 365), ("15m", 35040)])
def test_annualisation(tf, bars):
    assert S.annualisation(tf) == pytest.approx(bars**0.5)


def test_annualisation_of_unknown_interval():
    with pytest.raises(ValueError):
        S.annualisation("1w")
    assert S.annualisation("1w", strict=False) == pytest.approx(8760**0.5)
    assert S.annualisation("", strict=False) == 1.0


def test_zero_fee_means_default():
    assert S.fee_rate(0) == S.fee_rate() == pytest.approx(0.001)
    assert S.fee_rate(mode="Futures ", slippage_bps=1) == pytest.approx(0.0005)
    assert S.fee_rate(zero_fee=True) == 0


def test_price_names(spark):
    bars = series(spark, [1.0, 2.0, 3.0])
    for bad in ("nope", "open_interest"):
        with pytest.raises(KeyError):
            with_price(bars, HOURLY, bad)
    with pytest.raises(KeyError):
        with_price(bars.drop("volume"), HOURLY, "vwap_5")
    stored = bars.withColumn("vwap", F.lit(7.0))
    assert with_price(stored, HOURLY, "vwap").first().vwap == 7.0
    assert with_price(stored, HOURLY, "vwap", derive=True).filter("vwap = 7.0").count() == 0


# --- brute force ---


def _brute_donchian(price, lb):
    s = pd.Series(price)
    up, lo = s.rolling(lb - 1).max().shift(1), s.rolling(lb - 1).min().shift(1)
    out = pd.Series(np.nan, index=s.index)
    out[s > up] = 1
    out[s < lo] = -1
    return out.ffill().to_numpy()


def _brute_ma(price, fast, slow):
    s = pd.Series(price)
    a, b = s.rolling(fast).mean(), s.rolling(slow).mean()
    out = pd.Series(np.nan, index=s.index)
    out[a > b] = 1
    out[a < b] = -1
    return out.ffill().to_numpy()


def _pf(x):
    x = x[~np.isnan(x)]
    gain, loss = x[x > 0].sum(), -x[x < 0].sum()
    return gain / loss if loss > 0 else (np.inf if gain > 0 else 0.0)


def _forward(price):
    return np.append(np.diff(np.log(price)), np.nan)


def _fit(price, kind, top):
    r, best, chosen = _forward(price), 0.0, None
    grid = [(lb,) for lb in range(2, top + 1)] if kind == "donchian" else kernels.ma_pairs(top)
    for p in grid:
        if kind == "donchian":
            pf = _pf(_brute_donchian(price, *p) * r)
        else:
            s = pd.Series(price)
            x = np.where(s.rolling(p[0]).mean() > s.rolling(p[1]).mean(), 1, 0) * r
            pf = _pf(x) if (x < 0).any() else 0.0
        if pf > best:
            best, chosen = pf, p
    return chosen, best


@pytest.mark.parametrize("kind,strategy,top", [("donchian", Donchian(high=25), 25), ("ma", MovingAverage(max_window=9), 9)])
def test_fit_is_the_exhaustive_search(spark, kind, strategy, top):
    pdf = random_walk(220, seed=11)
    got = {r.symbol: r for r in strategy.fit(positions(frame(spark, pdf), HOURLY), HOURLY).collect()}
    for symbol, part in pdf.groupby("symbol"):
        chosen, best = _fit(part.close.to_numpy(), kind, top)
        assert tuple(got[symbol][p] for p in strategy.params) == chosen
        assert got[symbol].metric == pytest.approx(best)


@pytest.mark.parametrize("kind,strategy,top", [("donchian", Donchian(high=15), 15), ("ma", MovingAverage(max_window=7), 7)])
def test_walk_forward_is_the_fold_loop(spark, kind, strategy, top):
    pdf = random_walk(143, seed=21)
    length, step = 50, 17
    got = collected(walk_forward_signals(frame(spark, pdf), HOURLY, strategy, length, step), "symbol", "ts")
    for symbol, part in pdf.groupby("symbol"):
        price = part.close.to_numpy()
        want = np.full(len(price), np.nan)
        for i in range(length, len(price), step):
            chosen, _ = _fit(price[i - length : i], kind, top)
            end = min(i + step, len(price))
            if chosen is not None:
                signal = (_brute_donchian if kind == "donchian" else _brute_ma)(price[i - length : end], *chosen)
                want[i:end] = signal[length:]
        np.testing.assert_array_equal(got[got.symbol == symbol].signal.to_numpy(float), want)


class _FramesOnly:
    """A strategy without the fold kernel, so that folds run as a key."""

    def __init__(self, inner):
        self.price, self.params = inner.price, inner.params
        self.fit, self.signals = inner.fit, inner.signals


def test_fold_as_key_equals_fold_kernel(spark):
    bars = frame(spark, random_walk(120, seed=31))
    for strategy in (MovingAverage(max_window=6), Donchian(high=12)):
        a = collected(walk_forward_signals(bars, HOURLY, strategy, 40, 15), "symbol", "ts")
        b = collected(walk_forward_signals(bars, HOURLY, _FramesOnly(strategy), 40, 15), "symbol", "ts")
        np.testing.assert_array_equal(a.signal.to_numpy(float), b.signal.to_numpy(float))


def test_pandas_strategy_plugs_in(spark):
    plug = PandasStrategy(lambda train: ({"level": train.close.mean()}, 1.0), lambda ctx, p: np.sign(ctx.close - p["level"]), ("level",))
    pdf = random_walk(90, seed=41, symbols=("A",))
    got = collected(walk_forward_signals(frame(spark, pdf), HOURLY, plug, 30, 10), "ts")
    assert got.signal[:30].isna().all()
    assert got.signal[45] == np.sign(pdf.close[45] - pdf.close[10:40].mean())
    rows, metrics = E.in_sample(frame(spark, pdf), HOURLY, plug, E.Run(tf="1h"))
    whole = np.sign(pdf.close - pdf.close.mean())[:89]
    assert collected(rows, "ts").signal.tolist() == whole.tolist() and metrics.count() == 1
    pfs, result = MC.in_sample_test(frame(spark, pdf), HOURLY, plug, E.Run(tf="1h"), 4)
    assert pfs.count() == 3 and result.first().draws == 3
    with pytest.raises(Exception, match="more than 50 bars"):
        plug_short = replace(plug, most=50)
        plug_short.fit(positions(frame(spark, pdf), HOURLY), HOURLY).collect()


def test_strategies_follow_the_protocol():
    assert all(isinstance(s, Strategy) for s in (MovingAverage(), Donchian(), Forecaster()))


def test_folds_tile_the_out_of_sample_bars(spark):
    bars = frame(spark, random_walk(101, symbols=("A",)))
    oos = collected(fold_rows(bars, HOURLY, 30, 12, "oos"), "ts")
    assert oos.pos.tolist() == list(range(30, 101)) and oos.fold.is_monotonic_increasing
    sizes = fold_rows(bars, HOURLY, 30, 12, "train").groupBy("fold").count().collect()
    assert {r["count"] for r in sizes} == {30} and len(sizes) == 6


def test_full_history_variant_carries_ties(spark):
    price = np.concatenate([np.linspace(10, 12, 40), np.full(30, 12.0)])
    out = collected(full_history_signals(series(spark, price), HOURLY, MovingAverage(max_window=4), 30, 10), "ts")
    assert set(out.signal.dropna()) <= {1.0, -1.0}


# --- permutations ---


def test_permutation_keeps_what_it_must(spark):
    pdf = random_walk(80, seed=51, symbols=("A",))
    rows = positions(frame(spark, pdf), HOURLY)
    got = collected(P.permuted_bars(rows, HOURLY, [7], 20), "ts")
    for c in ("open", "high", "low", "close"):
        np.testing.assert_allclose(got[c][:21], pdf[c][:21])
    assert got.close.iloc[-1] == pytest.approx(pdf.close.iloc[-1])
    assert (got.volume == pdf.volume).all()
    parts = lambda d: (np.log(d.open / d.close.shift())[21:], np.log(d.close / d.open)[21:], np.log(d.high / d.open)[21:])
    for a, b in zip(parts(got), parts(pdf), strict=True):
        np.testing.assert_allclose(np.sort(a), np.sort(b), atol=1e-12)
    assert not np.allclose(got.close[21:-1], pdf.close[21:-1])


def test_markets_with_one_index_shuffle_alike(spark):
    rows = positions(frame(spark, random_walk(60, seed=61)), HOURLY).withColumn("movable", F.col("n_rows") - 1).filter("pos > 0")
    slots = collected(P.shuffled_slots(P.with_seeds(rows, 2), HOURLY, "bar"), "seed", "pos", "symbol")
    assert slots.groupby(["seed", "pos"]).slot.nunique().max() == 1


def test_seeds_do_not_depend_on_each_other(spark):
    rows = positions(frame(spark, random_walk(40, seed=71, symbols=("A",))), HOURLY)
    many = collected(P.permuted_bars(rows, HOURLY, 3).filter("seed = 2"), "ts")
    one = collected(P.permuted_bars(rows, HOURLY, [2]), "ts")
    np.testing.assert_allclose(many.close, one.close)


def test_walk_forward_test_with_dates(spark):
    bars = frame(spark, random_walk(200, seed=81, symbols=("A",)))
    run = E.Run(start="2024-01-04", end="2024-01-08", tf="1h")
    pfs, result = MC.walk_forward_test(bars, HOURLY, MovingAverage(max_window=6), run, 40, 12, 4)
    row = result.first()
    assert pfs.count() == row.draws == 4 and 1 / 5 <= row.p_value <= 1


# --- learning ---


def test_logistic_fit_is_the_penalised_optimum(spark):
    rng = np.random.default_rng(91)
    x = rng.normal([50, 1000], [10, 300], (400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 50) / 8))).astype(int)
    pdf = pd.DataFrame({"k": np.where(np.arange(400) < 300, "a", "b"), "a": x[:, 0], "b": x[:, 1], "y": y})
    got = {r.k: r for r in fit_logistic(spark.createDataFrame(pdf), ["k"], "y", ["a", "b"]).collect()}
    for k, part in pdf.groupby("k"):
        w = np.array([*got[k].coef])
        p = 1 / (1 + np.exp(-(part[["a", "b"]].to_numpy() @ w + got[k].intercept)))
        np.testing.assert_allclose(part[["a", "b"]].to_numpy().T @ (p - part.y) + w, 0, atol=1e-4)
        assert abs((p - part.y).sum()) < 1e-6


def test_nearly_separable_fit_runs_to_its_end(spark):
    x = np.linspace(-1, 1, 60)
    y = (x > 0).astype(int)
    y[30] = 0
    pdf = pd.DataFrame({"k": "a", "a": x, "y": y})
    row = fit_logistic(spark.createDataFrame(pdf), ["k"], "y", ["a"], l2=1e-3).first()
    p = 1 / (1 + np.exp(-(x * row.coef[0] + row.intercept)))
    assert row.converged and abs(x @ (p - y) + 1e-3 * row.coef[0]) < 1e-6
    short = fit_logistic(spark.createDataFrame(pdf), ["k"], "y", ["a"], l2=1e-3, max_passes=2).first()
    assert not short.converged


def test_direction_classifier_picks_by_held_out_factor(spark):
    rows = positions(frame(spark, random_walk(500, seed=101, symbols=("A",))), HOURLY)
    model = DirectionClassifier(rsi=(14,), ema=(20, 50), vol=(10,))
    params = model.fit(rows, HOURLY)
    row = params.first()
    assert row.rsi_period == 14 and row.ema_period in (20, 50) and len(row.coef) == 3
    signals = model.signals(rows, params, HOURLY)
    assert signals.count() == 500 and {r.signal for r in signals.select("signal").distinct().collect()} <= {0.0, 1.0}


@pytest.mark.parametrize("causal", [False, True])
def test_direction_folds_equal_folds_as_a_key(spark, causal):
    bars = frame(spark, random_walk(230, seed=102))
    model = DirectionClassifier(rsi=(5, 9), ema=(4, 12), vol=(6,), minimum=30, causal=causal)
    a = collected(walk_forward_signals(bars, HOURLY, model, 110, 40), "symbol", "ts")
    b = collected(walk_forward_signals(bars, HOURLY, _FramesOnly(model), 110, 40), "symbol", "ts")
    np.testing.assert_array_equal(a.signal.to_numpy(float), b.signal.to_numpy(float))
    assert a.signal[110:150].notna().all() and len(a.ema_period.dropna().unique()) > 1
    none = walk_forward_signals(bars, HOURLY, replace(model, minimum=9_999), 110, 40)
    assert none.filter("signal is not null").isEmpty()


def test_direction_fits_in_blocks_are_those_of_one_block(spark):
    rows = positions(frame(spark, random_walk(400, seed=103)), HOURLY)
    model = DirectionClassifier(rsi=(5, 9), ema=(4, 12), vol=(6,))
    a, b = ({r.symbol: r for r in model.fit(rows, s).collect()} for s in (HOURLY, replace(HOURLY, block=64)))
    for symbol, row in a.items():
        other = b[symbol]
        assert (row.rsi_period, row.ema_period, row.vol_period, row.converged) == (other.rsi_period, other.ema_period, other.vol_period, True)
        np.testing.assert_allclose([*row.coef, row.intercept, row.metric], [*other.coef, other.intercept, other.metric], rtol=1e-7)
    short = replace(model, max_passes=1)
    assert {r.converged for r in short.fit(rows, HOURLY).collect()} == {False}


def test_direction_weights_are_the_penalised_optimum(spark):
    pdf = random_walk(400, seed=104, symbols=("A",))
    model = DirectionClassifier(rsi=(9,), ema=(12,), vol=(6,))
    row = model.fit(positions(frame(spark, pdf), HOURLY), HOURLY).first()
    price = pdf.close.to_numpy()
    x = model._part(price, pdf.volume.to_numpy(float), 0, 280)
    y = (_forward(price)[:280] > 0).astype(float)
    mine = ~np.isnan(x).any(axis=1)
    x, y, w = x[mine], y[mine], np.array(row.coef)
    p = 1 / (1 + np.exp(-(x @ w + row.intercept)))
    scale = np.abs(x).sum(axis=0)
    np.testing.assert_allclose((x.T @ (p - y) + w) / scale, 0, atol=1e-7)
    assert abs((p - y).sum()) < 1e-6


FS = X.FeatureSet(tf="1h", horizon_hours=3, vol_hours=12, sma=(5,), momentum=(7,), rsi=(7,), regime_window=6)
SMALL = N.Training(hidden=6, epochs=6, batch=32, rate=0.01)


def test_gradient_is_the_slope_of_the_loss():
    t = N.Training(hidden=4, classes=3)
    draw = np.random.default_rng(5)
    x, y = draw.normal(size=(30, 5)), draw.integers(0, 3, 30)
    w = N.initial(5, t) + draw.normal(size=len(N.initial(5, t))) / 5
    slopes = [(N.losses(w + e, x, y, t).mean() - N.losses(w - e, x, y, t).mean()) / 2e-6 for e in np.eye(len(w)) * 1e-6]
    np.testing.assert_allclose(N.gradient(w, x, y, t), slopes, atol=1e-8)
    mask = np.ones((30, 4))
    np.testing.assert_allclose(N.gradient(w, x, y, t, mask), slopes, atol=1e-8)
    assert not N.gradient(w, x, y, t, 0 * mask)[: 5 * 4 + 4].any()


def test_training_ends_where_the_gradient_vanishes():
    t = N.Training(hidden=4, classes=2, dropout=0.0, epochs=6000, decay=0.0, rate=0.002, batch=100, patience=6000)
    draw = np.random.default_rng(6)
    x = draw.normal(size=(100, 2))
    y = (x[:, 0] + draw.normal(size=100) > 0).astype(int)
    w = N.train(x, y, x[:0], y[:0], t)
    assert np.abs(N.gradient(w, x, y, t)).max() < 0.01 < 0.1 < np.abs(N.gradient(N.initial(2, t), x, y, t)).max()


def _networks(spark, blocks, t, block):
    rows = [(k, i, len(y), [float(v) for v in x[i]], int(y[i]), bool(i < 0.8 * len(y))) for k, (x, y) in blocks.items() for i in range(len(y))]
    df = spark.createDataFrame(rows, "k string, place long, whole long, x array<double>, label int, train boolean")
    return {r.k: np.array(r.network) for r in N.fit_networks(df, ["k"], 3, t, block).collect()}


def test_networks_in_blocks_are_averaged_epoch_by_epoch(spark):
    draw = np.random.default_rng(7)
    data = {k: (draw.normal(size=(n, 3)), draw.integers(0, 5, n)) for k, n in (("a", 90), ("b", 40), ("c", 230))}
    t = N.Training(hidden=3, epochs=5, batch=16, rate=0.01, patience=2)
    got = _networks(spark, data, t, 100)
    for k, (x, y) in data.items():
        cut = int(np.ceil(0.8 * len(y)))
        parts = [slice(a, min(a + 100, cut)) for a in range(0, cut, 100)]
        s, best, bad = N.State.start(3, t), np.inf, 0
        for number in range(t.epochs):
            new = [N.epoch(s, x[p], y[p], t, number, b) for b, p in enumerate(parts)]
            sizes = [p.stop - p.start for p in parts]
            mean = lambda name: sum(getattr(o, name) * n for o, n in zip(new, sizes)) / sum(sizes)  # noqa: B023, E731
            s = N.State(mean("w"), mean("m"), mean("v"), max(o.steps for o in new))
            loss = N.losses(s.w, x[cut:], y[cut:], t).mean()
            best, bad = (loss, 0) if loss < best else (best, bad + 1)
            if bad >= t.patience:
                break
        np.testing.assert_allclose(got[k], s.w, atol=1e-9)
    alone = _networks(spark, {"b": data["b"]}, t, 100)
    np.testing.assert_array_equal(alone["b"], got["b"])


def test_stretches_have_their_own_warm_ups(spark):
    pdf = random_walk(160, seed=113, symbols=("A",))
    shared = Features(pdf.close.to_numpy(), FS)
    for first, stop in ((0, 160), (37, 120), (100, 112)):
        rows = frame(spark, pdf[first:stop])
        built = collected(X.features(X.normalised_return(rows, HOURLY, FS), HOURLY, FS), "ts")
        x, norm = shared.part(first, stop)
        np.testing.assert_allclose(x, built[FS.names].to_numpy(float), atol=1e-9)
        np.testing.assert_allclose(norm, built.norm_return.to_numpy(float), atol=1e-9)


def test_forecaster_uses_only_the_past_and_its_own_series(spark):
    pdf = random_walk(300, seed=111, symbols=("A", "B"))
    changed = pdf.copy()
    changed.loc[(pdf.symbol == "A") & (pdf.ts >= pdf.ts.min() + pd.Timedelta(hours=250)), ["open", "high", "low", "close"]] *= 3
    model = Forecaster(FS, N.Training(hidden=6, epochs=3, batch=32, patience=9))
    a, b, alone = (
        {r.symbol: r for r in model.fit(positions(frame(spark, p), HOURLY), HOURLY).collect()} for p in (pdf, changed, pdf[pdf.symbol == "B"])
    )
    assert a["A"] == b["A"] and a["B"] == b["B"] == alone["B"] and a["A"].network != a["B"].network and a["A"].metric == 1
    params = model.fit(positions(frame(spark, pdf), HOURLY), HOURLY)
    out = model.signals(positions(frame(spark, pdf), HOURLY), params, HOURLY).join(params, "symbol")
    assert out.count() == 600 and out.filter("signal is null or score is null").count() == 0
    assert out.filter((F.col("signal") == 1) != (F.col("score") > F.col("score_high"))).count() == 0
    assert out.filter((F.col("signal") == -1) != (F.col("score") < F.col("score_low"))).count() == 0
    short = positions(frame(spark, pdf[:3]), HOURLY)
    assert model.signals(short, model.fit(short, HOURLY), HOURLY).filter("signal is not null").count() == 0


def test_forecaster_folds_equal_folds_as_a_key(spark):
    bars = frame(spark, random_walk(260, seed=112))
    for hold in (False, True):
        model = Forecaster(FS, SMALL, hold=hold)
        a = collected(walk_forward_signals(bars, HOURLY, model, 120, 50), "symbol", "ts")
        b = collected(walk_forward_signals(bars, HOURLY, _FramesOnly(model), 120, 50), "symbol", "ts")
        np.testing.assert_array_equal(a.signal.to_numpy(float), b.signal.to_numpy(float))
        assert a.signal[120:].notna().any() and set(a.signal.dropna()) <= {-1.0, 0.0, 1.0}


# --- ledger ---


def test_ledger_follows_the_bar_loop(spark):
    pdf = random_walk(200, seed=121, symbols=("A",))
    signal = np.sign(pdf.close.diff(3)).fillna(0)
    bars = spark.createDataFrame(pdf.assign(signal=signal)[["symbol", "ts", "close", "signal"]])
    bars = bars.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = collected(L.ledger(bars, HOURLY, base_qty=2, max_notional=150, fee_rate=0.001, loss_limit=3.0), "ts")
    qty = gross = fees = drawdown = 0.0
    entry, peak, equities = None, 10_000.0, []
    for price, s in zip(pdf.close, signal, strict=True):
        if gross - fees > -3.0:
            if s > 0 and qty == 0:
                qty, entry = min(2, 150 / price), price
                fees += qty * price * 0.001
            elif s <= 0 and qty > 0:
                fees += qty * price * 0.001
                gross, qty = gross + (price - entry) * qty, 0.0
            equity = 10_000 + gross + (price - entry if qty else 0) * qty - fees
            peak = max(peak, equity)
            drawdown = min(drawdown, equity - peak)
            equities.append(equity)
    live = got[~got.halted]
    assert 0 < len(live) < 200
    np.testing.assert_allclose(live.equity, equities)
    assert live.drawdown.min() == pytest.approx(drawdown)

"""Features and labels for the learned strategies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import clip, digitise, finite_or, parse_minutes, threshold_signal
from barspark.operators import windows as W
from barspark.operators.quantiles import exact_quantiles, interior_probabilities
from barspark.series import POS, ROWS, Rolling, Running, Series, ensure_positions, plain, running, spread_join, windowed, windowed_filled


@dataclass(frozen=True)
class FeatureSet:
    """Which features to build, and on what."""

    price: str = "close"
    tf: str = "1h"
    horizon_hours: int = 6
    vol_hours: int = 60
    sma: tuple[int, ...] = (5, 10, 20, 30)
    momentum: tuple[int, ...] = (7, 14, 21, 30)
    rsi: tuple[int, ...] = (7, 14, 21)
    regime_window: int | None = 60

    @property
    def hours(self) -> float:
        return (parse_minutes(self.tf) or 60) / 60

    @property
    def vol_bars(self) -> int:
        return max(5, int(self.vol_hours / self.hours))

    @property
    def horizon_bars(self) -> int:
        return int(self.horizon_hours / self.hours)

    @property
    def names(self) -> list[str]:
        plain_names = [f"sma_{n}" for n in self.sma] + [f"mom_{n}" for n in self.momentum] + [f"rsi_{n}" for n in self.rsi]
        return plain_names + (["vol_regime"] if self.regime_window else [])


def time_split(df: DataFrame, spec: Series, ratio: float) -> DataFrame:
    """Add ``train``: true for the first ``ratio`` of each series."""
    return ensure_positions(df, spec).withColumn("train", F.col(POS) < F.floor(F.col(ROWS) * F.lit(ratio)))


def enough_rows(df: DataFrame, spec: Series, minimum: int) -> DataFrame:
    """Series with at least ``minimum`` rows."""
    return df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)


def normalised_return(df: DataFrame, spec: Series, f: FeatureSet) -> DataFrame:
    """Add ``return``, ``vol`` and ``norm_return`` = return / (rolling std + 1e-8), clipped to 5, null to 0."""
    out = windowed(
        df,
        spec,
        {"return": W.pct_change(f.price)},
        {"vol": W.rolling_std("return", f.vol_bars, min_periods=3)},
    )
    ratio = clip(F.col("return") / (F.col("vol") + 1e-8), -5, 5)
    return out.withColumn("norm_return", F.coalesce(ratio, F.lit(0.0)))


def features(df: DataFrame, spec: Series, f: FeatureSet) -> DataFrame:
    """Add every feature of ``f`` in one windowed pass: SMA ratio, momentum, centred RSI, volatility regime.

    Infinite values become null, then the last known value, then 0. Nothing is written: a caller
    that reads the result several times stages it.
    """
    p = F.col(f.price)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    first = {"__move": W.diff(f.price)}
    if "return" not in df.columns:
        first["return"] = W.pct_change(f.price)
    second = {f"__sma_{n}": W.sma(f.price, n) for n in f.sma}
    second |= {f"__mom_{n}": W.pct_change(f.price, n) for n in f.momentum}
    second |= {f"rsi_{n}": W.rsi_centred("__move", n) for n in f.rsi}
    third = {f"sma_{n}": plain(clip(zero(F.try_divide(p, F.col(f"__sma_{n}")) - 1), -1, 1)) for n in f.sma}
    third |= {f"mom_{n}": plain(clip(zero(F.col(f"__mom_{n}")), -1, 1)) for n in f.momentum}
    after: tuple[dict[str, Rolling], ...] = ()
    if f.regime_window:
        second["__rv"] = W.rolling_std("return", f.regime_window)
        after = {"__rv_median": W.rolling_median("__rv", 2 * f.regime_window)}, {"vol_regime": _regime("__rv", "__rv_median")}
    fill = {n: finite_or(n) for n in f.names if n != "vol_regime"}  # the regime is 0 or 1
    out = windowed_filled(df, spec, first, second, third, fill=fill, after=after)
    helpers = [c for c in out.columns if c.startswith("__") and c not in df.columns]
    return out.withColumns({n: zero(F.col(n)) for n in f.names}).drop(*helpers)


def _regime(std: str, median: str) -> Rolling:
    return plain(F.coalesce(F.col(std) > F.col(median), F.lit(False)).cast("double"))


def volatility_regime(df: DataFrame, spec: Series, ret: str, window: int, name: str = "vol_regime") -> DataFrame:
    """1 where the rolling std is above its own rolling median over twice the window."""
    layers = {"__rv": W.rolling_std(ret, window)}, {"__med": W.rolling_median("__rv", 2 * window)}, {name: _regime("__rv", "__med")}
    return windowed(df, spec, *layers).drop("__rv", "__med")


def scaling(df: DataFrame, spec: Series, names: list[str]) -> DataFrame:
    """Mean and sample deviation (0 becomes 1e-8) of every feature, one row per series."""
    parts = []
    for n in names:
        std = F.stddev_samp(n)
        parts += [F.avg(n).alias(f"{n}__mean"), F.when(std == 0, F.lit(1e-8)).otherwise(std).alias(f"{n}__std")]
    return df.groupBy(*spec.keys).agg(*parts)


def standardise(df: DataFrame, stats: DataFrame, spec: Series, names: list[str], how: str = "inner") -> DataFrame:
    """z-scores from given statistics, clipped to 10, null to 0."""
    joined = spread_join(df, stats, list(spec.keys), how)
    z = {n: F.coalesce(clip((F.col(n) - F.col(f"{n}__mean")) / F.col(f"{n}__std"), -10, 10), F.lit(0.0)) for n in names}
    return joined.withColumns(z).drop(*[f"{n}__{s}" for n in names for s in ("mean", "std")])


def future_return(df: DataFrame, spec: Series, horizon: int, name: str = "future_norm_ret") -> DataFrame:
    """The normalised return ``horizon`` bars ahead; rows without one drop out."""
    return windowed(df, spec, {name: W.lead("norm_return", horizon)}).dropna(subset=[name])


def label_edges(df: DataFrame, spec: Series, classes: int, column: str = "future_norm_ret") -> DataFrame:
    """Interior quantile edges per series, as column ``edges``."""
    return exact_quantiles(df, list(spec.keys), column, interior_probabilities(classes)).withColumnRenamed("quantiles", "edges")


def quantile_labels(df: DataFrame, edges: DataFrame, spec: Series, column: str = "future_norm_ret") -> DataFrame:
    joined = spread_join(df, edges, list(spec.keys))
    return joined.withColumn("label", digitise(column, "edges")).drop("edges")


def score_thresholds(df: DataFrame, spec: Series, score: str, low: float = 0.10, high: float = 0.90) -> DataFrame:
    out = exact_quantiles(df, list(spec.keys), score, [low, high])
    return out.select(*spec.keys, F.element_at("quantiles", 1).alias("score_low"), F.element_at("quantiles", 2).alias("score_high"))


def scored_signals(
    df: DataFrame, thresholds: DataFrame, spec: Series, score: str, hold: bool = False, how: str = "inner"
) -> DataFrame:
    """-1, 0, 1 by the training thresholds, null without them; ``hold`` keeps a side until the opposite one."""
    out = spread_join(df, thresholds, list(spec.keys), how)
    signal = F.when(F.col("score_low").isNotNull(), threshold_signal(score, "score_low", "score_high").cast("double"))
    out = out.withColumn("signal", signal)
    out = out.drop("score_low", "score_high")
    return W.hold_until_opposite(out.withColumnRenamed("signal", "__s"), spec, "__s", "signal").drop("__s") if hold else out


def direction_features(
    df: DataFrame, spec: Series, price: str, rsi: tuple[int, ...], ema: tuple[int, ...], vol: tuple[int, ...]
) -> DataFrame:
    """RSI, exponential average and average volume for every given period (volume 0 if the table has none)."""
    out = windowed(df, spec, {"__move": W.diff(price)}, {f"RSI_{n}": W.rsi("__move", n) for n in rsi}).drop("__move")
    if "volume" in df.columns:
        out = windowed(out, spec, {f"VOL_AVG_{n}": W.sma("volume", n) for n in vol})
    else:
        out = out.withColumns({f"VOL_AVG_{n}": F.lit(0.0) for n in vol})
    for n in ema:
        out = W.ema(out, spec, price, n, f"EMA_{n}")
    return out


def impute_both_ways(df: DataFrame, spec: Series, names: list[str], causal: bool = False) -> DataFrame:
    """Fill gaps backward then forward; ``causal`` only forward, then 0."""
    if causal:
        out = running(df, spec, {n: Running("last", F.col(n)) for n in names})
        return out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})
    out = running(df, spec, {f"__{n}_b": Running("next", F.col(n)) for n in names} | {f"__{n}_f": Running("last", F.col(n)) for n in names})
    filled = {n: F.coalesce(F.col(n), F.col(f"__{n}_b"), F.col(f"__{n}_f")) for n in names}
    return out.withColumns(filled).drop(*[f"__{n}_{s}" for n in names for s in "bf"])


def over_windows(x: np.ndarray, n: int, fold) -> np.ndarray:
    """``fold`` over each full window of ``n`` values that ends at a place; missing before."""
    if len(x) < n:
        return np.full(len(x), np.nan)
    return np.append(np.full(n - 1, np.nan), fold(sliding_window_view(x, n), axis=1))


def window_means(x: np.ndarray, n: int) -> np.ndarray:
    return over_windows(x, n, np.mean)

"""Strategies: ``fit`` gives one parameter row per key, ``signals`` adds ``signal``.

Both map DataFrames to DataFrames over the series keys, so a seed, a fold or a
market is one more key. ``folds`` is the walk-forward entry: fit and signal for
a few neighbouring folds that share most of their bars.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.operators import kernels
from barspark.operators.metrics import profit_ratio
from barspark.series import BLK, POS, ROWS, Running, Series, ensure_positions, map_blocks, running, spread_join

Fold = tuple[int, int, int]  # train start, train end, out-of-sample end, relative to the first bar


@runtime_checkable
class Strategy(Protocol):
    price: str
    params: tuple[str, ...]

    def fit(self, df: DataFrame, spec: Series) -> DataFrame:
        """One row per key: the parameters and ``metric``; null parameters if nothing qualifies."""

    def signals(self, df: DataFrame, params: DataFrame, spec: Series) -> DataFrame:
        """``df`` plus ``signal`` (null where undefined)."""

    def folds(self, bars: pd.DataFrame, folds: list[Fold]) -> list[tuple[dict, float, np.ndarray]]:
        """Per fold: parameters, fit metric and the signals of its out-of-sample bars."""


def _fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _prices(df: DataFrame, spec: Series, price: str) -> DataFrame:
    return ensure_positions(df, spec).select(*spec.by(POS, ROWS), F.col(price).cast("double").alias("__p"))


def best_params(scores: DataFrame, spec: Series, params: tuple[str, ...], pf: str = "pf", valid: Column | None = None) -> DataFrame:
    """Highest score above 0; among equals the first in search order, i.e. the smallest parameters.

    A key has as many rows as the grid has points.
    """
    ok = F.col(pf) > 0
    ok = ok if valid is None else ok & valid
    top = F.max(F.when(ok, F.col(pf))).over(Window.partitionBy(*spec.keys))
    equal = F.when(ok & (F.col(pf) >= F.col("__top") * (1 - kernels.TIE)), F.struct(*params))
    best = scores.withColumn("__top", top).groupBy(*spec.keys).agg(F.min_by(F.struct(*params, F.col(pf).alias("metric")), equal).alias("__best"))
    return best.select(*spec.keys, "__best.*")


def _attach(df: DataFrame, params: DataFrame, spec: Series, names: tuple[str, ...]) -> DataFrame:
    return spread_join(df.drop(*names), params.select(*spec.by(*names)), list(spec.keys), "left")


@dataclass(frozen=True)
class MovingAverage:
    """Fits the long/flat rule over all fast < slow pairs, trades the long/short crossover."""

    price: str = "close"
    max_window: int = 99
    min_window: int = 1
    grid_block: int = 16_384
    params: tuple[str, ...] = ("fast", "slow")

    def scores(self, df: DataFrame, spec: Series) -> DataFrame:
        """Gain, loss and profit factor per key and pair: block sums first, one small shuffle after."""
        high, low, keys = self.max_window, self.min_window, list(spec.keys)
        slim = _prices(df, spec, self.price)
        schema = T.StructType(
            [*_fields(slim, *keys), *[T.StructField(n, T.LongType()) for n in self.params],
             T.StructField("gain", T.DoubleType()), T.StructField("loss", T.DoubleType())]
        )

        def kernel(block: pd.DataFrame) -> pd.DataFrame:
            price = block["__p"].to_numpy()
            up, down = kernels.split_returns(price)
            core = block["__core"].to_numpy()
            fast, slow, gain, loss = kernels.ma_block_scores(price, block[POS].to_numpy(), up, down, core, high, low)
            out = pd.DataFrame({"fast": fast, "slow": slow, "gain": gain, "loss": loss})
            return out.assign(**{k: block[k].iloc[0] for k in keys})[[*keys, *out.columns]]

        partial = map_blocks(slim, spec, kernel, schema, back=high - 1, ahead=1, size=self.grid_block)
        return _scored(partial, spec, self.params)

    def fit(self, df: DataFrame, spec: Series) -> DataFrame:
        return best_params(self.scores(df, spec), spec, self.params, valid=F.col("loss") > 0)

    def signals(self, df: DataFrame, params: DataFrame, spec: Series) -> DataFrame:
        tagged = _attach(df, params, spec, self.params)
        price = self.price
        schema = T.StructType([f for f in tagged.schema.fields if f.name != BLK] + [T.StructField("__raw", T.DoubleType())])

        def kernel(block: pd.DataFrame) -> pd.DataFrame:
            p, pos = block[price].to_numpy(float), block[POS].to_numpy()
            with np.errstate(invalid="ignore"):
                raw = np.sign(
                    kernels.average_at(p, pos, block["fast"].to_numpy(float, na_value=np.nan))
                    - kernels.average_at(p, pos, block["slow"].to_numpy(float, na_value=np.nan))
                )
            block["__raw"] = np.where(raw == 0, np.nan, raw)
            return block.loc[block["__core"], schema.names]

        marked = map_blocks(tagged, spec, kernel, schema, back=self.max_window - 1)
        return _carry(marked, spec)

    def folds(self, bars: pd.DataFrame, folds: list[Fold]):
        price = bars[self.price].to_numpy(float)
        chosen, metric = kernels.ma_fold_fits(price, folds, self.max_window, self.min_window)
        out = []
        for (start, end, stop), (fast, slow), m in zip(folds, chosen, metric, strict=True):
            out.append(({"fast": fast, "slow": slow}, m, kernels.ma_signal(price[start:stop], fast, slow)[end - start :]))
        return out

    def fit_bars(self, bars: pd.DataFrame) -> tuple:
        """Parameters from one bounded run of training bars."""
        chosen, _ = kernels.ma_fold_fits(bars[self.price].to_numpy(float), [(0, len(bars), len(bars))], self.max_window, self.min_window)
        return tuple(chosen[0])

    def signal_bars(self, bars: pd.DataFrame, params: tuple) -> np.ndarray:
        return kernels.ma_signal(bars[self.price].to_numpy(float), *params)


def _scored(partial: DataFrame, spec: Series, params: tuple[str, ...]) -> DataFrame:
    sums = partial.groupBy(*spec.by(*params)).agg(F.sum("gain").alias("gain"), F.sum("loss").alias("loss"))
    return sums.withColumn("pf", profit_ratio(F.col("gain"), F.col("loss")))


def _carry(marked: DataFrame, spec: Series) -> DataFrame:
    raw = F.when(~F.isnan("__raw"), F.col("__raw"))
    return running(marked, spec, {"signal": Running("last", raw)}).drop("__raw")


@dataclass(frozen=True)
class Donchian:
    """Fits the breakout lookback by profit factor and trades it.

    ``lossless_wins`` lets a parameter without losses win (infinite factor);
    without it such parameters are skipped.
    """

    price: str = "close"
    low: int = 2
    high: int = 168
    lossless_wins: bool = True
    grid_block: int = 65_536
    params: tuple[str, ...] = ("lookback",)

    def scores(self, df: DataFrame, spec: Series) -> DataFrame:
        keys, low, high = list(spec.keys), max(2, self.low), max(2, self.high)
        slim = _prices(df, spec, self.price)
        values = ["open_up", "open_down", "held_gain", "held_loss", "state"]
        schema = T.StructType(
            [*_fields(slim, *keys), T.StructField(BLK, T.LongType()), T.StructField("lookback", T.LongType()),
             *[T.StructField(v, T.DoubleType()) for v in values]]
        )

        def kernel(block: pd.DataFrame) -> pd.DataFrame:
            price = block["__p"].to_numpy()
            up, down = kernels.split_returns(price)
            core = block["__core"].to_numpy()
            rows = kernels.donchian_block_scores(price, block[POS].to_numpy(), up, down, core, low, high)
            out = pd.DataFrame(rows, columns=["lookback", *values]).assign(**{BLK: block[BLK].iloc[0]})
            return out.assign(**{k: block[k].iloc[0] for k in keys})[[*keys, BLK, "lookback", *values]]

        partial = map_blocks(slim, spec, kernel, schema, back=high - 1, ahead=1, size=self.grid_block)
        state = F.when(~F.isnan("state"), F.col("state"))
        before = Window.partitionBy(*spec.by("lookback")).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
        carried = partial.withColumn("__carry", F.last(state, ignorenulls=True).over(before))
        long, short = F.col("__carry") > 0, F.col("__carry") < 0
        opened = lambda a, b: F.when(long, F.col(a)).when(short, F.col(b)).otherwise(F.lit(0.0))
        sums = carried.select(
            *spec.by("lookback"),
            (F.col("held_gain") + opened("open_up", "open_down")).alias("gain"),
            (F.col("held_loss") + opened("open_down", "open_up")).alias("loss"),
        )
        return _scored(sums, spec, self.params)

    def fit(self, df: DataFrame, spec: Series) -> DataFrame:
        valid = None if self.lossless_wins else F.col("loss") > 0
        return best_params(self.scores(df, spec), spec, self.params, valid=valid)

    def signals(self, df: DataFrame, params: DataFrame, spec: Series) -> DataFrame:
        tagged = _attach(df, params, spec, self.params)
        price = self.price
        schema = T.StructType([f for f in tagged.schema.fields if f.name != BLK] + [T.StructField("__raw", T.DoubleType())])

        def kernel(block: pd.DataFrame) -> pd.DataFrame:
            lookback = block["lookback"].to_numpy(float, na_value=np.nan)
            block["__raw"] = kernels.donchian_raw_at(block[price].to_numpy(float), block[POS].to_numpy(), lookback)
            return block.loc[block["__core"], schema.names]

        return _carry(map_blocks(tagged, spec, kernel, schema, back=max(2, self.high) - 1), spec)

    def folds(self, bars: pd.DataFrame, folds: list[Fold]):
        price = bars[self.price].to_numpy(float)
        chosen, metric = kernels.donchian_fold_fits(
            price, folds, max(2, self.low), max(2, self.high), np.inf if self.lossless_wins else 0.0
        )
        out = []
        for (start, end, stop), lookback, m in zip(folds, chosen, metric, strict=True):
            out.append(({"lookback": lookback}, m, kernels.donchian_signal(price[start:stop], lookback)[end - start :]))
        return out

    def fit_bars(self, bars: pd.DataFrame) -> float:
        """The lookback from one bounded run of training bars."""
        best = np.inf if self.lossless_wins else 0.0
        chosen, _ = kernels.donchian_fold_fits(bars[self.price].to_numpy(float), [(0, len(bars), len(bars))], max(2, self.low), max(2, self.high), best)
        return chosen[0]

    def signal_bars(self, bars: pd.DataFrame, params: float) -> np.ndarray:
        return kernels.donchian_signal(bars[self.price].to_numpy(float), params)


@dataclass(frozen=True)
class PandasStrategy:
    """A user's own pandas strategy: ``optimise(train) -> (params, metric)``, ``generate(context, params) -> series of signals``.

    Walk-forward and streams call it on folds. In sample, a series is one call, so a
    series of more than ``most`` bars is refused rather than gathered in one task.
    ``params`` names the parameters, which are numbers.
    """

    optimise: Callable[[pd.DataFrame], tuple[dict, float]]
    generate: Callable[[pd.DataFrame, dict], np.ndarray]
    params: tuple[str, ...] = ()
    price: str = "close"
    most: int = 2_000_000

    def _bounded(self, df: DataFrame, spec: Series) -> DataFrame:
        rows = ensure_positions(df, spec)
        fits = F.when(F.col(ROWS) <= self.most, F.col(ROWS)).otherwise(F.raise_error(F.concat(F.lit(f"a series of more than {self.most} bars in sample: "), F.col(ROWS))))
        return rows.withColumn(ROWS, fits.cast("long"))

    def fit(self, df: DataFrame, spec: Series) -> DataFrame:
        rows, keys = self._bounded(df, spec), list(spec.keys)
        out = T.StructType([*_fields(rows, *keys), *[T.StructField(n, T.DoubleType()) for n in (*self.params, "metric")]])

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            params, metric = self.optimise(frame.sort_values(POS, kind="stable").reset_index(drop=True))
            return pd.DataFrame([{**{k: frame[k].iloc[0] for k in keys}, **{p: float(params[p]) for p in self.params}, "metric": float(metric)}])

        return rows.groupBy(*keys).applyInPandas(run, out)

    def signals(self, df: DataFrame, params: DataFrame, spec: Series) -> DataFrame:
        rows = _attach(self._bounded(df, spec).drop(BLK, "signal"), params, spec, self.params)
        out = T.StructType([*[f for f in rows.schema.fields if f.name not in self.params], T.StructField("signal", T.DoubleType())])

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            bars = frame.sort_values(POS, kind="stable").reset_index(drop=True)
            own = {p: bars[p].iloc[0] for p in self.params}
            return bars.assign(signal=np.asarray(self.generate(bars, own), float))[out.names]

        done = rows.groupBy(*spec.keys).applyInPandas(run, out)
        return done.withColumn("signal", F.when(~F.isnan("signal"), F.col("signal")))

    def folds(self, bars: pd.DataFrame, folds: list[Fold]):
        out = []
        for start, end, stop in folds:
            params, metric = self.optimise(bars.iloc[start:end])
            signal = np.asarray(self.generate(bars.iloc[start:stop], params), dtype=float)
            out.append((params, metric, signal[end - start :]))
        return out

    def fit_bars(self, bars: pd.DataFrame) -> dict:
        return self.optimise(bars)[0]

    def signal_bars(self, bars: pd.DataFrame, params: dict) -> np.ndarray:
        return np.asarray(self.generate(bars, params), float)


def fit_and_signal(strategy: Strategy, df: DataFrame, spec: Series, params: DataFrame | None = None) -> DataFrame:
    """Signals from given parameters, or from parameters fitted on the same rows."""
    return strategy.signals(df, strategy.fit(df, spec) if params is None else params, spec)

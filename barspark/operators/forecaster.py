"""A strategy that forecasts the quantile of the future return and trades the extremes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.operators import features as X
from barspark.operators import networks as N
from barspark.series import BLK, POS, ROWS, Series, positions, stage, with_blocks


@dataclass(frozen=True)
class Forecaster:
    """One network per series classifies the future normalised return; its extreme preference is traded.

    Statistics, label edges and score thresholds come from the first ``ratio`` of a series;
    the rest serves to stop training early. Features of each part are built from that
    part alone. ``metric`` is 1 by definition: what the fit is worth shows out of sample.
    """

    features: X.FeatureSet = field(default_factory=X.FeatureSet)
    training: N.Training = field(default_factory=N.Training)
    ratio: float = 0.8
    low: float = 0.10
    high: float = 0.90
    hold: bool = False
    params: tuple[str, ...] = ("network", "means", "deviations", "score_low", "score_high")
    #: Parameters that are single numbers: those that a walk-forward table carries per bar.
    fold_params: tuple[str, ...] = ("score_low", "score_high")

    @property
    def price(self) -> str:
        return self.features.price

    def labelled(self, df: DataFrame, spec: Series) -> tuple[DataFrame, DataFrame]:
        """(rows with ``x``, ``label`` and ``train``; statistics and edges per series)."""
        own, names, keys = spec.extend("train"), self.features.names, list(spec.keys)
        rows = X.time_split(df, spec, self.ratio).select(*own.by(spec.ts, self.price), F.col(POS).alias("place"), F.col(ROWS).alias("whole"))
        built = stage(X.features(X.normalised_return(positions(rows, own), own, self.features), own, self.features))
        stats = X.scaling(built.filter("train"), spec, names)
        ahead = stage(X.future_return(built, own, self.features.horizon_bars))
        edges = X.label_edges(ahead.filter("train"), spec, self.training.classes)
        known = stage(stats.join(edges, keys))
        scaled = X.quantile_labels(X.standardise(ahead, known.drop("edges"), spec, names), known.select(*keys, "edges"), spec)
        slim = scaled.select(*own.by("place", "whole", "label"), F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
        return stage(slim), known

    def fit(self, df: DataFrame, spec: Series) -> DataFrame:
        keys, names = list(spec.keys), self.features.names
        rows, known = self.labelled(df, spec)
        networks = stage(N.fit_networks(rows, keys, len(names), self.training, spec.block))
        sizes = F.floor(F.col("place") / F.lit(spec.block)).cast("long")
        trained = rows.filter("train").select(*keys, sizes.alias(BLK), "x")
        scored = self._scored(trained, networks, spec, T.StructType([rows.schema[k] for k in keys]))
        thresholds = X.score_thresholds(stage(scored.select(*keys, "score")), spec, "score", self.low, self.high)
        stats = [F.array(*[F.col(f"{n}__{s}") for n in names]).alias(c) for c, s in (("means", "mean"), ("deviations", "std"))]
        fitted = known.select(*keys, *stats).join(networks, keys, "left").join(thresholds, keys, "left")
        return fitted.withColumn("metric", F.when(F.col("network").isNotNull(), F.lit(1.0))).select(*keys, *self.params, "metric")

    def _scored(self, rows: DataFrame, params: DataFrame, spec: Series, kept: T.StructType) -> DataFrame:
        """``kept`` columns of rows (keys, blk, x) and their ``score``: a block meets its key's network once."""
        t, width = self.training, len(self.features.names)
        by = spec.by(BLK)
        per_block = rows.select(*by).distinct().join(params.select(*spec.keys, "network"), list(spec.keys))
        owners = per_block.select(*[F.col(c).alias(f"owner_{i}") for i, c in enumerate(by)], "network")
        schema = T.StructType([*kept.fields, T.StructField("score", T.DoubleType())])

        def run(block: pa.Table, owner: pa.Table) -> pa.Table:
            out = block.select(kept.names)
            score = pa.nulls(block.num_rows, pa.float64())
            if owner.num_rows and block.num_rows and owner.column("network")[0].is_valid:
                x = np.array(block.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
                score = pa.array(preference(np.array(owner.column("network")[0].as_py()), x, t))
            return out.append_column("score", score)

        return rows.groupBy(*by).cogroup(owners.groupBy(*owners.columns[:-1])).applyInArrow(run, schema)

    def signals(self, df: DataFrame, params: DataFrame, spec: Series) -> DataFrame:
        names, keys = self.features.names, list(spec.keys)
        taken = [c for c in df.columns if c not in (POS, ROWS, BLK, "score", "signal", *self.params)]
        built = X.features(X.normalised_return(df.select(*taken, *[c for c in (POS, ROWS) if c in df.columns]), spec, self.features), spec, self.features)
        rows = stage(with_blocks(built, spec))
        known = params.select(*keys, *[F.col(c)[i].alias(f"{n}__{s}") for c, s in (("means", "mean"), ("deviations", "std")) for i, n in enumerate(names)])
        scaled = X.standardise(rows, known, spec, names, "left")
        scaled = scaled.select(*taken, POS, ROWS, BLK, F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
        kept = T.StructType([scaled.schema[c] for c in (*taken, POS, ROWS, BLK)])
        scored = self._scored(scaled, params, spec, kept)
        return X.scored_signals(scored, params.select(*keys, "score_low", "score_high"), spec, "score", self.hold, "left")

    def folds(self, bars, folds):
        """Walk-forward entry: features once over the bars, then per fold its own warm-ups, statistics, network and thresholds."""
        shared = Features(bars[self.price].to_numpy(float), self.features)
        out = []
        for start, end, stop in folds:
            fitted = self._fitted(shared, start, end)
            signal = self._signals(fitted, shared, start, stop)[end - start :]
            low, high = (fitted["low"], fitted["high"]) if fitted else (np.nan, np.nan)
            out.append(({"score_low": low, "score_high": high}, 1.0 if fitted else np.nan, signal))
        return out

    def fit_bars(self, bars) -> dict | None:
        """Everything fitted on one bounded run of training bars."""
        return self._fitted(Features(bars[self.price].to_numpy(float), self.features), 0, len(bars))

    def signal_bars(self, bars, params: dict | None) -> np.ndarray:
        return self._signals(params, Features(bars[self.price].to_numpy(float), self.features), 0, len(bars))

    def _fitted(self, shared: Features, start: int, end: int) -> dict | None:
        cut, ahead, t = start + int((end - start) * self.ratio), self.features.horizon_bars, self.training
        (x, norm), (vx, vnorm) = shared.part(start, cut), shared.part(cut, end)
        if len(norm) <= ahead or len(x) < 2:
            return None
        fitted = {"mean": x.mean(axis=0), "deviation": x.std(axis=0, ddof=1)}
        fitted["deviation"][fitted["deviation"] == 0] = 1e-8
        edges = np.quantile(norm[ahead:], np.arange(1, t.classes) / t.classes)
        tx, vx = (_scaled(a[: max(0, len(a) - ahead)], fitted) for a in (x, vx))
        label, vlabel = (np.searchsorted(edges, a[ahead:], "right") for a in (norm, vnorm))
        fitted["network"] = N.train(tx, label, vx, vlabel, t)
        fitted["low"], fitted["high"] = np.quantile(preference(fitted["network"], tx, t), [self.low, self.high])
        return fitted

    def _signals(self, fitted: dict | None, shared: Features, start: int, stop: int) -> np.ndarray:
        if fitted is None:
            return np.full(stop - start, np.nan)
        score = preference(fitted["network"], _scaled(shared.part(start, stop)[0], fitted), self.training)
        signal = np.where(score < fitted["low"], -1.0, np.where(score > fitted["high"], 1.0, 0.0))
        if self.hold:
            last = np.maximum.accumulate(np.where(signal != 0, np.arange(len(signal)), -1))
            signal = np.where(last >= 0, signal[last], 0.0)
        return signal


def _scaled(x: np.ndarray, fitted: dict) -> np.ndarray:
    return np.clip((x - fitted["mean"]) / fitted["deviation"], -10, 10)


def preference(w: np.ndarray, x: np.ndarray, t: N.Training) -> np.ndarray:
    """(two highest classes) - (two lowest classes)."""
    p = N.probabilities(w, x, t)
    return p[:, -2] + p[:, -1] - (p[:, 0] + p[:, 1])


class Features:
    """Features of a run of bars that any stretch of it can take as if the stretch began with its first bar.

    A window that reaches back over the first bar of a stretch is a warm-up there: its
    feature is 0. So all stretches share one computation, and only their first values differ.
    """

    def __init__(self, price: np.ndarray, f: X.FeatureSet) -> None:
        self.f = f
        with np.errstate(all="ignore"):
            move = np.diff(price, prepend=np.nan)
            self.change = np.append(np.nan, price[1:] / price[:-1] - 1)
            columns, self.warm = [], []
            for n in f.sma:
                columns.append(price / X.over_windows(price, n, np.mean) - 1)
                self.warm.append(n - 1)
            for n in f.momentum:
                columns.append(np.append(np.full(min(n, len(price)), np.nan), price[n:] / price[:-n] - 1))
                self.warm.append(n)
            columns = [np.clip(c, -1, 1) for c in columns]
            for n in f.rsi:
                up, down = X.over_windows(np.maximum(move, 0), n, np.mean), X.over_windows(np.maximum(-move, 0), n, np.mean)
                columns.append((50 - 100 / (1 + up / (down + 1e-8))) / 50)
                self.warm.append(n)
            if f.regime_window:
                n = f.regime_window
                spread = X.over_windows(self.change, n, _sample)
                columns.append(np.where(np.isnan(spread), 0.0, spread > X.over_windows(spread, 2 * n, np.median)))
                self.warm.append(3 * n - 1)
            self.spread = X.over_windows(self.change, f.vol_bars, _sample)
            self.columns = np.column_stack(columns)

    def part(self, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(features, normalised returns) of the bars from ``first`` up to ``stop``."""
        x = self.columns[first:stop].copy()
        for j, n in enumerate(self.warm):
            x[:n, j] = 0.0
        x[np.isnan(x)] = 0.0
        for j in np.flatnonzero(np.isinf(x).any(axis=0)):
            last = np.maximum.accumulate(np.where(np.isinf(x[:, j]), -1, np.arange(len(x))))
            x[:, j] = np.where(last >= 0, x[last, j], 0.0)
        change, spread = self.change[first:stop].copy(), self.spread[first:stop].copy()
        change[:1] = np.nan
        for i in range(min(self.f.vol_bars, len(spread))):
            spread[i] = np.std(change[1 : i + 1], ddof=1) if i >= 3 else np.nan
        with np.errstate(all="ignore"):
            norm = np.clip(change / (spread + 1e-8), -5, 5)
        return x, np.where(np.isnan(norm), 0.0, norm)


def _sample(a: np.ndarray, axis: int) -> np.ndarray:
    return np.std(a, axis=axis, ddof=1)


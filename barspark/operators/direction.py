"""A strategy that is long when a logistic regression predicts a rise.

Every combination of indicator periods is a regression of its own, yet a bar is kept
once, with all indicators in one row. Bars lie packed in blocks of bounded size; a block
adds up what a pass needs for all combinations together (moments, then gradient and
curvature at the present weights, then gain and loss of the rest of the series), the
sums of a series' blocks meet in one small shuffle, and one small system per combination
is solved. A series of one block is fitted to the end in its own task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.functions.scalars import up_label
from barspark.operators import features as X
from barspark.operators import windows as W
from barspark.operators.models import STRIDE
from barspark.series import BLK, POS, ROWS, Series, positions, spread_join, stage, windowed

DOUBLES = T.ArrayType(T.DoubleType())


def _held(out: np.ndarray) -> np.ndarray:
    """The upper triangle of a curvature, row by row."""
    return out[np.triu_indices(len(out))]


def derivatives(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gradient and upper triangle of the curvature of the log loss at weights ``b`` (intercept first)."""
    z = np.clip(x @ b[1:] + b[0], -700, 700)
    p = 1 / (1 + np.exp(-z))
    wide = np.column_stack([np.ones(len(x)), x])
    return np.concatenate([wide.T @ (p - y), _held((wide * (p * (1 - p))[:, None]).T @ wide)])


def newton_step(sums: np.ndarray, b: np.ndarray, unit: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """(new weights, largest move relative to their size) from summed derivatives; ``unit``: deviations of the features.

    The penalty is on the weights of the raw features; the intercept is free.
    """
    size = len(b)
    penalty = np.concatenate([[0.0], l2 / unit**2])
    curve = np.zeros((size, size))
    curve[np.triu_indices(size)] = sums[size:]
    curve = curve + np.triu(curve, 1).T
    step = np.linalg.lstsq(curve + np.diag(penalty + 1e-12), sums[:size] + penalty * b, rcond=None)[0]
    step *= min(1.0, STRIDE / max(float(np.abs(step).max()), 1e-300))
    return b - step, float(np.abs(step).max()) / max(1.0, float(np.abs(b).max()))


@dataclass(frozen=True)
class DirectionClassifier:
    """Long when RSI, exponential average and average volume predict a rise, else flat.

    Every combination of periods is fitted on the first ``ratio`` of a series and judged
    by profit factor on the rest; each part computes its own features. A combination
    needs ``minimum`` complete training rows. A fit that has not settled after
    ``max_passes`` is used like others; ``converged`` tells it.
    """

    price: str = "close"
    rsi: tuple[int, ...] = (14, 21, 28)
    ema: tuple[int, ...] = (20, 50, 100)
    vol: tuple[int, ...] = (10, 20, 50)
    ratio: float = 0.7
    minimum: int = 100
    causal: bool = False
    l2: float = 1.0
    max_passes: int = 1000
    tolerance: float = 1e-9
    params: tuple[str, ...] = ("rsi_period", "ema_period", "vol_period", "coef", "intercept")
    #: Parameters that are single numbers: those that a walk-forward table carries per bar.
    fold_params: tuple[str, ...] = ("rsi_period", "ema_period", "vol_period", "intercept")

    @property
    def names(self) -> list[str]:
        return [f"RSI_{n}" for n in self.rsi] + [f"EMA_{n}" for n in self.ema] + [f"VOL_AVG_{n}" for n in self.vol]

    @property
    def points(self) -> list[tuple[int, int, int]]:
        """Columns of each combination, in the order of the search."""
        a, b = len(self.rsi), len(self.rsi) + len(self.ema)
        return [(i, a + j, b + k) for i, j, k in product(range(a), range(len(self.ema)), range(len(self.vol)))]

    @property
    def periods(self) -> list[tuple[int, int, int]]:
        return list(product(self.rsi, self.ema, self.vol))

    # One combination on rows that one task holds

    def _complete(self, x: np.ndarray, point: tuple[int, int, int]) -> np.ndarray:
        return ~np.isnan(x[:, point]).any(axis=1)

    def _moments(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = x.std(axis=0)
        return x.mean(axis=0), np.where(unit > 0, unit, 1.0)

    def _solve(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, bool]:
        """(weights of the raw features, intercept, settled)."""
        mean, unit = self._moments(x)
        scaled, b, move = (x - mean) / unit, np.zeros(4), np.inf
        for _ in range(self.max_passes):
            b, move = newton_step(derivatives(scaled, y, b), b, unit, self.l2)
            if move <= self.tolerance:
                break
        return b[1:] / unit, float(b[0] - (b[1:] / unit) @ mean), move <= self.tolerance

    def _earned(self, x: np.ndarray, r: np.ndarray, coef: np.ndarray, intercept: float) -> tuple[float, float]:
        """Gain and loss of the rows that are long; ``x`` is complete."""
        earned = np.where(x @ coef + intercept > 0, np.nan_to_num(r), 0.0)
        return float(earned[earned > 0].sum()), float(-earned[earned < 0].sum())

    def _search(self, x: np.ndarray, y: np.ndarray, tx: np.ndarray, tr: np.ndarray) -> list[tuple]:
        """(point, coef, intercept, converged, gain, loss) of every combination with enough rows."""
        out = []
        for number, point in enumerate(self.points):
            mine = self._complete(x, point)
            if mine.sum() < max(1, self.minimum):
                continue
            judged = self._complete(tx, point)
            if not judged.any():
                continue
            coef, intercept, settled = self._solve(x[mine][:, point], y[mine])
            out.append((number, coef.tolist(), intercept, settled, *self._earned(tx[judged][:, point], tr[judged], coef, intercept)))
        return out

    # On Spark

    def fit(self, df: DataFrame, spec: Series) -> DataFrame:
        keys, own = list(spec.keys), spec.extend("train")
        rows = windowed(df, spec, {"r": W.forward_log_return(self.price)})
        rows = X.time_split(rows, spec, self.ratio).withColumn("y", up_label("r"))
        volume = ["volume"] if "volume" in df.columns else []
        rows = rows.select(*own.by(spec.ts, self.price, *volume, "r", "y"), F.col(POS).alias("place"), F.col(ROWS).alias("whole"))
        built = X.direction_features(positions(rows, own), own, self.price, self.rsi, self.ema, self.vol)
        block = F.floor(F.col("place") / F.lit(spec.block)).cast("long")
        slim = stage(built.select(*keys, block.alias(BLK), "place", "whole", "train", "y", "r", F.array(*[F.col(n).cast("double") for n in self.names]).alias("x")))
        fields = [slim.schema[k] for k in keys]
        found = T.ArrayType(T.StructType([
            T.StructField("point", T.LongType()), T.StructField("coef", DOUBLES), T.StructField("intercept", T.DoubleType()),
            T.StructField("converged", T.BooleanType()), T.StructField("gain", T.DoubleType()), T.StructField("loss", T.DoubleType()),
        ]))
        packs = ["x", "y", "tx", "tr"]
        schema = T.StructType([*fields, T.StructField("found", found), *[T.StructField(p, T.BinaryType()) for p in packs]])
        width = len(self.names)

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by([("place", "ascending")]).combine_chunks()
            x = np.array(table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
            train = table.column("train").to_numpy(zero_copy_only=False).astype(bool)
            y, r = table.column("y").to_numpy().astype(float), table.column("r").to_numpy(zero_copy_only=False).astype(float)
            parts = [x[train], y[train], x[~train], r[~train]]
            alone = table.column("whole")[0].as_py() <= spec.block
            results = [dict(zip(found.elementType.names, f)) for f in self._search(*parts)] if alone else None
            head = [table.column(k).slice(0, 1) for k in keys]
            return pa.table([*head, pa.array([results], _arrow(found)), *[pa.array([None if alone else p.tobytes()], pa.binary()) for p in parts]], schema.names)

        done = stage(slim.groupBy(*keys, BLK).applyInArrow(pack, schema))
        scores = done.select(*keys, F.inline("found"))
        blocks = done.filter(F.col("x").isNotNull()).select(*keys, *packs)
        if not blocks.isEmpty():
            scores = scores.unionByName(self._in_passes(blocks, keys))
        return self._chosen(scores, keys)

    def _chosen(self, scores: DataFrame, keys: list[str]) -> DataFrame:
        gain, loss = F.col("gain"), F.col("loss")
        factor = F.when(loss > 0, gain / loss).when(gain > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
        at = F.col("point").cast("int") + 1
        tried = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(self.params, p)]) for p in self.periods])
        named = scores.withColumn("metric", factor).withColumn("tried", F.element_at(tried, at)).select(*keys, "point", "tried.*", "coef", "intercept", "converged", "metric")
        best = F.max_by(F.struct(*self.params, "metric", "converged"), F.struct("metric", -F.col("point"))).alias("best")
        return named.groupBy(*keys).agg(best).select(*keys, "best.*")

    def _in_passes(self, blocks: DataFrame, keys: list[str]) -> DataFrame:
        """Scores of series with several blocks: one pass per sum that all blocks must add to."""
        fields, width, count = [blocks.schema[k] for k in keys], len(self.names), len(self.points)
        step = T.StructType([*fields, T.StructField("sums", DOUBLES)])

        def passed(state: DataFrame | None, made) -> DataFrame:
            """Elementwise sums over a key's blocks of what ``made(x, y, tx, tr, state)`` gives."""
            informed = state is not None

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        x, y, tx, tr = (np.frombuffer(batch.column(c)[i].as_py()) for c in ("x", "y", "tx", "tr"))
                        known = np.array(batch.column("state")[i].as_py()) if informed else None
                        sums = made(x.reshape(-1, width), y, tx.reshape(-1, width), tr, known)
                        yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, 1) for k in keys], pa.array([sums.tolist()], pa.list_(pa.float64()))], step.names)

            each = (blocks if state is None else blocks.join(state, keys)).mapInArrow(run, step)
            numbers = each.select(*keys, F.posexplode("sums").alias("at", "v")).groupBy(*keys, "at").agg(F.sum("v").alias("v"))
            return stage(numbers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("all")).select(*keys, F.col("all.v").alias("state")))

        def solved(sums: DataFrame, made) -> DataFrame:
            """One row per key: ``made`` of the key's sums."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    out = [made(*[np.array(batch.column(c)[i].as_py()) for c in batch.schema.names if c not in keys]).tolist() for i in range(batch.num_rows)]
                    yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(out, pa.list_(pa.float64()))], [*keys, "state"])

            return stage(sums.mapInArrow(run, T.StructType([*fields, T.StructField("state", DOUBLES)])))

        complete, points = self._complete, self.points

        def totals(x, y, tx, tr, _):
            return np.concatenate([np.append(complete(x, p).sum(), x[complete(x, p)][:, p].sum(axis=0)) for p in points])

        def spreads(x, y, tx, tr, known):
            known = known.reshape(count, 4)
            return np.concatenate([((x[complete(x, p)][:, p] - k[1:] / max(k[0], 1)) ** 2).sum(axis=0) for p, k in zip(points, known)])

        def start(first, second):
            first, second = first.reshape(count, 4), second.reshape(count, 3)
            rows = np.maximum(first[:, :1], 1)
            unit = np.sqrt(second / rows)
            # per point: rows, means, deviations, weights, last move
            return np.hstack([first[:, :1], first[:, 1:] / rows, np.where(unit > 0, unit, 1.0), np.zeros((count, 4)), np.full((count, 1), np.inf)]).ravel()

        def slopes(x, y, tx, tr, known):
            out = []
            for p, k in zip(points, known.reshape(count, 12)):
                if k[0] < max(1, self.minimum) or k[11] <= self.tolerance:
                    out.append(np.zeros(14))
                    continue
                mine = complete(x, p)
                out.append(derivatives((x[mine][:, p] - k[1:4]) / k[4:7], y[mine], k[7:11]))
            return np.concatenate(out)

        def moved(known, sums):
            known = known.reshape(count, 12).copy()
            for k, s in zip(known, sums.reshape(count, 14)):
                if k[0] >= max(1, self.minimum) and k[11] > self.tolerance:
                    k[7:11], k[11] = newton_step(s, k[7:11], k[4:7], self.l2)
            return known.ravel()

        def raw(k):
            coef = k[8:11] / k[4:7]
            return coef, float(k[7] - coef @ k[1:4])

        def earned(x, y, tx, tr, known):
            out = []
            for p, k in zip(points, known.reshape(count, 12)):
                judged = complete(tx, p)
                out.append([judged.sum(), *self._earned(tx[judged][:, p], tr[judged], *raw(k))])
            return np.ravel(out)

        sums = passed(None, totals)
        state = solved(sums.join(passed(sums, spreads).withColumnRenamed("state", "second"), keys), start)
        for _ in range(self.max_passes):
            state = solved(state.join(passed(state, slopes).withColumnRenamed("state", "sums"), keys), moved)
            todo = F.exists(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (F.get("state", i * 12) >= max(1, self.minimum)) & (F.get("state", i * 12 + 11) > self.tolerance))
            if state.filter(todo).isEmpty():
                break
        told = passed(state, earned).withColumnRenamed("state", "earned")

        def report(known, earnings):
            rows = []
            for number, (k, e) in enumerate(zip(known.reshape(count, 12), earnings.reshape(count, 3))):
                coef, intercept = raw(k)
                rows.append([number, *coef, intercept, k[11] <= self.tolerance, *e[1:], k[0] >= max(1, self.minimum) and e[0] > 0])
            return np.ravel(rows)

        flat = solved(state.join(told, keys), report).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"), "state")
        at = lambda j: F.get("state", F.col("i") * 9 + j)
        return flat.filter(at(8) == 1).select(
            *keys, F.col("i").cast("long").alias("point"), F.array(at(1), at(2), at(3)).alias("coef"), at(4).alias("intercept"),
            (at(5) == 1).alias("converged"), at(6).alias("gain"), at(7).alias("loss"),
        )

    def signals(self, df: DataFrame, params: DataFrame, spec: Series) -> DataFrame:
        built = X.direction_features(df, spec, self.price, self.rsi, self.ema, self.vol)
        out = X.impute_both_ways(built, spec, self.names, self.causal)
        out = spread_join(out, params.select(*spec.by(*self.params)), list(spec.keys), "left")
        chosen = []
        for stem, periods, param in (("RSI", self.rsi, "rsi_period"), ("EMA", self.ema, "ema_period"), ("VOL_AVG", self.vol, "vol_period")):
            chosen.append(F.coalesce(*[F.when(F.col(param) == n, F.col(f"{stem}_{n}")) for n in periods]))
        z = sum((F.col("coef")[i] * c for i, c in enumerate(chosen)), F.col("intercept"))
        signal = (1 / (1 + F.exp(-z)) > 0.5).cast("double")
        return out.withColumn("signal", signal).drop(*self.names, *self.params)

    # Walk-forward: neighbouring folds share their bars in one task

    def folds(self, bars: pd.DataFrame, folds):
        price, volume = self._columns(bars)
        out = []
        for start, end, stop in folds:
            fitted = self._fitted(price, volume, start, end)
            signal = self._signals(fitted, price, volume, start, stop)[end - start :]
            params = dict.fromkeys(self.fold_params, np.nan)
            if fitted:
                params |= dict(zip(self.fold_params[:3], map(float, self.periods[fitted["point"]]))) | {"intercept": fitted["intercept"]}
            out.append((params, fitted["metric"] if fitted else np.nan, signal))
        return out

    def fit_bars(self, bars: pd.DataFrame) -> dict | None:
        """Everything fitted on one bounded run of training bars."""
        return self._fitted(*self._columns(bars), 0, len(bars))

    def signal_bars(self, bars: pd.DataFrame, params: dict | None) -> np.ndarray:
        return self._signals(params, *self._columns(bars), 0, len(bars))

    def _columns(self, bars: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
        return bars[self.price].astype(float).to_numpy(), bars["volume"].astype(float).to_numpy() if "volume" in bars else None

    def _fitted(self, price: np.ndarray, volume: np.ndarray | None, start: int, end: int) -> dict | None:
        cut = start + int((end - start) * self.ratio)
        with np.errstate(all="ignore"):
            r = np.append(np.diff(np.log(price[start:end])), np.nan)
        x, tx = self._part(price, volume, start, cut), self._part(price, volume, cut, end)
        scores = self._search(x, (r[: cut - start] > 0).astype(float), tx, r[cut - start :])
        if not scores:
            return None
        factors = [gain / loss if loss > 0 else (np.inf if gain > 0 else 0.0) for *_, gain, loss in scores]
        number, coef, intercept, *_ = scores[int(np.argmax(factors))]
        return {"point": number, "coef": np.array(coef), "intercept": intercept, "metric": float(max(factors))}

    def _signals(self, fitted: dict | None, price: np.ndarray, volume: np.ndarray | None, start: int, stop: int) -> np.ndarray:
        if fitted is None:
            return np.full(stop - start, np.nan)
        x = _imputed(self._part(price, volume, start, stop)[:, self.points[fitted["point"]]], self.causal)
        with np.errstate(over="ignore"):
            chance = 1 / (1 + np.exp(-(x @ fitted["coef"] + fitted["intercept"])))
        return np.where(np.isnan(chance), np.nan, (chance > 0.5).astype(float))

    def _part(self, price: np.ndarray, volume: np.ndarray | None, first: int, stop: int) -> np.ndarray:
        """All indicators of a stretch, built from that stretch alone; missing in warm-ups."""
        p = pd.Series(price[first:stop])
        columns = []
        move = np.diff(price[first:stop], prepend=np.nan)
        with np.errstate(all="ignore"):
            for n in self.rsi:
                up, down = X.window_means(np.maximum(move, 0), n), X.window_means(np.maximum(-move, 0), n)
                columns.append(np.where((down == 0) & (up > 0), 100.0, 100 - 100 / (1 + np.where(down == 0, np.nan, up / down))))
        columns += [p.ewm(span=n, adjust=False).mean().to_numpy() for n in self.ema]
        columns += [np.zeros(len(p)) if volume is None else X.window_means(volume[first:stop], n) for n in self.vol]
        return np.column_stack(columns) if len(p) else np.zeros((0, len(self.names)))


def _imputed(x: np.ndarray, causal: bool) -> np.ndarray:
    """Gaps filled from behind, then from before; ``causal``: only forward, then 0."""
    frame = pd.DataFrame(x)
    return (frame.ffill().fillna(0.0) if causal else frame.bfill().ffill()).to_numpy()


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)

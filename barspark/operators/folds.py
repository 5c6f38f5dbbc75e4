"""Walk-forward folds: train ``length`` bars, step ``step`` bars, in time order.

Fold k trains on [k*step, k*step + length) and is judged on the ``step`` bars
that follow; the out-of-sample stretches tile [length, n) exactly once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.operators import kernels
from barspark.series import BLK, POS, ROWS, Series, ensure_positions, map_blocks, positions, spread_join, stage


def fold_count(length: int, step: int) -> Column:
    """ceil((n - length) / step), at least 0."""
    return F.greatest(F.lit(0), F.ceil((F.col(ROWS) - length) / step))


def fold_rows(df: DataFrame, spec: Series, length: int, step: int, part: str = "train") -> DataFrame:
    """Range join of bars and folds by arithmetic: one row per bar and fold that uses it.

    ``part`` is ``train``, ``oos`` or ``context`` (train and out-of-sample).
    """
    rows = ensure_positions(df, spec)
    last = fold_count(length, step) - 1
    pos = F.col(POS)
    if part == "oos":
        fold = F.floor((pos - length) / step)
        return rows.filter(pos >= length).withColumn("fold", fold)
    reach = length if part == "train" else length + step
    low = F.greatest(F.lit(0), F.floor((pos - reach) / step) + 1)
    high = F.least(last, F.floor(pos / step))
    return rows.filter(low <= high).withColumn("fold", F.explode(F.sequence(low, high)))


def lead_in(df: DataFrame, spec: Series, start: str, end: str, bars: int) -> DataFrame:
    """[start, end) plus the ``bars`` rows before start, counted in rows. Positions restart at 0."""
    rows = ensure_positions(df.filter(F.col(spec.ts) < F.lit(end).cast("timestamp_ntz")), spec)
    before = F.count_if(F.col(spec.ts) < F.lit(start).cast("timestamp_ntz"))
    cut = rows.groupBy(*spec.keys).agg(
        F.greatest(F.lit(0), before - bars).alias("__cut"), F.count(F.lit(1)).alias("__kept")
    )
    kept = spread_join(rows, cut, list(spec.keys)).filter(F.col(POS) >= F.col("__cut"))
    return kept.withColumns({POS: F.col(POS) - F.col("__cut"), ROWS: F.col("__kept") - F.col("__cut")}).drop(
        "__cut", "__kept", BLK
    )


def fold_report(df: DataFrame, spec: Series, length: int, step: int) -> DataFrame:
    """Folds per series, and whether none can run."""
    counts = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias(ROWS))
    return counts.select(
        *spec.keys,
        F.col(ROWS).alias("bars"),
        fold_count(length, step).alias("folds"),
        (fold_count(length, step) == 0).alias("no_fold_ran"),
    )


def walk_forward_signals(
    df: DataFrame, spec: Series, strategy, length: int, step: int, folds_per_group: int | None = None
) -> DataFrame:
    """Fit on each fold's training bars and signal its out-of-sample bars.

    About ``length / step`` neighbouring folds form a group whose bars overlap
    almost fully, so a bar is copied to at most three groups instead of to all
    the folds that train on it. A group holds at most ``2 * length + step``
    bars whatever the size of the series. Bars before the first fold come back
    with a null signal.
    """
    if not hasattr(strategy, "folds"):
        return _walk_forward_frames(df, spec, strategy, length, step)
    names = getattr(strategy, "fold_params", strategy.params)
    rows = ensure_positions(df, spec).drop(BLK, "signal", "fold", *strategy.params)
    per = folds_per_group or max(1, length // step)
    span = per * step
    folds = fold_count(length, step)
    last = F.greatest(F.lit(0), F.ceil(folds / per) - 1)
    pos = F.col(POS)
    low = F.greatest(F.lit(0), F.floor((pos - length) / span))
    high = F.least(last, F.floor(pos / span))
    grouped = rows.withColumn("__group", F.explode(F.sequence(low, F.greatest(low, high))))
    out = T.StructType(
        [*rows.schema.fields, T.StructField("fold", T.LongType()), T.StructField("signal", T.DoubleType()),
         *[T.StructField(p, T.DoubleType()) for p in names], T.StructField("metric", T.DoubleType())]
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bars = frame.sort_values(POS, kind="stable").reset_index(drop=True)
        group, n, origin = int(bars["__group"].iloc[0]), int(bars[ROWS].iloc[0]), int(bars[POS].iloc[0])
        total = max(0, -(-(n - length) // step))
        mine = range(group * per, min((group + 1) * per, total))
        edges = [(k * step - origin, k * step + length - origin, min(k * step + length + step, n) - origin) for k in mine]
        bars["fold"], bars["signal"], bars["metric"] = -1, np.nan, np.nan
        for p in names:
            bars[p] = np.nan
        keep = (bars[POS] < length).to_numpy() if group == 0 else np.zeros(len(bars), bool)
        if edges:
            for k, (_, end, stop), (params, metric, signal) in zip(mine, edges, strategy.folds(bars, edges), strict=True):
                where = slice(end, stop)
                bars.loc[bars.index[where], ["fold", "metric"]] = k, metric
                bars.loc[bars.index[where], "signal"] = signal
                for p in names:
                    bars.loc[bars.index[where], p] = float(params[p])
                keep[where] = True
        return bars.loc[keep, out.names]

    done = grouped.groupBy(*spec.by("__group")).applyInPandas(run, out)
    nullable = ["signal", "metric", *names]
    return done.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in nullable}).withColumn(
        "fold", F.when(F.col("fold") >= 0, F.col("fold"))
    )


def _walk_forward_frames(df: DataFrame, spec: Series, strategy, length: int, step: int) -> DataFrame:
    """Walk-forward for strategies that only map DataFrames: the fold is one more key."""
    keyed = spec.extend("fold")
    rows = ensure_positions(df, spec).drop(BLK, "signal", "fold")
    fitted = stage(strategy.fit(_restart(fold_rows(rows, spec, length, step, "train"), spec), keyed))
    context = fold_rows(rows, spec, length, step, "context").withColumnsRenamed({POS: "__pos", ROWS: "__rows"})
    signals = strategy.signals(positions(context, keyed), fitted, keyed)
    oos = signals.filter(F.col("__pos") >= length + F.col("fold") * step).drop(POS, ROWS, BLK)
    early = rows.filter(F.col(POS) < length).withColumns({"fold": F.lit(None).cast("long"), "signal": F.lit(None).cast("double")})
    return oos.withColumnsRenamed({"__pos": POS, "__rows": ROWS}).unionByName(early, allowMissingColumns=True)


def full_history_signals(df: DataFrame, spec: Series, strategy, length: int, step: int) -> DataFrame:
    """Legacy variant: refit every ``step`` bars, but averages run over the whole series.

    Only the parameters carry the fold; the signal at a bar uses the newest fit.
    """
    fitted = strategy.fit(_restart(fold_rows(df, spec, length, step, "train"), spec), spec.extend("fold"))
    rows = fold_rows(df, spec, length, step, "oos").drop(*strategy.params)
    tagged = rows.join(fitted.drop("metric"), spec.by("fold"), "left")
    early = ensure_positions(df, spec).filter(F.col(POS) < length).withColumn("fold", F.lit(None).cast("long"))
    every = tagged.unionByName(early, allowMissingColumns=True)
    return row_params_signal(every, spec, strategy)


def _restart(rows: DataFrame, spec: Series) -> DataFrame:
    return positions(rows, spec.extend("fold"))


def row_params_signal(df: DataFrame, spec: Series, strategy) -> DataFrame:
    """Crossover with each row's own parameters; a tie holds the last side taken."""
    from barspark.operators.strategies import _carry

    price = strategy.price
    schema = T.StructType([f for f in df.schema.fields if f.name != BLK] + [T.StructField("__raw", T.DoubleType())])

    def kernel(block: pd.DataFrame) -> pd.DataFrame:
        p, pos = block[price].to_numpy(float), block[POS].to_numpy()
        fast = block["fast"].to_numpy(float, na_value=np.nan)
        slow = block["slow"].to_numpy(float, na_value=np.nan)
        with np.errstate(invalid="ignore"):
            raw = np.sign(kernels.average_at(p, pos, fast) - kernels.average_at(p, pos, slow))
        # A tie holds the last side the same parameters took, not that of another fold.
        ties = np.flatnonzero(raw == 0)
        for pair in {(fast[i], slow[i]) for i in ties}:
            own = [kernels.average_at(p, pos, np.full(len(p), n)) for n in pair]
            with np.errstate(invalid="ignore"):
                sides = kernels.held(np.nan_to_num(np.sign(own[0] - own[1])))
            mine = ties[(fast[ties] == pair[0]) & (slow[ties] == pair[1])]
            raw[mine] = sides[mine]
        block["__raw"] = np.where(raw == 0, np.nan, raw)
        return block.loc[block["__core"], schema.names]

    return _carry(map_blocks(df, spec, kernel, schema, back=strategy.max_window - 1), spec)

"""Many small logistic regressions as aggregates, one per key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.series import spread_join, stage

# --- many small logistic regressions ------------------------------------------------

#: Largest move of a standardised weight in one Newton pass.
STRIDE = 5.0


def fit_logistic(
    df: DataFrame, keys: list[str], label: str, names: list[str], l2: float = 1.0, max_passes: int = 1000, tolerance: float = 1e-9
) -> DataFrame:
    """Ridge-penalised logistic regression per key: ``coef`` (raw scale), ``intercept``, and whether it ``converged``.

    Newton's method as aggregates: each pass sums gradient and curvature of the keys
    that aren't finished in one shuffle of one row per key and task, then solves one
    tiny system per key; no weight moves more than ``STRIDE`` a pass. A key is finished
    when its step is within ``tolerance`` of its weights' size. A key that needs more than
    ``max_passes`` comes back as not converged. Features are standardised for the arithmetic only; the
    penalty is on the raw-scale weights, the intercept is free.
    """
    d = len(names)
    parts = [p for n in names for p in (F.avg(n).alias(f"{n}__m"), F.stddev_pop(n).alias(f"{n}__s"))]
    moments = df.groupBy(*keys).agg(*parts)
    unit = lambda n: F.when(F.col(f"{n}__s") > 0, F.col(f"{n}__s")).otherwise(F.lit(1.0))
    moments = stage(
        moments.select(*keys, F.array(*[F.col(f"{n}__m") for n in names]).alias("__m"), F.array(*[unit(n) for n in names]).alias("__s"))
    )
    # Equal rows collapse into one with a count, so no group of copies weighs on one task.
    counted = df.groupBy(*keys, F.col(label).cast("double").alias("__y"), *names).agg(F.count(F.lit(1)).alias("__c"))
    raw = spread_join(counted, moments, keys)
    scaled = F.array(F.lit(1.0), *[(F.col(n) - F.col("__m")[i]) / F.col("__s")[i] for i, n in enumerate(names)])
    rows = stage(raw.select(*keys, "__y", "__c", scaled.alias("__x")))
    beta = moments.withColumn("__b", F.array(*[F.lit(0.0)] * (d + 1))).withColumn("__step", F.lit(float("inf")))
    out = beta.schema
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        b, s = np.asarray(row["__b"], float), np.asarray(row["__s"], float)
        penalty = np.concatenate([[0.0], l2 / s**2])
        hessian = np.zeros((d + 1, d + 1))
        for (i, j), value in zip(pairs, row["__h"], strict=True):
            hessian[i, j] = hessian[j, i] = value
        gradient = np.asarray(row["__g"], float) + penalty * b
        step = np.linalg.lstsq(hessian + np.diag(penalty + 1e-12), gradient, rcond=None)[0]
        step *= min(1.0, STRIDE / max(float(np.abs(step).max()), 1e-300))
        frame["__step"] = float(np.abs(step).max()) / max(1.0, float(np.abs(b).max()))
        frame["__b"] = [b - step]
        return frame[out.names]

    finished = []
    for _ in range(max_passes):
        joined = spread_join(rows, beta.select(*keys, "__b"), keys)
        z = F.aggregate(F.zip_with("__x", "__b", lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v)
        p = 1 / (1 + F.exp(-z))
        terms = joined.select(*keys, "__x", "__y", "__c", p.alias("__p"))
        gradient = [F.sum(F.col("__c") * (F.col("__p") - F.col("__y")) * F.col("__x")[i]) for i in range(d + 1)]
        curve = F.col("__c") * F.col("__p") * (1 - F.col("__p"))
        hessian = [F.sum(curve * F.col("__x")[i] * F.col("__x")[j]) for i, j in pairs]
        sums = terms.groupBy(*keys).agg(F.array(*gradient).alias("__g"), F.array(*hessian).alias("__h"))
        moved = stage(sums.join(beta, keys).groupBy(*keys).applyInPandas(solve, out))
        finished.append(moved.filter(F.col("__step") <= tolerance))
        beta = moved.filter(F.col("__step") > tolerance)
        if beta.isEmpty():
            break
    beta = beta.withColumn("converged", F.lit(False))
    for part in finished:
        beta = beta.unionByName(part.withColumn("converged", F.lit(True)))
    weights = F.transform(F.sequence(F.lit(1), F.lit(d)), lambda i: F.element_at("__b", i + 1) / F.element_at("__s", i))
    shift = F.aggregate(F.zip_with("__w", "__m", lambda w, m: w * m), F.lit(0.0), lambda a, v: a + v)
    return beta.withColumn("__w", weights).select(*keys, F.col("__w").alias("coef"), (F.col("__b")[0] - shift).alias("intercept"), "converged")

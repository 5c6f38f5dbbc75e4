"""How likely is a result by luck: p-values and distributions over shuffled histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.series import Series, spread_join


def p_value(pfs: DataFrame, real: DataFrame, spec: Series, rule: str = "oos", level: float = 0.05) -> DataFrame:
    """Share of shuffles at least as good as the real value.

    ``rule`` ``in_sample``: (1 + better) / (draws + 1) where draws = n_perm - 1;
    ``oos``: (better + 1) / (n_perm + 1). Both count the real run as one draw,
    so they differ only in how many seeds the caller ran.
    """
    if rule not in ("in_sample", "oos"):
        raise ValueError(f"unknown p-value rule {rule!r}")
    keys = list(spec.keys)
    better = F.count_if(F.col("pf") >= F.col("real_pf"))
    return (
        pfs.join(real.select(*keys, "real_pf"), keys)
        .groupBy(*keys)
        .agg(
            F.first("real_pf").alias("real_pf"),
            F.count(F.lit(1)).alias("draws"),
            better.alias("better"),
            ((better + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
        )
        .withColumn("significant", significant(F.col("p_value"), level))
    )


def significant(p: Column, level: float = 0.05) -> Column:
    return p <= level


def histogram(df: DataFrame, keys: list[str], x: str, bins: int | Column) -> DataFrame:
    """Equal-width bin counts between the smallest and largest finite value; empty bins are absent.

    Infinite values have bins of their own, -1 below and the number of bins above, so the
    counts add up to the rows (missing values aside).
    """
    finite, limit = F.abs(x) < float("inf"), float("inf")
    there = df.dropna(subset=[x])
    edges = there.groupBy(*keys).agg(
        F.min(F.when(finite, F.col(x))).alias("__lo"), F.max(F.when(finite, F.col(x))).alias("__hi"), F.count(F.lit(1)).alias("__n")
    )
    n_bins = F.lit(bins).cast("int") if isinstance(bins, int) else bins.cast("int")
    counted = there.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("__c"))
    joined = spread_join(counted, edges, keys)
    where = F.floor((F.col(x) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * n_bins)
    inner = F.least(F.coalesce(where, F.lit(0)), n_bins - 1)
    bin_of = F.when(F.col(x) == limit, n_bins).when(F.col(x) == -limit, F.lit(-1)).otherwise(inner)
    return joined.withColumn("bin", bin_of.cast("int")).groupBy(*keys, "bin").agg(F.sum("__c").alias("n"))


def pf_bins(n: Column) -> Column:
    """max(10, n // 3) bins for n shuffles."""
    return F.greatest(F.lit(10), F.floor(n / 3)).cast("int")


def empirical_cdf(pfs: DataFrame, real: DataFrame, spec: Series) -> DataFrame:
    """Shuffled values and the real one in order, with the share below each.

    A series has one row per shuffle, so its window holds as many rows as the
    caller ran seeds.
    """
    keys = list(spec.keys)
    every = pfs.select(*keys, "pf", F.lit(False).alias("is_real")).unionByName(
        real.select(*keys, F.col("real_pf").alias("pf"), F.lit(True).alias("is_real"))
    )
    ordered = Window.partitionBy(*keys).orderBy("pf", F.desc("is_real"))
    return every.withColumn(
        "cumulative", (F.row_number().over(ordered) - 1) / F.count(F.lit(1)).over(Window.partitionBy(*keys))
    )

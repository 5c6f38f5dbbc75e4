"""Exact interpolated quantiles per key by selection in levels.

A mergeable sketch cuts the values of a key into intervals; one counting pass, with
partial counts per task, tells which interval holds a wanted rank, whatever the sketch's
luck. An interval that still holds many rows is cut again by a sketch of its own, a
hundred parts a level, until it holds at most ``RANKED`` rows or one value only. Just
those few rows per wanted rank are put in order. So no pass shuffles values of other
intervals, no task ranks more than ``RANKED`` rows, and one key may hold all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.series import SALT, spread_join, stage

#: Rows of an interval that one task may put in order.
RANKED = 100_000
#: Parts into which a level cuts an interval.
PARTS = 100


def salted_values(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """The values that are there, staged, as ``__x`` with a share number for skew-safe joins."""
    rows = df.select(*keys, F.col(x).cast("double").alias("__x")).dropna(subset=["__x"])
    return stage(rows.withColumn(SALT, F.pmod(F.monotonically_increasing_id(), F.lit(64))))


def exact_quantiles(
    df: DataFrame, keys: list[str], x: str, probabilities: list[float], accuracy: int = 10_000, values: DataFrame | None = None
) -> DataFrame:
    """One row per key: ``quantiles``, linearly interpolated, in the order of ``probabilities``.

    ``values`` may pass the table of ``salted_values`` where the caller has it.
    """
    rows = salted_values(df, keys, x) if values is None else values
    slack = 2.0 / accuracy
    cuts = sorted({min(1.0, max(0.0, p + s)) for p in probabilities for s in (-slack, slack)})
    edges = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), _sketch(cuts, accuracy).alias("__edges"))
    whole = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    found = stage(_counted(spread_join(rows, edges.withColumn("__in", whole), keys), keys, probabilities, len(cuts)))
    while True:
        wide = (F.col("__m") > RANKED) & (F.col("__in.low") < F.col("__in.high"))
        if found.filter(wide).isEmpty():
            break
        parts = _inside(rows, found.filter(wide), keys)
        grid = [i / PARTS for i in range(PARTS + 1)]
        # The extremes are edges too, so a level always leaves less than the interval.
        cut = parts.groupBy(*keys, "__in").agg(F.first("__n").alias("__n"), _sketch(grid, accuracy).alias("__edges"))
        again = spread_join(parts.drop("__n"), cut, [*keys, "__in"])
        found = stage(found.filter(~wide).unionByName(_counted(again, keys, probabilities, PARTS + 1)))
    narrow = _inside(rows, found, keys).groupBy(*keys, "__in", "__n", "__x").agg(F.count(F.lit(1)).alias("__c"))
    upto = Window.partitionBy(*keys, "__in").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = narrow.withColumn("__end", F.col("__in.below") + F.sum("__c").over(upto)).withColumn("__start", F.col("__end") - F.col("__c"))
    picks = []
    for j, p in enumerate(probabilities):
        for side, rank in (("lo", _low_rank(p, F.col("__n"))), ("hi", _high_rank(p, F.col("__n")))):
            held = (rank >= F.col("__start")) & (rank < F.col("__end"))
            picks.append(F.max(F.when(held, F.col("__x"))).alias(f"__{side}{j}"))
    got = ranked.groupBy(*keys).agg(F.first("__n").alias("__n"), *picks)
    out = []
    for j, p in enumerate(probabilities):
        part = _position(p, F.col("__n")) - _low_rank(p, F.col("__n"))
        out.append(F.col(f"__lo{j}") + part * (F.col(f"__hi{j}") - F.col(f"__lo{j}")))
    return got.select(*keys, F.array(*out).alias("quantiles"))


def _sketch(shares: list[float], accuracy: int) -> Column:
    return F.percentile_approx("__x", F.array(*[F.lit(c) for c in shares]), F.lit(accuracy))


def _counted(rows: DataFrame, keys: list[str], probabilities: list[float], edges: int) -> DataFrame:
    """Intervals (``__in``: rows below, least and largest value) that hold a wanted rank, their rows ``__m`` and the key's ``__n``.

    ``rows`` have their present interval ``__in`` and the ``__edges`` that cut it: a value lies between two
    edges, or on one or several equal ones (an interval of its own, so that a value of many rows is never cut).
    """
    part = sum(
        (F.when(F.col("__x") > F.get("__edges", F.lit(i)), F.lit(2)).when(F.col("__x") == F.get("__edges", F.lit(i)), F.lit(1)).otherwise(F.lit(0)) for i in range(edges)),
        F.lit(0),
    )
    sizes = rows.groupBy(*keys, "__in", part.alias("__i")).agg(
        F.count(F.lit(1)).alias("__m"), F.first("__n").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high")
    )
    before = Window.partitionBy(*keys, "__in").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__below", F.col("__in.below") + F.coalesce(F.sum("__m").over(before), F.lit(0)))
    wanted = sizes.filter(_any_rank(probabilities, F.col("__n"), F.col("__below"), F.col("__below") + F.col("__m")))
    where = F.struct(F.col("__below").alias("below"), F.col("__low").alias("low"), F.col("__high").alias("high"))
    return wanted.select(*keys, where.alias("__in"), "__m", "__n")


def _inside(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose value lies in one of the intervals found for their key, with that interval."""
    held = found.groupBy(*keys).agg(F.collect_list("__in").alias("__all"), F.first("__n").alias("__n"))
    hit = F.filter("__all", lambda i: F.col("__x").between(i["low"], i["high"]))
    return spread_join(rows, held, keys).withColumn("__in", F.get(hit, F.lit(0))).filter(F.col("__in").isNotNull()).drop("__all")


def _position(p: float, n: Column) -> Column:
    return F.lit(float(p)) * (n - 1)


def _low_rank(p: float, n: Column) -> Column:
    return F.floor(_position(p, n))


def _high_rank(p: float, n: Column) -> Column:
    return F.ceil(_position(p, n))


def _any_rank(probabilities: list[float], n: Column, start: Column, end: Column) -> Column:
    out = F.lit(False)
    for p in probabilities:
        for rank in (_low_rank(p, n), _high_rank(p, n)):
            out = out | ((rank >= start) & (rank < end))
    return out


def interior_probabilities(k: int) -> list[float]:
    """The k-1 interior cut points of k equal-probability classes."""
    return [i / k for i in range(1, k)]

"""Series quality: range, coverage, gaps, and the incremental work list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.series import Rolling, Series, windowed


def series_quality(df: DataFrame, spec: Series, columns: list[str] | None = None) -> DataFrame:
    """First and last bar, bars, coverage, gaps longer than two steps, whole days, columns, status.

    Coverage divides by intervals, not bars, so a complete series is above 100 %.
    """
    seconds = F.unix_seconds(F.col(spec.ts).cast("timestamp"))
    before = Rolling(lambda w: seconds - F.lag(seconds).over(w), back=1)
    steps = windowed(df.select(*spec.by(spec.ts)), spec, {"__step": before})
    stats = steps.groupBy(*spec.keys).agg(
        F.min(spec.ts).alias("available_from"),
        F.max(spec.ts).alias("available_to"),
        F.count(F.lit(1)).alias("total_bars"),
        F.count_if(F.col("__step") > 2 * spec.step).alias("large_gaps_detected"),
        (F.max(seconds) - F.min(seconds)).alias("__span"),
    )
    expected = F.floor(F.col("__span") / spec.step)
    names = columns or [c for c in df.columns if c not in spec.by(spec.ts)]
    return stats.select(
        *spec.keys,
        F.lit("success").alias("status"),
        "available_from",
        "available_to",
        "total_bars",
        F.round(F.coalesce(F.try_divide(F.col("total_bars"), expected) * 100, F.lit(0.0)), 2).alias("data_coverage_pct"),
        "large_gaps_detected",
        F.floor(F.col("__span") / 86_400).alias("trading_days"),
        F.array(*[F.lit(n) for n in names]).alias("ohlcv_columns"),
    )


def with_requested(quality: DataFrame, requested: DataFrame, spec: Series) -> DataFrame:
    """Add a ``no_data`` row for every requested series that has no bars."""
    joined = requested.join(quality, list(spec.keys), "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("no_data"))).withColumn(
        "error", F.when(F.col("status") == "no_data", F.lit("No OHLCV data returned"))
    )


def outcome_counts(quality: DataFrame, *by: str) -> DataFrame:
    """Successful and failed series."""
    ok = F.count_if(F.col("status") == "success")
    return quality.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_assets"),
        ok.alias("successful_assets"),
        (F.count(F.lit(1)) - ok).alias("failed_assets"),
    )


def fetch_plan(stored: DataFrame, requested: DataFrame, spec: Series, start: Column, end: Column) -> DataFrame:
    """What to fetch: from the bar after the last stored one, or the requested start; rows already complete drop out."""
    last = stored.groupBy(*spec.keys).agg(F.max(spec.ts).alias("last_ts"))
    next_bar = F.col("last_ts") + F.make_dt_interval(secs=F.lit(spec.step))
    return (
        requested.join(last, list(spec.keys), "left")
        .withColumn("fetch_from", F.greatest(start, next_bar))
        .withColumn("fetch_to", end)
        .filter(F.col("fetch_from") < F.col("fetch_to"))
    )

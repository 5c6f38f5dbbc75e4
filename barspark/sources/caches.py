"""Cache info files: what each interval's bar cache holds, as JSON and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ASSET = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("cache_type", T.StringType()),
        T.StructField("available_from", T.StringType()),
        T.StructField("available_to", T.StringType()),
        T.StructField("total_bars", T.LongType()),
        T.StructField("data_coverage_pct", T.DoubleType()),
        T.StructField("large_gaps_detected", T.LongType()),
        T.StructField("trading_days", T.LongType()),
        T.StructField("ohlcv_columns", T.ArrayType(T.StringType())),
        T.StructField("cache_file", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
CACHE_INFO_SCHEMA = T.StructType(
    [
        T.StructField("creation_date", T.StringType()),
        T.StructField("requested_range", T.StructType([T.StructField("start", T.StringType()), T.StructField("end", T.StringType())])),
        T.StructField("interval", T.StringType()),
        T.StructField("cache_type", T.StringType()),
        T.StructField("total_assets", T.LongType()),
        T.StructField("successful_assets", T.LongType()),
        T.StructField("failed_assets", T.LongType()),
        T.StructField("assets", T.MapType(T.StringType(), _ASSET)),
    ]
)


def asset_info(quality: DataFrame, interval: Column, symbol: str = "symbol") -> DataFrame:
    """Quality rows in the form of a cache info entry."""
    stem = F.regexp_replace(F.col(symbol), "[/-]", "")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    ok = F.col("status") == "success"
    return quality.select(
        F.col(symbol).alias("asset"),
        "status",
        F.when(ok, F.lit("ohlcv")).alias("cache_type"),
        day("available_from").alias("available_from"),
        day("available_to").alias("available_to"),
        "total_bars",
        "data_coverage_pct",
        "large_gaps_detected",
        "trading_days",
        "ohlcv_columns",
        F.when(ok, F.concat(F.lit("ohlcv_"), stem, F.lit("_"), interval, F.lit(".parquet"))).alias("cache_file"),
        (F.col("error") if "error" in quality.columns else F.lit(None).cast("string")).alias("error"),
    )


def cache_info(info: DataFrame, interval: str, start: str, end: str, created: Column) -> DataFrame:
    """One document row: counts and the map from asset to entry (one entry per series)."""
    ok = F.count_if(F.col("status") == "success")
    entry = F.struct(*[F.col(f.name) for f in _ASSET.fields])
    return info.agg(
        F.count(F.lit(1)).alias("total_assets"),
        ok.alias("successful_assets"),
        (F.count(F.lit(1)) - ok).alias("failed_assets"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("asset"), entry.alias("info"))))).alias("assets"),
    ).select(
        F.date_format(created, "yyyy-MM-dd HH:mm:ss").alias("creation_date"),
        F.struct(F.lit(start).alias("start"), F.lit(end).alias("end")).alias("requested_range"),
        F.lit(interval).alias("interval"),
        F.lit("ohlcv").alias("cache_type"),
        "total_assets",
        "successful_assets",
        "failed_assets",
        "assets",
    )


def summary_lines(info: DataFrame) -> DataFrame:
    """The text block of every asset, for ``write.text``."""
    n = lambda c: F.format_number(F.col(c), 0)
    good = F.concat_ws(
        "\n",
        F.concat(F.col("asset"), F.lit(":")),
        F.lit("  Status: Success"),
        F.lit("  Type: OHLCV Cache"),
        F.concat(F.lit("  Available: "), "available_from", F.lit(" to "), "available_to"),
        F.concat(F.lit("  Bars: "), n("total_bars")),
        F.concat(F.lit("  Coverage: "), F.format_string("%.2f", "data_coverage_pct"), F.lit("%")),
        F.concat(F.lit("  Trading Days: "), n("trading_days")),
        F.concat(F.lit("  Gaps: "), F.col("large_gaps_detected").cast("string")),
        F.concat(F.lit("  Columns: "), F.concat_ws(", ", "ohlcv_columns")),
        F.concat(F.lit("  Cache File: "), "cache_file"),
    )
    bad = F.concat_ws(
        "\n",
        F.concat(F.col("asset"), F.lit(":")),
        F.concat(F.lit("  Status: "), F.col("status")),
        F.concat(F.lit("  Error: "), F.coalesce("error", F.lit("Unknown error"))),
    )
    return info.select("asset", F.when(F.col("status") == "success", good).otherwise(bad).alias("value"))


def write_cache_info(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)


def read_cache_info(spark: SparkSession, path: str | list[str], mode: str = "spot") -> DataFrame:
    """One row per asset: its entry, the document's counts, and whether it succeeded.

    For both venues, read each path with its own ``mode`` and union.
    """
    documents = spark.read.schema(CACHE_INFO_SCHEMA).option("multiLine", True).json(path)
    return explode_cache_info(documents, mode)


def explode_cache_info(documents: DataFrame, mode: str = "spot") -> DataFrame:
    head = ["interval", "total_assets", "successful_assets", "failed_assets"]
    rows = documents.select(*head, F.explode("assets").alias("asset", "info"))
    return rows.select(F.lit(mode).alias("mode"), *head, "asset", "info.*").withColumn("ok", F.col("status") == "success")

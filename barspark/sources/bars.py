"""Bar tables: read, repair, parse candle pages, build from ticks, upsert, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.operators.prices import with_derived_prices
from barspark.series import Series, stage
from barspark.sources import store

# Column names of bars and of their time column in raw files, in order of preference.
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
TIME_CANDIDATES = ("timestamp", "index", "openTime")
PARTITIONS = ("mode", "tf", "symbol", "month")

BAR_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(c, T.DoubleType()) for c in (*PRICE_COLUMNS, "typical", "median", "vwap")],
        T.StructField("arrived", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in PARTITIONS],
    ]
)


def read_bars(
    spark: SparkSession, root: str, mode: str | None = None, symbol: str | None = None, tf: str | None = None
) -> DataFrame:
    """Bars of the store's newest snapshot; the arguments prune partitions. Asking for a series that is absent fails."""
    bars = store.read(spark, root, BAR_SCHEMA, PARTITIONS, mode=mode, symbol=symbol, tf=tf)
    if symbol is not None and bars.isEmpty():
        raise FileNotFoundError(f"no bars for {mode}/{symbol}/{tf} under {root}")
    return bars.drop("month", "arrived")


def utc_naive(ts: Column, zone: str = "UTC") -> Column:
    """An instant as UTC wall-clock time without zone."""
    return F.to_timestamp_ntz(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def repair_time(df: DataFrame, name: str = "ts") -> DataFrame:
    """Find the time of each row: ``name`` if it is a time, else the first candidate column that parses.

    Numbers are epoch milliseconds. A table without any usable time fails.
    """
    found = []
    for column in (name, *TIME_CANDIDATES):
        if column not in df.columns:
            continue
        kind = df.schema[column].dataType
        if isinstance(kind, T.TimestampNTZType):
            found.append(F.col(column))
        elif isinstance(kind, T.TimestampType | T.DateType):
            found.append(F.col(column).cast("timestamp_ntz"))
        elif isinstance(kind, T.NumericType):
            found.append(F.timestamp_millis(F.col(column).cast("long")).cast("timestamp_ntz"))
        else:
            found.append(F.try_to_timestamp(F.col(column)).cast("timestamp_ntz"))
    if not found:
        raise ValueError("no time column: expected one of " + ", ".join((name, *TIME_CANDIDATES)))
    time = F.coalesce(*found)
    checked = df.withColumn("__ts", time).drop(*[c for c in (name, *TIME_CANDIDATES) if c in df.columns])
    return checked.withColumnRenamed("__ts", name)


def require_time(df: DataFrame, name: str = "ts") -> DataFrame:
    """Fail if no row has a time (one cheap existence check)."""
    if df.filter(F.col(name).isNotNull()).isEmpty():
        raise ValueError("no row has a parsable time")
    return df


def candles(pages: DataFrame, value: str = "value") -> DataFrame:
    """Candle pages (JSON arrays of arrays of strings or numbers) to typed bars with open and close time.

    A page column ``__arrived`` asks for ``__place``, the place of each bar in its page.
    """
    page = F.from_json(value, "array<array<string>>")
    keep = [c for c in pages.columns if c != value]
    rows = pages.select(*keep, F.posexplode(page).alias("__place", "c"))
    keep += ["__place"] if "__arrived" in keep else []
    at = lambda i: F.element_at("c", i + 1)
    return rows.select(
        *keep,
        F.timestamp_millis(at(0).try_cast("long")).cast("timestamp_ntz").alias("ts"),
        *[at(i + 1).try_cast("double").alias(c) for i, c in enumerate(PRICE_COLUMNS)],
        F.timestamp_millis(at(6).try_cast("long")).cast("timestamp_ntz").alias("close_ts"),
    )


def finalised(df: DataFrame, now: Column | None = None, close_ts: str = "close_ts") -> DataFrame:
    """Only bars whose close time has passed."""
    clock = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    return df.filter(F.col(close_ts) <= clock)


def ohlcv_rows(df: DataFrame, spec: Series, start: str, end: str, seq: str, millis: str = "timestamp") -> DataFrame:
    """Millisecond rows to bars: window filter, keep the last of equal times, derived prices."""
    rows = df.withColumn(spec.ts, F.timestamp_millis(F.col(millis).cast("long")).cast("timestamp_ntz"))
    ts = F.col(spec.ts)
    inside = rows.filter((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz")))
    return with_derived_prices(keep_last(inside, spec, F.col(seq)).drop(millis, seq))


def keep_last(df: DataFrame, spec: Series, *order: Column) -> DataFrame:
    """One row per (series, time): the last in ``order``.

    An aggregate, so that copies of a bar collapse before the shuffle however
    many there are.
    """
    keys = spec.by(spec.ts)
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(newest.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def upsert(existing: DataFrame, new: DataFrame, spec: Series, seq: str | None = None) -> DataFrame:
    """Union in which later batches overwrite equal times; inside a batch the highest ``seq`` wins."""
    tagged = existing.withColumn("__batch", F.lit(0)).unionByName(
        new.withColumn("__batch", F.lit(1)), allowMissingColumns=True
    )
    order = [F.col("__batch"), *([F.col(seq)] if seq else [])]
    return keep_last(tagged, spec, *order).drop("__batch")


def bars_from_ticks(
    ticks: DataFrame, keys: dict[str, Column], ts: Column, price: Column, order: Column, every: str, volume: Column | None = None
) -> DataFrame:
    """Rows to bars: first, highest, lowest, last price and summed volume (default: rows) per key and bucket."""
    base = ticks.select(
        *[c.alias(k) for k, c in keys.items()], ts.alias("__ts"), price.alias("__p"), order.alias("__o"),
        (F.lit(1.0) if volume is None else volume).alias("__v"),
    )
    bucket = F.col("__ts") if every == "row" else F.window("__ts", every).start
    return base.groupBy(*keys, bucket.alias("ts")).agg(
        F.min_by("__p", "__o").alias("open"),
        F.max("__p").alias("high"),
        F.min("__p").alias("low"),
        F.max_by("__p", "__o").alias("close"),
        F.sum("__v").alias("volume"),
    )


def write_bars(df: DataFrame, root: str, base: int | None = None) -> int:
    """Replace exactly the (mode, tf, symbol, month) partitions present in ``df``, in one commit on snapshot ``base`` (default: the newest)."""
    rows = df.withColumn("month", F.date_format("ts", "yyyy-MM"))
    if "arrived" not in rows.columns:
        rows = rows.withColumn("arrived", F.lit(None).cast("string"))
    if not {"typical", "median", "vwap"} <= set(rows.columns):
        rows = with_derived_prices(rows)
    base = store.newest(df.sparkSession, root) if base is None else base
    return store.commit(rows.select(*BAR_SCHEMA.names), root, PARTITIONS, "ts", base)


def upsert_into(root: str, batch: DataFrame, spec: Series, seq: str | None = None) -> int:
    """Merge a batch into stored bars, rewriting only the months it touches; the new snapshot's number.

    ``seq`` is a text that orders bars by arrival (see ``streaming.live.in_order``). It is kept
    with each bar, so the bar that arrived last wins in whatever order the batches come. A
    batch without it counts as arriving now. If another writer commits meanwhile,
    ``store.Conflict`` is raised and nothing has changed.
    """
    spark = batch.sparkSession
    now = F.lpad(F.unix_micros(F.current_timestamp()).cast("string"), 20, "0")
    new = batch.withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn("arrived", F.col(seq) if seq else now)
    base = store.newest(spark, root)
    names = [c for c in BAR_SCHEMA.names if c not in ("typical", "median", "vwap")]
    new = stage(new.select(*[c for c in names if c in new.columns], F.lit(1).alias("__batch")))
    if base:
        stored = store.read(spark, root, BAR_SCHEMA, PARTITIONS, base)
        touched = stored.join(new.select(*PARTITIONS).distinct(), list(PARTITIONS), "left_semi")
        new = touched.select(*names, F.lit(0).alias("__batch")).unionByName(new, allowMissingColumns=True)
    merged = keep_last(new, spec, F.col("arrived"), F.col("__batch")).drop("__batch")
    return write_bars(merged, root, base)

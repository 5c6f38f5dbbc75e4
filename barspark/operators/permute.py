"""Shuffled price histories: same bars, other order, same first and last prices.

A bar is its gap from the previous close plus high, low and close relative to
its open. Gaps and triples are shuffled independently; the shuffled history is
their running sum. The order is that of md5(seed:kind:position), so markets
with equal positions shuffle alike and a re-run gives the same table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.series import BLK, POS, ROWS, Rolling, Running, Series, ensure_positions, running, spread_join, windowed

OHLC = ("open", "high", "low", "close")
RANK_BUCKET = 50_000


def decompose(df: DataFrame, spec: Series) -> DataFrame:
    """Log gap from the previous close, and log high, low and close relative to the open."""
    logs = {f"log_{c}": F.log(c) for c in OHLC}
    gap = Rolling(lambda w: F.col("log_open") - F.lag("log_close").over(w), back=1)
    return windowed(df.withColumns(logs), spec, {"gap": gap}).withColumns(
        {f"rel_{c}": F.col(f"log_{c}") - F.col("log_open") for c in OHLC[1:]}
    )


def with_seeds(df: DataFrame, seeds: int | Iterable[int]) -> DataFrame:
    """One copy of every row per seed."""
    if isinstance(seeds, int):
        return df.withColumn("seed", F.explode(F.expr(f"sequence(0L, {seeds - 1}L)")))
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])))


def shuffle_key(kind: str) -> Column:
    return F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.lit(kind), F.col(POS).cast("string")).cast("binary"))


def shuffled_slots(df: DataFrame, spec: Series, kind: str, name: str = "slot") -> DataFrame:
    """Rank of each row in md5 order, from 0, per (series, seed).

    Ranks come from hash-prefix buckets of about ``RANK_BUCKET`` rows plus
    prefix sums over bucket counts; md5 spreads rows evenly over buckets.
    Needs ``movable``, the number of rows being ranked in the series.
    """
    keyed = spec.extend("seed")
    head = F.conv(F.substring("__md5", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = df.withColumn("__md5", shuffle_key(kind)).withColumn(
        "__bucket", F.floor(head * F.ceil(F.col("movable") / RANK_BUCKET))
    )
    counts = rows.groupBy(*keyed.by("__bucket")).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*keyed.keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keyed.by("__bucket"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*keyed.by("__bucket")).orderBy("__md5")
    return (
        rows.withColumn("__rank", F.row_number().over(inside))
        .join(offsets.hint("merge"), keyed.by("__bucket"))
        .withColumn(name, F.col("__off") + F.col("__rank") - 1)
        .drop("__md5", "__bucket", "__rank", "__off")
    )


def permutation_start(df: DataFrame, spec: Series, start: str, length: int) -> DataFrame:
    """max(0, bars before start - length) per series: shuffling begins after that bar."""
    before = F.count_if(F.col(spec.ts) < F.lit(start).cast("timestamp_ntz"))
    return df.groupBy(*spec.keys).agg(F.greatest(F.lit(0), before - length).alias("perm_start"))


def permuted_bars(
    df: DataFrame, spec: Series, seeds: int | Iterable[int], start: int | DataFrame = 0
) -> DataFrame:
    """Shuffled histories, one per seed. Bars up to ``start`` stay; volume and time stay in place.

    ``start`` is a position, or a table with ``perm_start`` per series. Only
    open, high, low, close and volume survive, as a shuffled bar has no other
    meaning.
    """
    parts = decompose(df, spec)
    if isinstance(start, DataFrame):
        parts = spread_join(parts, start, list(spec.keys))
    else:
        parts = parts.withColumn("perm_start", F.lit(start).cast("long"))
    parts = parts.withColumn("movable", F.col(ROWS) - F.col("perm_start") - 1)
    keyed = spec.extend("seed")
    moving = with_seeds(parts.filter(F.col(POS) > F.col("perm_start")), seeds)
    place = (F.col("perm_start") + 1 + F.col("slot")).alias(POS)
    triples = shuffled_slots(
        moving.select(*keyed.by(POS, "movable", "perm_start", "rel_high", "rel_low", "rel_close")), spec, "bar"
    ).select(*keyed.keys, place, "rel_high", "rel_low", "rel_close")
    gaps = shuffled_slots(moving.select(*keyed.by(POS, "movable", "perm_start", "gap")), spec, "gap").select(
        *keyed.keys, place, "gap"
    )
    volume = ["volume"] if "volume" in df.columns else []
    fixed = with_seeds(parts.select(*spec.by(spec.ts, POS, ROWS, "perm_start", *OHLC, *volume)), seeds)
    merged = fixed.join(triples, keyed.by(POS), "left").join(gaps, keyed.by(POS), "left")
    step = F.when(F.col(POS) == F.col("perm_start"), F.log("close")).when(
        F.col(POS) > F.col("perm_start"), F.col("gap") + F.col("rel_close")
    )
    path = running(merged, keyed, {"__close": Running("sum", step)})
    opened = F.col("__close") - F.col("rel_close")
    moved = F.col(POS) > F.col("perm_start")
    new = {
        "open": F.exp(opened),
        "high": F.exp(opened + F.col("rel_high")),
        "low": F.exp(opened + F.col("rel_low")),
        "close": F.exp("__close"),
    }
    return path.select(
        *keyed.by(spec.ts, POS, ROWS),
        *[F.when(moved, e).otherwise(F.col(c)).alias(c) for c, e in new.items()],
        *volume,
    )


def index_mismatches(df: DataFrame, time: str, symbol: str = "symbol", by: tuple[str, ...] = ()) -> DataFrame:
    """Times at which not every market has a bar; empty when the markets share one index."""
    markets = df.groupBy(*by).agg(F.count_distinct(symbol).alias("markets"))
    present = df.groupBy(*by, time).agg(F.count_distinct(symbol).alias("present"))
    joined = spread_join(present, markets, list(by))
    return joined.filter(F.col("present") != F.col("markets"))


def permuted_returns(df: DataFrame, spec: Series, seeds: int | Iterable[int], start: int = 0, price: str = "close") -> DataFrame:
    """Forward log returns of shuffled histories."""
    from barspark.operators.windows import forward_log_return

    keyed = spec.extend("seed")
    bars = permuted_bars(df, spec, seeds, start)
    return windowed(bars, keyed, {"r": forward_log_return(price)}).select(*keyed.by(spec.ts, POS, "r"))


def cut_back(df: DataFrame) -> DataFrame:
    """Drop position columns after a filter, so that later operators number the rows afresh."""
    return df.drop(POS, ROWS, BLK)



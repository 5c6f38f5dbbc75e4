"""Ordered series on Spark without one-task-per-series windows.

A *series* is all rows with equal key columns, ordered by a time column. One
series may hold a large share of the data, so no operator here ever windows
over a whole series:

* ``positions`` numbers rows with a count per (series, time chunk) and prefix
  sums over those counts;
* ``windowed`` evaluates bounded frames inside blocks of ``block`` rows, each
  padded with the few neighbour rows its frames can reach;
* ``running`` evaluates unbounded scans as a scan inside each block plus a
  carry computed on the small one-row-per-block table.

Blocks, not series, are the unit of parallelism; every shuffle key is
(series keys, block number) and therefore bounded by construction.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS, ROWS, BLK = "pos", "n_rows", "blk"
_CORE = "__core"


@dataclass(frozen=True)
class Series:
    """How a table splits into ordered series.

    ``step`` is the bar spacing in seconds; ``block`` the number of rows that
    share one window partition. Bars are unique on (keys, ts), hence a stretch
    of ``step * block`` seconds holds at most ``block`` rows. Rows that may
    share a time (events) name the columns that order them in ``ties``.
    """

    keys: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    step: int = 86_400
    block: int = 65_536
    ties: tuple[str, ...] = ()

    def extend(self, *names: str) -> Series:
        """The same series split further, e.g. by seed, fold or parameter."""
        return replace(self, keys=self.keys + tuple(n for n in names if n not in self.keys))

    def by(self, *extra: str) -> list[str]:
        return [*self.keys, *extra]

    @property
    def window(self) -> WindowSpec:
        """The one window every bounded frame uses: same keys, same order, one sort."""
        return Window.partitionBy(*self.by(BLK)).orderBy(POS)


@dataclass(frozen=True)
class Rolling:
    """A column over a bounded frame reaching ``back`` rows behind and ``ahead`` rows beyond.

    ``before`` are layers of helper columns that the frame is built from; they count in
    the reach and are dropped after use.
    """

    build: Callable[[WindowSpec], Column]
    back: int = 0
    ahead: int = 0
    before: tuple[dict[str, Rolling], ...] = ()


def plain(column: Column) -> Rolling:
    """A row-local expression, for use as a layer of ``windowed``."""
    return Rolling(lambda _w: column)


def positions(df: DataFrame, spec: Series) -> DataFrame:
    """Add ``pos`` (0-based row number in the series) and ``n_rows`` (series length)."""
    chunk = F.floor(
        F.unix_seconds(F.col(spec.ts).cast("timestamp")) / F.lit(float(spec.step * spec.block))
    )
    rows = df.drop(POS, ROWS, BLK).withColumn("__chunk", chunk)
    counts = rows.groupBy(*spec.by("__chunk")).agg(F.count(F.lit(1)).alias("__count"))
    by_key = Window.partitionBy(*spec.keys)
    before = by_key.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *spec.by("__chunk"),
        F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__offset"),
        F.sum("__count").over(by_key).alias(ROWS),
    )
    inside = Window.partitionBy(*spec.by("__chunk")).orderBy(spec.ts, *spec.ties)
    # The rows are already clustered and sorted by chunk, so a merge join moves only the offsets.
    return (
        rows.withColumn("__row", F.row_number().over(inside))
        .join(offsets.hint("merge"), spec.by("__chunk"))
        .withColumn(POS, F.col("__offset") + F.col("__row") - F.lit(1))
        .drop("__chunk", "__row", "__offset")
    )


def positions_in_order(df: DataFrame, spec: Series, *order: str) -> DataFrame:
    """``pos`` and ``n_rows`` by the columns of ``order``, however many rows share a time.

    Rows are range-partitioned by keys and order, so ties of any number spread over tasks
    as long as the order tells rows apart; each range is numbered apart and shifted by
    the counts before it. Rows that are equal in keys and order stand in any order. The
    rows are staged.
    """
    by = [*spec.keys, *order]
    at = F.monotonically_increasing_id()
    rows = df.drop(POS, ROWS, BLK).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", at)
    rows = stage(rows.withColumn(SALT, F.shiftright("__at", 33)))
    before = Window.orderBy(SALT).rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy(SALT).agg(F.count(F.lit(1)).alias("__shift"))  # one row per range
    shifts = shifts.select(SALT, F.coalesce(F.sum("__shift").over(before), F.lit(0)).alias("__shift"))
    numbered = rows.join(F.broadcast(shifts), SALT).withColumn("__at", F.col("__shift") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    first = numbered.groupBy(*spec.keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias(ROWS))
    out = spread_join(numbered, first, list(spec.keys))
    return out.withColumn(POS, F.col("__at") - F.col("__first")).drop("__at", "__first", "__shift", SALT)


def ensure_positions(df: DataFrame, spec: Series) -> DataFrame:
    return df if {POS, ROWS} <= set(df.columns) else positions(df, spec)


def blocks(df: DataFrame, spec: Series, back: int = 0, ahead: int = 0, size: int | None = None) -> DataFrame:
    """Assign rows to blocks, copying each block's neighbours within reach of its frames."""
    size = size or spec.block
    home = F.floor(F.col(POS) / F.lit(size))
    if not back and not ahead:
        return df.withColumn(BLK, home).withColumn(_CORE, F.lit(True))
    last = F.floor((F.col(ROWS) - 1) / F.lit(size))
    low = F.greatest(F.lit(0), F.floor((F.col(POS) - ahead) / F.lit(size)))
    high = F.least(last, F.floor((F.col(POS) + back) / F.lit(size)))
    return df.withColumn(BLK, F.explode(F.sequence(low, high))).withColumn(_CORE, F.col(BLK) == home)


def windowed(df: DataFrame, spec: Series, *layers: dict[str, Rolling]) -> DataFrame:
    """Add bounded-frame columns; later layers may use the columns of earlier ones.

    One shuffle and one sort serve all layers. ``blk`` stays on the result so
    that a following ``running`` needs no further shuffle.
    """
    back = sum(max((r.back for r in layer.values()), default=0) for layer in layers)
    ahead = sum(max((r.ahead for r in layer.values()), default=0) for layer in layers)
    out = blocks(ensure_positions(df, spec).drop(BLK), spec, back, ahead)
    for layer in layers:
        helpers: list[str] = []
        for depth in range(max((len(r.before) for r in layer.values()), default=0)):
            made = {n: b for r in layer.values() for n, b in (r.before[depth].items() if depth < len(r.before) else ())}
            out = out.withColumns({n: b.build(spec.window) for n, b in made.items()})
            helpers += made
        out = out.withColumns({name: r.build(spec.window) for name, r in layer.items()}).drop(*helpers)
    return out.filter(_CORE).drop(_CORE)


@dataclass(frozen=True)
class Running:
    """An unbounded scan: ``kind`` is sum, product, max, min, last (fill forward) or next (fill backward)."""

    kind: str
    column: Column


_LOCAL = {"sum": F.sum, "product": F.product, "max": F.max, "min": F.min}


def _fold(kind: str, column: Column, window: WindowSpec) -> Column:
    if kind == "last":
        return F.last(column, ignorenulls=True).over(window)
    if kind == "next":
        return F.first(column, ignorenulls=True).over(window)
    return _LOCAL[kind](column).over(window)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind in ("last", "next"):
        return F.coalesce(local, carry)
    if kind == "sum":
        return F.when(local.isNull(), carry).otherwise(local + F.coalesce(carry, F.lit(0)))
    if kind == "product":
        return F.when(local.isNull(), carry).otherwise(local * F.coalesce(carry, F.lit(1.0)))
    return (F.greatest if kind == "max" else F.least)(local, carry)


def _block_total(kind: str, column: Column) -> Column:
    if kind == "last":
        return F.max_by(column, F.when(column.isNotNull(), F.col(POS)))
    if kind == "next":
        return F.min_by(column, F.when(column.isNotNull(), F.col(POS)))
    return _LOCAL[kind](column)


def with_blocks(df: DataFrame, spec: Series) -> DataFrame:
    if BLK in df.columns:
        return df
    return blocks(ensure_positions(df, spec), spec).drop(_CORE)


def carries(rows: DataFrame, spec: Series, scans: dict[str, Running]) -> DataFrame:
    """One row per block: what the blocks before it (for ``next``, after it) leave to each scan, as ``__carry_`` columns."""
    totals = rows.groupBy(*spec.by(BLK)).agg(
        *[_block_total(s.kind, s.column).alias(f"__{name}") for name, s in scans.items()]
    )
    by_key = Window.partitionBy(*spec.keys).orderBy(BLK)
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    after = by_key.rowsBetween(1, Window.unboundedFollowing)
    return totals.select(
        *spec.by(BLK),
        *[
            _fold(s.kind, F.col(f"__{name}"), after if s.kind == "next" else before).alias(f"__carry_{name}")
            for name, s in scans.items()
        ],
    )


def running(df: DataFrame, spec: Series, scans: dict[str, Running]) -> DataFrame:
    """Add unbounded scans as block scan + carry from the one-row-per-block table."""
    rows = with_blocks(df, spec)
    upto = spec.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = spec.window.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = rows.withColumns(
        {f"__{name}": _fold(s.kind, s.column, onward if s.kind == "next" else upto) for name, s in scans.items()}
    )
    # The rows are already clustered and sorted by block, so a merge join moves only the carries.
    joined = local.join(carries(rows, spec, scans).hint("merge"), spec.by(BLK))
    return joined.withColumns(
        {name: _combine(s.kind, F.col(f"__{name}"), F.col(f"__carry_{name}")) for name, s in scans.items()}
    ).drop(*[f"__{n}" for n in scans], *[f"__carry_{n}" for n in scans])


def windowed_filled(df: DataFrame, spec: Series, *layers: dict[str, Rolling], fill: dict[str, Column], after: tuple[dict[str, Rolling], ...] = ()) -> DataFrame:
    """``windowed``, where each column of ``fill`` becomes its last known value, with the shuffle and sort of the windows.

    The fill runs inside the blocks before the layers of ``after``. Only a series of several blocks
    has something to carry between them: their carries, at most one row per ``block / 2`` rows of
    such series, are broadcast, and their blocks alone are evaluated a second time to get them.
    """

    def known(column: Column) -> Rolling:
        # The padding's own frames are cut off, so it leaves nothing to the block.
        upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return Rolling(lambda w: F.last(F.when(F.col(_CORE), column), ignorenulls=True).over(upto(w)))

    out = windowed(df, spec, *layers, {f"__last_{n}": known(c) for n, c in fill.items()}, *after)
    scans = {n: Running("last", c) for n, c in fill.items()}
    carried = carries(out.filter(F.col(ROWS) > F.lit(spec.block)), spec, scans)
    out = out.join(F.broadcast(carried), spec.by(BLK), "left")
    filled = {n: F.coalesce(F.col(f"__last_{n}"), F.col(f"__carry_{n}")) for n in fill}
    return out.withColumns(filled).drop(*[f"__last_{n}" for n in fill], *[f"__carry_{n}" for n in fill])


#: Rows of one key that share a copy of what is joined to the key.
SHARE = 262_144
SALT = "__salt"


def spread_join(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a few rows per key (parameters, statistics, edges) onto many rows per key.

    One key may own a third of ``df``. Its rows are cut into shares: by position where
    the rows carry one, by a ``__salt`` column where the caller gives it, else by a hash of the
    row. The shares that exist are listed first, and ``small`` is repeated once for each
    of them, so a key of few rows keeps one copy and a long one gets as many as it has
    shares. A recomputed task assigns the same share. Adaptive execution still turns
    either join into a broadcast when it measures the copies to be small. Without keys,
    ``small`` is a single row.
    """
    if not keys:
        joined = spread_join(df.withColumn("__all", F.lit(0)), small.withColumn("__all", F.lit(0)), ["__all"], how)
        return joined.drop("__all")
    given = SALT in df.columns
    if given:
        salted = df
    elif POS in df.columns:
        salted = df.withColumn(SALT, F.floor(F.col(POS) / F.lit(SHARE)))
    else:
        salted = df.withColumn(SALT, F.pmod(F.xxhash64(*df.columns), F.lit(32)))
    copies = salted.select(*keys, SALT).distinct().join(small, keys, how)
    out = salted.join(copies, [*keys, SALT], how)
    return out if given else out.drop(SALT)


def map_blocks(
    df: DataFrame,
    spec: Series,
    kernel: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    back: int = 0,
    ahead: int = 0,
    size: int | None = None,
) -> DataFrame:
    """Run a vectorised kernel on each padded block (at most ``block + back + ahead`` rows).

    The kernel gets rows in series order with a boolean ``__core`` column that
    is false on the copied neighbours.
    """
    padded = blocks(ensure_positions(df, spec).drop(BLK), spec, back, ahead, size)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return kernel(frame.sort_values(POS, kind="stable").reset_index(drop=True))

    return padded.groupBy(*spec.by(BLK)).applyInPandas(run, schema)


def stage(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` once as a table in the shared folder and read it back.

    Plans that read one expensive intermediate several times (block totals,
    local scans, metrics) stage it, so that it is computed once, read back with
    column pruning, and survives lost executors. The folder is the one the
    cluster names in ``spark.checkpoint.dir``; a private one is made only for a
    local master.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/barspark-stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_LOCAL_FOLDERS: dict[str, str] = {}


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="barspark-")
    return _LOCAL_FOLDERS[context.applicationId]

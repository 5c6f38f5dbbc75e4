"""Bounded frames over a series, as ``Rolling`` builders for ``windowed``.

A frame yields null until it holds ``min_periods`` non-null values, the whole
frame by default.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.series import BLK, POS, Rolling, Running, Series, plain, running, windowed, with_blocks


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _frame(
    x: Column | str, n: int, agg: Callable[[Column], Column], min_periods: int | None = None, end: int = 0
) -> Rolling:
    x, need = _col(x), n if min_periods is None else min_periods

    def build(w: WindowSpec) -> Column:
        over = w.rowsBetween(end - n + 1, end)
        value = agg(x).over(over)
        return value if need <= 1 else F.when(F.count(x).over(over) >= need, value)

    return Rolling(build, back=n - 1 - end)


# --- neighbours -----------------------------------------------------------


def lag(x: Column | str, k: int = 1) -> Rolling:
    return Rolling(lambda w: F.lag(_col(x), k).over(w), back=k)


def lead(x: Column | str, k: int = 1) -> Rolling:
    return Rolling(lambda w: F.lead(_col(x), k).over(w), ahead=k)


def diff(x: Column | str, k: int = 1) -> Rolling:
    return Rolling(lambda w: _col(x) - F.lag(_col(x), k).over(w), back=k)


def pct_change(x: Column | str, k: int = 1) -> Rolling:
    return Rolling(lambda w: F.try_divide(_col(x), F.lag(_col(x), k).over(w)) - 1, back=k)


def forward_log_return(price: Column | str) -> Rolling:
    p = _col(price)
    return Rolling(lambda w: F.lead(F.log(p)).over(w) - F.log(p), ahead=1)


def forward_simple_return(price: Column | str) -> Rolling:
    p = _col(price)
    return Rolling(lambda w: F.try_divide(F.lead(p).over(w), p) - 1, ahead=1)


def turnover(weight: Column | str) -> Rolling:
    """Absolute weight change; the first bar pays for its whole weight."""
    x = _col(weight)
    return Rolling(lambda w: F.abs(x - F.coalesce(F.lag(x).over(w), F.lit(0.0))), back=1)


def sign_change(signal: Column | str) -> Rolling:
    """Buy (+) and sell (-) markers: difference of consecutive signals."""
    return diff(signal)


# --- rolling statistics -----------------------------------------------------


def rolling_sum(x, n, min_periods=None) -> Rolling:
    return _frame(x, n, F.sum, min_periods)


def sma(x, n, min_periods=None) -> Rolling:
    return _frame(x, n, F.avg, min_periods)


def rolling_std(x, n, min_periods=None) -> Rolling:
    return _frame(x, n, F.stddev_samp, min_periods)


def rolling_mean_abs(x, n, floor: float | None = None) -> Rolling:
    inner = _frame(F.abs(_col(x)), n, F.avg)
    if floor is None:
        return inner

    def build(w: WindowSpec) -> Column:
        value = inner.build(w)
        return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))

    return Rolling(build, back=inner.back)


def rolling_median(x: Column | str, n: int) -> Rolling:
    """The median of the last ``n`` values, null until all are there.

    A frame of Spark would sort ``n`` values for every row. Here the values of the frame
    stay in order while it slides: one goes out and one comes in, so the cost hardly
    depends on ``n``. Python gets the values in the order in which the window leaves them and
    a mask of those that begin a block; the other columns stay where they are.
    """
    begins = f"__begins_{uuid4().hex[:8]}"
    first = Rolling(lambda w: F.row_number().over(w) == 1)
    return Rolling(lambda _w: _sliding_median(n)(_col(x).cast("double"), F.col(begins)), back=n - 1, before=({begins: first},))


def _sliding_median(n: int):
    @F.pandas_udf("double")
    def slide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scan = SlidingMedian(n)  # blocks follow one another in a task
        for values, begins in batches:
            yield pd.Series(scan(values.to_numpy(float), begins.to_numpy(bool)))

    # It remembers rows, so the filter that takes the padding away must stay above it.
    return slide.asNondeterministic()


def with_rolling_median(df: DataFrame, spec: Series, x: str, n: int, name: str) -> DataFrame:
    """Add ``rolling_median`` of column ``x``."""
    return windowed(df, spec, {name: rolling_median(x, n)})


class SlidingMedian:
    """Median of each full window of ``n`` values that ends at a place; missing where one of them is."""

    def __init__(self, n: int) -> None:
        self.n, self.low, self.high = n, (n - 1) // 2, n // 2
        self.recent: deque[float] = deque()
        self.held: list[float] = []

    def __call__(self, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        out, recent, held, n = np.full(len(values), np.nan), self.recent, self.held, self.n
        for i, (value, first) in enumerate(zip(values.tolist(), begins.tolist())):
            if first:
                recent.clear()
                held.clear()
            if len(recent) == n:
                gone = recent.popleft()
                if gone == gone:
                    del held[bisect_left(held, gone)]
            recent.append(value)
            if value == value:
                insort(held, value)
            if len(held) == n:
                out[i] = (held[self.low] + held[self.high]) / 2
        return out


#: Frames of up to so many rows are scanned for each row; wider ones are put together from halves.
SCANNED = 32


def _extreme(x, n: int, agg: Callable[[Column], Column], of_two: Callable[..., Column], end: int) -> Rolling:
    """Largest or smallest of a full frame of ``n`` rows in about log2(n) steps a row.

    The extreme of 2w rows is that of w rows and of the w rows before them, and any frame
    is two overlapping ones of a power of two; the count of values comes from a running
    count. So the cost is nearly flat in ``n``, where Spark's own frames grow with it.
    """
    if n <= SCANNED:
        return _frame(x, n, agg, end=end)
    tag = f"__{'high' if of_two is F.greatest else 'low'}_{uuid4().hex[:8]}_"
    column = _col(x)
    steps = n.bit_length() - 1
    count = Rolling(lambda w: F.count(column).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = [{f"{tag}0": plain(column), f"{tag}n": count}]
    for k in range(steps):
        below = f"{tag}{k}"
        before.append({f"{tag}{k + 1}": Rolling(lambda w, c=below, far=1 << k: of_two(F.col(c), F.lag(c, far).over(w)))})
    widest, rest = f"{tag}{steps}", n - (1 << steps)

    def build(w: WindowSpec) -> Column:
        at = lambda c, far: F.lag(c, far).over(w) if far else F.col(c)
        seen = at(f"{tag}n", -end) - F.coalesce(F.lag(f"{tag}n", n - end).over(w), F.lit(0))
        return F.when(seen >= n, of_two(at(widest, -end), at(widest, rest - end)))

    return Rolling(build, back=n - end, before=tuple(before))


def prior_max(x, lookback) -> Rolling:
    """Highest value of the ``lookback - 1`` bars before the current one."""
    return _extreme(x, lookback - 1, F.max, F.greatest, end=-1)


def prior_min(x, lookback) -> Rolling:
    return _extreme(x, lookback - 1, F.min, F.least, end=-1)


def rolling_vwap(n: int, high="high", low="low", close="close", volume="volume") -> Rolling:
    """Volume-weighted typical price over up to ``n`` bars; null where no volume was seen."""
    typical = (_col(high) + _col(low) + _col(close)) / 3

    def build(w: WindowSpec) -> Column:
        over = w.rowsBetween(1 - n, 0)
        return F.try_divide(F.sum(typical * _col(volume)).over(over), F.sum(_col(volume)).over(over))

    return Rolling(build, back=n - 1)


def _gain_loss(price: Column | str, n: int) -> tuple[Callable, Callable]:
    """Average gain and average loss over n bar-to-bar moves, as frames over prices.

    The moves themselves are frame-relative, so both averages come from one
    pre-computed difference column named by ``moves``.
    """
    up = F.when(_col(price).isNotNull(), F.greatest(_col(price), F.lit(0.0)))
    down = F.when(_col(price).isNotNull(), F.greatest(-_col(price), F.lit(0.0)))
    return _frame(up, n, F.avg), _frame(down, n, F.avg)


def rsi(moves: Column | str, n: int) -> Rolling:
    """RSI from a column of bar-to-bar moves: 100 without losses, null without any move."""
    gain, loss = _gain_loss(moves, n)

    def build(w: WindowSpec) -> Column:
        g, d = gain.build(w), loss.build(w)
        return F.when((d == 0) & (g > 0), F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(g, d)))

    return Rolling(build, back=n - 1)


def rsi_centred(moves: Column | str, n: int) -> Rolling:
    """RSI with loss + 1e-8, scaled to [-1, 1]; null becomes 0."""
    gain, loss = _gain_loss(moves, n)

    def build(w: WindowSpec) -> Column:
        ratio = gain.build(w) / (loss.build(w) + 1e-8)
        return F.coalesce((100 - 100 / (1 + ratio) - 50) / 50, F.lit(0.0))

    return Rolling(build, back=n - 1)


def rolling_sharpe(x: Column | str, n: int, annual: float = 1.0) -> Rolling:
    mean, std = sma(x, n), rolling_std(x, n)
    return Rolling(lambda w: F.try_divide(mean.build(w), std.build(w)) * annual, back=n - 1)


def sharpe_layers(columns: dict[str, str], n: int, annual: float = 1.0) -> list[dict[str, Rolling]]:
    """Rolling Sharpe ratios ``name: column`` as layers for ``windowed``, in time that doesn't grow with ``n``.

    Prefix sums of the values less their block's mean give each frame's mean and
    variance as differences. Frames of one repeated value are told by a prefix count
    of changes, so rounding can't turn no variance into a little. The layers leave
    helper columns that begin with ``__sh_``.
    """
    first, second, third = {}, {}, {}

    def prefix(value: Column) -> Rolling:
        return Rolling(lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))

    def ratio(name: str, x: Column) -> Rolling:
        def build(w: WindowSpec) -> Column:
            def inside(c: str, back: int) -> Column:
                total = F.col(f"__sh_{c}_{name}")
                return total - F.coalesce(F.lag(total, back).over(w), F.lit(0.0))

            shift = inside("sum", n)
            spread = F.greatest(inside("square", n) - shift * shift / n, F.lit(0.0)) / (n - 1)
            value = F.try_divide(F.col(f"__sh_mean_{name}") + shift / n, F.sqrt(spread)) * annual
            return F.when((inside("count", n) >= n) & (inside("change", n - 1) > 0), value)

        return Rolling(build, back=n)

    for name, column in columns.items():
        x = F.col(column)
        off = x - F.col(f"__sh_mean_{name}")
        first[f"__sh_mean_{name}"] = Rolling(
            lambda w, x=x: F.avg(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        )
        first[f"__sh_moved_{name}"] = Rolling(lambda w, x=x: (x != F.lag(x).over(w)).cast("int"))
        second[f"__sh_sum_{name}"] = prefix(off)
        second[f"__sh_square_{name}"] = prefix(off * off)
        second[f"__sh_count_{name}"] = prefix(F.when(x.isNotNull(), 1.0))
        second[f"__sh_change_{name}"] = prefix(F.col(f"__sh_moved_{name}").cast("double"))
        third[name] = ratio(name, x)
    return [first, second, third]


def without_helpers(df: DataFrame) -> DataFrame:
    """Drop the helper columns of ``sharpe_layers``."""
    return df.drop(*[c for c in df.columns if c.startswith("__sh_")])


# --- exponential average ------------------------------------------------------


def ema(df: DataFrame, spec: Series, price: str, span: int, name: str) -> DataFrame:
    """Recursive exponential average, seeded with the first price that is there.

    A missing price keeps the average, and its bar still ages what came before: after
    ``g`` bars the old value weighs ``keep**g`` against the new one's ``1 - keep``, and
    the two are normalised. Each bar is thus an affine step; a block is summed up in
    two numbers, those of a series are composed in order (one row per block), and every
    block then runs from its carry. Nothing is cut off, whatever the span or block.
    """
    if span <= 1:
        x = _col(price).cast("double")
        return running(df, spec, {name: fill_forward(F.when(~F.isnan(x), x))})
    alpha = 2 / (span + 1)
    rows = with_blocks(df, spec)
    slim = rows.select(*spec.by(BLK, POS), _col(price).cast("double").alias("__x"))
    ends = T.StructType(
        [*[rows.schema[k] for k in spec.by(BLK)], *[T.StructField(c, T.DoubleType()) for c in ("first", "x", "last", "p", "q")]]
    )
    keys = list(spec.keys)

    def ends_of(block: pd.DataFrame) -> pd.DataFrame:
        row = block[[*keys, BLK]].head(1)
        block = block[block["__x"].notna()].sort_values(POS)
        if not len(block):
            return row.assign(**dict.fromkeys(("first", "x", "last", "p", "q"), np.nan))
        pos, x = block[POS].to_numpy(), block["__x"].to_numpy(float)
        gap = np.diff(pos).astype(float)
        tail = affine_scan(x[1:], gap, alpha, 0.0)
        grown = float(np.exp(np.log((1 - alpha) ** gap / ((1 - alpha) ** gap + alpha)).sum())) if len(gap) else 1.0
        return row.assign(first=float(pos[0]), x=x[0], last=float(pos[-1]), p=grown, q=tail[-1] if len(tail) else 0.0)

    start = T.StructType([*[rows.schema[k] for k in spec.by(BLK)], T.StructField("__before", T.DoubleType()), T.StructField("__seen", T.DoubleType())])

    def carried(blocks_: pd.DataFrame) -> pd.DataFrame:
        blocks_ = blocks_.sort_values(BLK)
        value, seen, out = None, None, []
        for block in blocks_.itertuples(index=False):
            out.append((value, seen))
            if pd.isna(block.first):
                continue
            gap = np.array([1.0 if seen is None else block.first - seen])
            at = affine_scan(np.array([block.x]), gap, alpha, value)[0]
            value, seen = block.p * at + block.q, block.last
        found = blocks_[[*keys, BLK]].copy()
        found["__before"], found["__seen"] = [v for v, _ in out], [s for _, s in out]
        return found.astype({"__before": float, "__seen": float})

    totals = slim.groupBy(*spec.by(BLK)).applyInPandas(ends_of, ends)
    if keys:
        carries = totals.groupBy(*keys).applyInPandas(carried, start)
    else:
        carries = totals.groupBy(F.lit(0)).applyInPandas(carried, start)
    done = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def finish(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(POS, kind="stable").reset_index(drop=True)
        x, pos = block[price].astype(float).to_numpy(), block[POS].to_numpy(float)
        before, seen = block["__before"].iloc[0], block["__seen"].iloc[0]
        there = np.flatnonzero(~np.isnan(x))
        value = np.full(len(x), before, float)
        if len(there):
            gap = np.diff(pos[there], prepend=pos[there[0]] - 1 if np.isnan(seen) else seen)
            average = affine_scan(x[there], gap, alpha, None if np.isnan(before) else before)
            held = np.searchsorted(there, np.arange(len(x)), "right") - 1
            value = np.where(held >= 0, average[np.maximum(held, 0)], before)
        block[name] = value
        return block[done.names]

    joined = rows.drop(name).join(carries.hint("merge"), spec.by(BLK))
    out = joined.groupBy(*spec.by(BLK)).applyInPandas(finish, done)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def affine_scan(x: np.ndarray, gap: np.ndarray, alpha: float, before: float | None) -> np.ndarray:
    """Exponential average at each x, ``gap`` bars after the one before; ``before``: the average so far, if any.

    Products of the weights are taken over stretches that lose at most 400 natural
    orders of magnitude, so they neither underflow nor need a loop over bars.
    """
    if not len(x):
        return np.zeros(0)
    weight = (1 - alpha) ** gap
    a, b = weight / (weight + alpha), alpha * x / (weight + alpha)
    if before is None:
        a[0], b[0], before = 0.0, x[0], 0.0
    depth = np.cumsum(-np.log(np.maximum(a, 1e-300)))
    cuts = np.flatnonzero(np.diff(np.floor(depth / 400))) + 1
    out = np.empty(len(x))
    for low, high in zip([0, *cuts], [*cuts, len(x)], strict=True):
        shrink = np.cumprod(np.concatenate([[1.0], a[low + 1 : high]]))
        inner = np.concatenate([[0.0], np.cumsum(b[low + 1 : high] / shrink[1:])])
        out[low:high] = shrink * (a[low] * before + b[low] + inner)
        before = out[high - 1]
    return out


# --- unbounded scans ------------------------------------------------------------


def cumulative_sum(x: Column | str) -> Running:
    return Running("sum", _col(x))


def cumulative_product(x: Column | str) -> Running:
    return Running("product", _col(x))


def expanding_max(x: Column | str) -> Running:
    return Running("max", _col(x))


def fill_forward(x: Column | str) -> Running:
    return Running("last", _col(x))


def fill_backward(x: Column | str) -> Running:
    return Running("next", _col(x))


def hold_until_opposite(df: DataFrame, spec: Series, signal: str, name: str) -> DataFrame:
    """Carry the last non-zero signal across zeros; 0 before the first."""
    out = running(df, spec, {name: Running("last", F.nullif(F.col(signal), F.lit(0.0)))})
    return out.withColumn(name, F.coalesce(name, F.lit(0.0)))


def run_ids(df: DataFrame, spec: Series, column: str, name: str = "run_id") -> DataFrame:
    """Number the stretches of equal consecutive values, from 1."""
    x = F.col(column)
    changed = Rolling(
        lambda w: F.when(F.lag(F.struct(x)).over(w) == F.struct(x), F.lit(0)).otherwise(F.lit(1)), back=1
    )
    out = windowed(df, spec, {"__changed": changed})
    return running(out, spec, {name: Running("sum", F.col("__changed"))}).drop("__changed")


def drawdown(
    df: DataFrame, spec: Series, simple_return: str, equity: str = "equity", name: str = "drawdown"
) -> DataFrame:
    """Compounded equity and its drop below the running peak, in one pass.

    Both scans need only three numbers per block (product, highest and lowest
    local equity), so the peak before a block follows from the block table.
    """
    growth = 1 + F.col(simple_return)
    rows = with_blocks(df, spec)
    upto = spec.window.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("__eq", F.product(growth).over(upto)).withColumns(
        {"__hi": F.max("__eq").over(upto), "__lo": F.min("__eq").over(upto)}
    )
    totals = local.groupBy(*spec.by(BLK)).agg(
        F.max_by("__eq", POS).alias("__total"), F.max("__eq").alias("__top"), F.min("__eq").alias("__bottom")
    )
    before = Window.partitionBy(*spec.keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    scale = F.coalesce(F.product("__total").over(before), F.lit(1.0))
    tops = totals.withColumn("__scale", scale).withColumn(
        "__blockpeak", F.col("__scale") * F.when(F.col("__scale") >= 0, F.col("__top")).otherwise(F.col("__bottom"))
    )
    carries = tops.select(*spec.by(BLK), "__scale", F.max("__blockpeak").over(before).alias("__peak"))
    here = F.col("__scale") * F.when(F.col("__scale") >= 0, F.col("__hi")).otherwise(F.col("__lo"))
    return (
        local.join(carries.hint("merge"), spec.by(BLK))
        .withColumn(equity, F.col("__scale") * F.col("__eq"))
        .withColumn(name, F.try_divide(F.col(equity), F.greatest(F.col("__peak"), here)) - 1)
        .drop("__eq", "__hi", "__lo", "__scale", "__peak")
    )

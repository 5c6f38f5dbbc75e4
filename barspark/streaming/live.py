"""Live bars, signals and positions with Structured Streaming.

Bars arrive as candle pages in a landing folder, are merged into the bar store,
and drive signals and positions. Every stage restarts from its checkpoint and
its result does not depend on how the input was cut into batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barspark.operators.folds import walk_forward_signals
from barspark.series import POS, ROWS, Series, positions
from barspark.sources.bars import candles, finalised, upsert_into

PAGE_SCHEMA = "mode string, symbol string, tf string, value string"
#: When and as which file a page arrived; of equal times in a batch the bar that arrived last wins.
ARRIVAL = {"file_modification_time": "__arrived", "file_name": "__file"}


# --- bars --------------------------------------------------------------------------


def candle_stream(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    """Candle pages of a landing folder as a stream of typed bars."""
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pages = reader.json(landing).select("*", *[F.col(f"_metadata.{m}").alias(a) for m, a in ARRIVAL.items()])
    return candles(pages)


def ingest(bars: DataFrame, root: str, spec: Series, checkpoint: str, now: Column | None = None, **trigger) -> StreamingQuery:
    """Merge finalised bars into the store. A re-fetched time overwrites, also in an earlier month.

    The page file written last wins, then its name, line and place in the page, however
    Spark packs the files and in whatever order batches bring them. The upsert is
    idempotent, so a batch replayed after a failure changes nothing.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        upsert_into(root, in_order(finalised(batch, now)).drop("close_ts"), spec, seq="__seq")

    return _start(bars, merge, checkpoint, trigger)


def in_order(bars: DataFrame) -> DataFrame:
    """Order of arrival as a text ``__seq``: file time, file name, then line (in a batch) and place within the file."""
    number = lambda c: F.lpad(c.cast("string"), 20, "0")
    known = []
    if set(ARRIVAL.values()) <= set(bars.columns):
        known = [number(F.unix_micros(F.col("__arrived").cast("timestamp"))), F.col("__file")]
    line = [] if bars.isStreaming else [number(F.monotonically_increasing_id())]  # increases along a file
    place = [number(F.col("__place"))] if "__place" in bars.columns else []
    return bars.withColumn("__seq", F.concat_ws("/", *known, *line, *place)).drop(*ARRIVAL.values(), "__place")


def _start(stream: DataFrame, work, checkpoint: str, trigger: dict) -> StreamingQuery:
    trigger = trigger or {"availableNow": True}
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**trigger).start()


# --- signals -------------------------------------------------------------------------


def retrain_length(length: int, rows: Column) -> Column:
    """Training bars when history may be short: max(50, min(length, rows - 5))."""
    return F.greatest(F.lit(50), F.least(F.lit(length), rows - 5))


def retrain_schedule(df: DataFrame, spec: Series, length: int, step: int) -> DataFrame:
    """Per bar: which fit is in force and whether this bar starts a new one."""
    rows = df if {POS, ROWS} <= set(df.columns) else positions(df, spec)
    fit = F.floor((F.col(POS) - length) / step)
    live = F.col(POS) >= length
    return rows.filter(live).withColumns({"fit": fit, "retrains": (F.col(POS) - length) % step == 0})


def latest_signals(store: DataFrame, spec: Series, strategy, length: int, step: int) -> DataFrame:
    """Signal of the newest bar of every series, from the fit its schedule prescribes.

    Only the bars the newest fold needs are read: the fold number follows from
    the series length alone, so restarting or re-batching gives the same signal.
    A series of at most ``length`` bars is fitted on its first ``retrain_length``
    bars; one without a bar after those 50 has a null signal.
    """
    rows = positions(store, spec)
    newest = F.floor((F.col(ROWS) - 1 - length) / step)
    begin = newest * step
    recent = rows.filter((F.col(ROWS) > length) & (F.col(POS) >= begin))
    moved = recent.withColumns({"__pos": F.col(POS), POS: F.col(POS) - begin, ROWS: F.col(ROWS) - begin})
    signals = walk_forward_signals(moved, spec, strategy, length, step)
    last = signals.filter(F.col(POS) == F.col(ROWS) - 1).withColumn(POS, F.col("__pos"))
    names = spec.by(spec.ts, POS, strategy.price, "signal")
    trained = retrain_length(length, F.col(ROWS))
    short = rows.filter(F.col(ROWS) <= length)
    enough = short.filter(F.col(ROWS) > trained)
    fitted = strategy.fit(positions(enough.filter(F.col(POS) < trained).drop(POS, ROWS), spec), spec)
    early = strategy.signals(enough, fitted, spec).filter(F.col(POS) == F.col(ROWS) - 1)
    none = short.filter((F.col(ROWS) <= trained) & (F.col(POS) == F.col(ROWS) - 1)).withColumn("signal", F.lit(None).cast("double"))
    parts = [part.select(*names[:-1], F.col("signal").cast("double").alias("signal")) for part in (last, early, none)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


class Queue:
    """Bars of one series that wait for their turn.

    A bar waits until one arrives that is ``delay`` later; then all that are old enough
    leave in time order, however batches brought them. Of equal times that still wait the
    one that arrived last counts. A bar at or before the last that left is late.
    """

    def __init__(self, last: int, newest: int, held: dict[int, tuple]) -> None:
        self.last, self.newest, self.held = last, newest, held

    def take(self, rows: list[tuple], delay: int) -> tuple[list[tuple], list[tuple]]:
        """(bars whose turn has come, late bars) after ``rows`` of (microseconds, ...) arrived in this order."""
        late = [r for r in rows if r[0] <= self.last]
        for row in rows:
            if row[0] > self.last:
                self.held[row[0]] = row
                self.newest = max(self.newest, row[0])
        ready = sorted(t for t in self.held if t <= self.newest - delay)
        if ready:
            self.last = ready[-1]
        return [self.held.pop(t) for t in ready], late


NEVER = -(1 << 62)


def _arrivals(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """Rows of a group, in order of arrival where the stream tells it, as plain values (None for missing)."""
    out = []
    for frame in frames:
        out += frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)
    return sorted(out, key=lambda r: r[-1]) if columns[-1] == "seq" else out


def _keyed(df: DataFrame, keys: tuple[str, ...], ts: str, values: dict[str, Column]) -> DataFrame:
    seq = F.col("__seq") if "__seq" in df.columns else F.lit("")
    return df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), *[c.cast("double").alias(n) for n, c in values.items()], seq.alias("seq"))


_QUEUE = [T.StructField("last", T.LongType()), T.StructField("newest", T.LongType()), T.StructField("times", T.ArrayType(T.LongType()))]


def signal_stream(bars: DataFrame, spec: Series, strategy, length: int, step: int, delay: int = 0, columns: tuple[str, ...] = ()) -> DataFrame:
    """Signals of a stream of bars, each from the fit that the retrain schedule prescribes.

    The state of a series is its bars since the newest fold began (at most ``length + step``),
    its number of bars, the bars that wait their turn, and the fitted parameters. A bar
    from number ``length`` on gives a row with its signal; a new fold is fitted when its
    first bar comes. So a batch costs what its new bars cost, and the signals are those of
    ``walk_forward_signals`` over all bars, however the stream was cut. A bar that comes too
    late (``delay`` seconds allow for disorder) gives a row with ``late`` set and no signal.

    ``columns``: what the strategy reads beside its price. It needs ``fit_bars(bars)``, which gives
    parameters that can be pickled, and ``signal_bars(bars, parameters)``.
    """
    names = list(dict.fromkeys([strategy.price, *columns]))
    keyed = _keyed(bars, spec.keys, spec.ts, {n: F.col(n) for n in names})
    doubles = T.ArrayType(T.DoubleType())
    state_type = T.StructType([
        *_QUEUE, *[T.StructField(f"held_{n}", doubles) for n in names], T.StructField("count", T.LongType()), T.StructField("fold", T.LongType()),
        T.StructField("fit", T.BinaryType()), *[T.StructField(f"ring_{n}", doubles) for n in names],
    ])
    keys = [keyed.schema[k] for k in spec.keys]
    output = T.StructType([
        *keys, T.StructField("us", T.LongType()), T.StructField(POS, T.LongType()), T.StructField("price", T.DoubleType()),
        T.StructField("fold", T.LongType()), T.StructField("signal", T.DoubleType()), T.StructField("late", T.BooleanType()),
    ])
    wide, width = delay * 1_000_000, len(names)

    def step_of(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            last, newest, times, *rest = state.get
            held = dict(zip(times, zip(times, *rest[:width])))
            count, fold, fit = rest[width : width + 3]
            ring = list(zip(*rest[width + 3 :]))
        else:
            last, newest, held, count, fold, fit, ring = NEVER, NEVER, {}, 0, -1, None, []
        queue = Queue(last, newest, held)
        ready, late = queue.take([r[:-1] for r in _arrivals(frames, ["us", *names, "seq"])], wide)
        made = [(*group, r[0], None, r[1], None, None, True) for r in late]
        params = pickle.loads(fit) if fit else None
        while ready:
            if count < length:  # not yet enough bars to train on
                part, ready = ready[: length - count], ready[length - count :]
                ring += [row[1:] for row in part]
                count += len(part)
                continue
            now = (count - length) // step
            if now != fold:
                ring, fold = ring[len(ring) - (count - now * step) :], now
                params = strategy.fit_bars(pd.DataFrame(ring[:length], columns=names, dtype=float))
                fit = pickle.dumps(params)
            room = now * step + length + step - count
            part, ready = ready[:room], ready[room:]
            ring += [row[1:] for row in part]
            signal = np.asarray(strategy.signal_bars(pd.DataFrame(ring, columns=names, dtype=float), params), float)[len(ring) - len(part) :]
            made += [(*group, row[0], count + i, row[1], fold, None if np.isnan(s) else float(s), False) for i, (row, s) in enumerate(zip(part, signal))]
            count += len(part)
        yield pd.DataFrame(made, columns=output.names).astype(object)
        rows = [queue.held[t] for t in sorted(queue.held)]
        state.update((
            queue.last, queue.newest, [r[0] for r in rows], *[[r[1 + i] for r in rows] for i in range(width)],
            count, fold, fit, *[[r[i] for r in ring] for i in range(width)],
        ))

    done = keyed.groupBy(*spec.keys).applyInPandasWithState(step_of, output, state_type, "append", "NoTimeout")
    return done.withColumn(spec.ts, F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")


# --- positions -------------------------------------------------------------------------


@dataclass(frozen=True)
class Book:
    """Rules of the paper book."""

    base_qty: float = 1.0
    max_notional: float | None = None
    fee_rate: float = 0.001
    loss_limit: float | None = None


def fills(book: Book, bars: list[tuple], account: tuple) -> tuple[list[tuple], tuple]:
    """Apply bars (microseconds, price, signal) in time order to an account (quantity, entry price, gross, fees)."""
    qty, entry, gross, fees = account
    out = []
    for us, price, signal in bars:
        if book.loss_limit is not None and gross - fees <= -abs(book.loss_limit):
            continue
        wants = signal is not None and signal > 0
        if wants and qty == 0:
            size = book.base_qty
            if book.max_notional is not None:
                size = min(size, abs(book.max_notional) / max(price, 1e-8))
            qty, entry, realized, action = size, price, None, "ENTER"
        elif not wants and qty > 0:
            size, realized, action = qty, (price - entry) * qty, "EXIT"
            gross, qty, entry = gross + realized, 0.0, 0.0
        else:
            continue
        fee = size * price * book.fee_rate
        fees += fee
        out.append((us, action, price, size, fee, realized, gross, fees, qty))
    return out, (qty, entry, gross, fees)


def position_stream(signals: DataFrame, key: str, ts: str, price: str, signal: str, book: Book, delay: int = 0) -> DataFrame:
    """Fills of a signal stream, one state per symbol, each bar applied at most once and in time order.

    The state is the account, the last applied time, and the bars of the last ``delay``
    seconds, which wait in case an earlier one is still to come. A bar that comes too late,
    or again after a restart, gives a row with action ``LATE`` and changes nothing.
    """
    keyed = _keyed(signals, (key,), ts, {"price": F.col(price), "signal": F.col(signal)}).withColumnRenamed(key, "symbol")
    numbers = ["price", "fill_qty", "fee", "realized_pnl", "gross_pnl", "fees_total", "position_qty"]
    output = T.StructType(
        [keyed.schema["symbol"], T.StructField("us", T.LongType()), T.StructField("action", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in numbers]]
    )
    doubles = T.ArrayType(T.DoubleType())
    account = [T.StructField(n, T.DoubleType()) for n in ("qty", "entry_price", "gross", "fees")]
    state_type = T.StructType([*account, *_QUEUE, T.StructField("prices", doubles), T.StructField("signals", doubles)])

    def step(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before, queue = (0.0, 0.0, 0.0, 0.0), Queue(NEVER, NEVER, {})
        if state.exists:
            *before, last, newest, times, prices, sides = state.get
            queue = Queue(last, newest, dict(zip(times, zip(times, prices, sides))))
        ready, late = queue.take([r[:-1] for r in _arrivals(frames, ["us", "price", "signal", "seq"])], delay * 1_000_000)
        made, after = fills(book, ready, tuple(before))
        made += [(us, "LATE", price, *[None] * 6) for us, price, _ in late]
        rows = [queue.held[t] for t in sorted(queue.held)]
        state.update((*after, queue.last, queue.newest, *[[r[i] for r in rows] for i in range(3)]))
        yield pd.DataFrame([(group[0], *m) for m in made], columns=output.names).astype(object)

    done = keyed.groupBy("symbol").applyInPandasWithState(step, output, state_type, "append", "NoTimeout")
    return done.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")

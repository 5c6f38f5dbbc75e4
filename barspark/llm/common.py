"""Helpers shared by the corpus operators: staging, column names, Arrow text slices, word hashes.

Nothing here knows an operator. ``word_slices`` turns an Arrow column of texts into
64-bit word hashes with array arithmetic over the UTF-8 bytes, so no Python object
is made per word; memory is bounded by ``SLICE_BYTES`` plus the hashes of one text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
#: A table of at most so many rows of a few numbers may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000

_PRIVATE: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only where that is unset and the master is local."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _PRIVATE:
        _PRIVATE[context.applicationId] = tempfile.mkdtemp(prefix="barspark-llm-")
    return _PRIVATE[context.applicationId]


class Stage:
    """Tables written to the shared folder and read back, which cuts lineage; ``drop`` removes one that is done with."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[tuple[DataFrame, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a staged table that no later plan reads."""
        for path in [p for d, p in self.paths if d is df]:
            self._delete(path)

    def clear(self) -> None:
        """Delete all tables of this stage, when what was made of them is written."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.release()

    def release(self) -> None:
        """Let the shuffle files of finished plans go: they do when the driver collects those plans, for which it may have no need for long."""
        self.spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand Python at most 8 MB (or one row) at a time: wide rows of long texts then need no memory by the thousand."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def text_column(df: DataFrame, column: str = "text") -> DataFrame:
    """Null texts become empty ones."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("")))


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have, whatever extra columns came along."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark a staged table for broadcast if it has at most ``BROADCAST_ROWS`` rows; leave it to a shuffle join otherwise."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def attach(df: DataFrame, few: DataFrame, key: str, salt: str, how: str = "inner") -> DataFrame:
    """Join one row per key onto many rows per key, whose ``salt`` column splits a hot key.

    The pairs (key, salt) that exist are counted out first: a key with few rows gets few
    copies of its one row, and no task gets more than a key's share of a salt.
    """
    copies = df.select(key, salt).distinct().join(few, key, how)
    return df.join(copies, [key, salt])


def numbered(df: DataFrame, stage: Stage, out: str, *order: Column | str) -> DataFrame:
    """Add ``out``, the place of each row (from 0) in the order given: ranges are sorted apart, then shifted by the counts before them."""
    at, part = fresh(df, "at"), fresh(df, "part")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = stage(rows.withColumn(part, F.shiftright(at, 33)))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias(out))  # one row per range
    shifts = counts.select(part, F.coalesce(F.sum(out).over(before), F.lit(0)).alias(out))
    place = F.col(out) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(shifts), part).withColumn(out, place).drop(at, part)


_GAP = re.compile(rb"[\t-\r ]")


def pieces(data: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in consecutive parts of about ``size`` bytes that end at white space."""
    first = 0
    while first < len(data):
        gap = _GAP.search(data, first + size)
        last = gap.end() if gap else len(data)
        yield data[first:last] if first or last < len(data) else data
        first = last


def arrow_map(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType
) -> DataFrame:
    """``mapInArrow`` with a kernel that ``make`` builds once per task and that sees bounded slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch):
                out = kernel(part)
                if out is not None and out.num_rows:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of at most ``SLICE_BYTES`` of text; one text longer than that is a part by itself."""
    places = [i for i, f in enumerate(batch.schema) if pa.types.is_string(f.type) or pa.types.is_large_string(f.type)]
    if batch.num_rows == 0:
        return
    if not places:
        yield batch
        return
    sizes = np.zeros(batch.num_rows, np.int64)
    for i in places:
        sizes += np.diff(offsets_of(batch.column(i)))
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def offsets_of(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the row offsets into them (from 0)."""
    offsets = offsets_of(column)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-and-shift rounds)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _draws(count: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to a word, and the value each has in a hash (A-Z count as a-z)."""

    member: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(separators: list[tuple[int, int]]) -> Alphabet:
        member = np.ones(256, bool)
        for low, high in separators:
            member[low : high + 1] = False
        value = _draws(256, 77)
        value[65:91] = value[97:123]
        return Alphabet(member, value)


#: Words between ASCII white space, and words of ASCII letters, digits and non-ASCII characters.
SPACED = Alphabet.of([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = Alphabet.of([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_STEP = 0x9E3779B97F4A7C13  # odd, so that it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = []


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < count:
        size = max(count, SLICE_BYTES + 1)
        steps = np.full(size, _STEP, np.uint64)
        back = np.full(size, pow(_STEP, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        _POWERS[:] = [np.multiply.accumulate(steps), np.multiply.accumulate(back)]
    return _POWERS[0], _POWERS[1]


def _words(data: np.ndarray, rows: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word. ``rows``: offsets at which a word cannot go on."""
    inside = alphabet.member[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cut = rows[(rows > 0) & (rows < len(data))]
    begins[cut], stops[cut - 1] = inside[cut], inside[cut - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(alphabet.value[data] * up[: len(data)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(column: pa.Array, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets of start and end of all words of a slice of texts in order, their hashes, and the row offsets into them."""
    data, rows = bytes_of(column)
    if len(data) <= 2 * SLICE_BYTES:
        starts, ends, hashes = _words(data, rows, alphabet)
        return starts, ends, hashes, np.searchsorted(starts, rows)
    starts, ends, hashes, first = [], [], [], 0  # long texts: in pieces that end outside words
    while first < len(data):
        last = min(first + SLICE_BYTES, len(data))
        while last < len(data) and alphabet.member[data[last]]:
            last += 1
        a, b, h = _words(data[first:last], rows[(rows > first) & (rows < last)] - first, alphabet)
        starts.append(a + first)
        ends.append(b + first)
        hashes.append(h)
        first = last
    places = np.concatenate(starts)
    return places, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(places, rows)


def word_hashes(column: pa.Array, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice of texts in order, and the row offsets into them."""
    return word_spans(column, alphabet)[2:]


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words that lies in one row, and the index of its first word."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = _draws(size, 1000 + size) | np.uint64(1)
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out += hashes[i : i + count] * factors[i]
    whole = np.ones(count, bool)
    for edge in rows[1:-1]:
        whole[max(0, edge - size + 1) : min(edge, count)] = False
    kept = np.flatnonzero(whole)
    return mix(out[kept]), kept


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


class HashTable:
    """64-bit hashes and a positive number for each: an open-addressing table in two arrays."""

    def __init__(self, bits: int) -> None:
        self.bits, self.held = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers, 0 where unknown."""
        out, todo = np.zeros(len(hashes), np.int32), np.arange(len(hashes))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            value = self.values[slot]
            hit = (self.keys[slot] == hashes[todo]) & (value > 0)
            out[todo[hit]] = value[hit]
            on = ~hit & (value > 0)
            slot, todo = (slot[on] + 1) & ((1 << self.bits) - 1), todo[on]
        return out

    def put(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Enter hashes that are not in the table yet; each once."""
        self.held += len(hashes)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.values[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = hashes[put], counts[put]
            left = np.ones(len(hashes), bool)
            left[put] = False
            hashes, counts, slot = hashes[left], counts[left], (slot[left] + 1) & ((1 << self.bits) - 1)

"""Repeated passages by content-defined chunking with a gear rolling hash.

The gear hash rolls over words (between ASCII white space): each word shifts the hash
by one bit and adds its own value, and bits above ``WORD_BITS`` see ``GEAR`` words.
A chunk ends where that hash is the smallest within ``REACH`` words on both sides, or
``LONGEST`` words after the last end. So ends depend on the words nearby alone: text
put in or taken out before a passage doesn't shift them. Chunks are deduplicated by a
64-bit digest; the first of all places of a chunk, by document id and position, keeps
it. A repeated passage is a run of chunks that all occur elsewhere too and that hold
at least ``least`` words together; a shared passage of more than 50 words always
contains such a run but for the words up to its first chunk end and after its last.

Null and empty texts have no chunks. Ids are taken to name documents: rows that repeat
an id and its text are one document and each is returned. Extra columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import SPACED, Stage, _powers, arrow_map, fresh, mix, signed, small_batches, text_column, word_hashes

GEAR = 4
WORD_BITS = 40
REACH = 3
LONGEST = 16
LEAST = 28


def chunk_ends(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Word offsets at which chunks end; every text ends one."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    gear = hashes & np.uint64((1 << 48) - 1)
    rolled = gear.copy()
    step = 1
    while step < GEAR:  # h = (h << 1) + gear(word), for a window of GEAR words, by doubling
        before = np.zeros(n, np.uint64)
        before[step:] = rolled[:-step]
        rolled = rolled + (before << np.uint64(step))
        step *= 2
    key = mix(rolled >> np.uint64(8))
    lowest = np.ones(n, bool)
    for d in range(1, REACH + 1):
        lowest[d:] &= key[d:] < key[:-d]
        lowest[:-d] &= key[:-d] <= key[d:]
    edges = rows[1:][np.diff(rows) > 0]
    lowest[edges - 1] = True
    ends = np.flatnonzero(lowest) + 1
    starts = np.concatenate([[0], ends[:-1]])
    more = (ends - starts - 1) // LONGEST
    if more.any():
        extra = np.repeat(starts, more) + LONGEST * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
        ends = np.sort(np.concatenate([ends, extra]))
    return ends


def digests(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digest of the words of each chunk."""
    up, down = _powers(len(hashes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def chunks(docs: DataFrame) -> DataFrame:
    """(id, n_words, digests, sizes): the chunks of each text (id, text)."""
    form = docs.schema["id"].dataType.simpleString()

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, rows = word_hashes(batch.column(1), SPACED)
            ends = chunk_ends(hashes, rows)
            own = np.searchsorted(ends, rows, "right").astype(np.int32)
            own[0] = 0
            sizes = np.diff(np.concatenate([[0], ends]))
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    signed(np.diff(rows)),
                    pa.ListArray.from_arrays(pa.array(own), signed(digests(hashes, ends)) if len(ends) else pa.array([], pa.int64())),
                    pa.ListArray.from_arrays(pa.array(own), pa.array(sizes.astype(np.int16))),
                ],
                ["id", "n_words", "digests", "sizes"],
            )

        return kernel

    return arrow_map(docs, make, f"id {form}, n_words long, digests array<long>, sizes array<smallint>")


Ranges = list[tuple[int, int]]
_RANGES = "array<struct<first: int, stop: int>>"


def passages(sizes: np.ndarray, repeated: np.ndarray, first: np.ndarray, least: int) -> tuple[Ranges, Ranges]:
    """Repeated passages, and what of them is to be cut, as (first word, end word)."""
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flags = np.concatenate([[False], repeated, [False]])
    change = np.flatnonzero(flags[1:] != flags[:-1])
    found, cuts = [], []
    for a, b in zip(change[0::2], change[1::2], strict=True):
        if starts[b] - starts[a] < least:
            continue
        found.append((int(starts[a]), int(starts[b])))
        later = np.concatenate([[False], ~first[a:b], [False]])
        edges = np.flatnonzero(later[1:] != later[:-1]) + a
        cuts += [(int(starts[c]), int(starts[d])) for c, d in zip(edges[0::2], edges[1::2], strict=True)]
    return found, cuts


def repeated_passages(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, n_chunks, repeated_words, removed_words, passages, cuts) per row; passages and cuts are word ranges."""
    small_batches(df.sparkSession)
    stage = Stage(df.sparkSession, "chunk-dedup")
    docs = text_column(df.select(F.col(id).alias("id"), F.col(text).alias("text")))
    rows = stage(chunks(docs))
    places = rows.select("id", F.posexplode("digests").alias("i", "digest"))
    at = F.struct("id", "i")
    known = places.groupBy("digest").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    known = stage(known.filter("first != last").select("digest", "first"))
    met = places.join(known, "digest").select("id", "i", (at == F.col("first")).alias("is_first"))
    marks = met.distinct().groupBy("id").agg(F.collect_list(F.struct("i", "is_first")).alias("marks"))

    @F.arrow_udf(f"struct<passages: {_RANGES}, cuts: {_RANGES}>")
    def judged(sizes: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ranges = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
        kind = pa.struct([("passages", ranges), ("cuts", ranges)])
        for own, marked in sizes:
            out = []
            for i in range(len(own)):
                size = own[i].values.to_numpy().astype(np.int64)
                repeated, first = np.zeros(len(size), bool), np.zeros(len(size), bool)
                entries = marked[i].values
                if entries is not None and len(entries):
                    where = entries.field("i").to_numpy()
                    flag = entries.field("is_first").to_numpy(zero_copy_only=False)
                    inside = where < len(size)
                    repeated[where[inside]] = True
                    first[where[inside]] = flag[inside]
                found, cuts = passages(size, repeated, first, least)
                out.append({"passages": _structs(found), "cuts": _structs(cuts)})
            yield pa.array(out, kind)

    light = rows.select("id", "n_words", "sizes")
    same = light["id"].eqNullSafe(marks["id"])
    both = light.join(marks, same, "left").select(light["id"], "n_words", "sizes", "marks")
    out = both.select("id", "n_words", F.size("sizes").alias("n"), judged("sizes", "marks").alias("seen"))
    return out.select(
        F.col("id").alias(id),
        "n_words",
        F.col("n").cast("long").alias("n_chunks"),
        _words_in(F.col("seen.passages")).alias("repeated_words"),
        _words_in(F.col("seen.cuts")).alias("removed_words"),
        F.col("seen.passages").alias("passages"),
        F.col("seen.cuts").alias("cuts"),
    )


def _structs(ranges: Ranges) -> list[dict[str, int]]:
    return [{"first": a, "stop": b} for a, b in ranges]


def _words_in(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + (r["stop"] - r["first"]))


def without_words(text: str, cuts: Ranges) -> str:
    """A text without the words of the ranges; white space after a cut word goes with it."""
    raw = text.encode()
    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] + [len(raw)]
    parts, at = [], 0
    for first, stop in cuts:
        parts.append(raw[at : starts[first]])
        at = starts[stop]
    return b"".join([*parts, raw[at:]]).decode()


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` with all but the first of the places of each repeated passage cut from its texts."""

    @F.arrow_udf("string")
    def cut(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in columns:
            pairs = zip(texts.to_pylist(), ranges.to_pylist(), strict=True)
            yield pa.array([t if not c else without_words(t, [(r["first"], r["stop"]) for r in c]) for t, c in pairs], pa.string())

    found = repeated_passages(df, id, text, least).filter("removed_words > 0")
    cuts, key = fresh(df, "cuts"), fresh(df, "key")
    found = found.select(F.col(id).alias(key), F.col("cuts").alias(cuts)).dropDuplicates([key])
    joined = df.join(found, df[id] == F.col(key), "left")
    shorter = F.when(F.col(cuts).isNotNull(), cut(F.coalesce(F.col(text), F.lit("")), F.col(cuts))).otherwise(F.col(text))
    return joined.withColumn(text, shorter).select(*df.columns)

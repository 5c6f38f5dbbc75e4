"""Benchmark decontamination: a prefix-filtered join of shingles, verified over item-sized windows.

A window is ``window`` consecutive words of a benchmark item, or the whole item if it
is shorter. A document is hit where a window occurs. Words are runs of ASCII letters,
digits and non-ASCII characters, A-Z lower-cased.

1. Windows become sets of word shingles (``shingle`` words each; whole items shorter
   than that are one shingle of their own length). A bitmap of fixed size holds all
   benchmark shingles, whatever their number; one pass over the texts keeps the
   stretches of each document whose shingles the bitmap knows.
2. Shingles are ordered by rarity, counted over all documents. As a window must be
   contained whole, the necessary prefix is its single rarest shingle; those prefix
   tokens are joined with the stretches.
3. A join partner gives the only place where the window can begin. It must lie within
   the stretch on both sides (length and position), and all its words must be equal.

Nulls and texts without words have no windows and no hits. Repeated rows are judged
one by one, by a row number given before the first stage is written. Extra columns
play no part. Words count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import ALNUM, Stage, arrow_map, signed, small, small_batches, text_column, windows, word_hashes

#: log2 of the bits in the map of benchmark shingles: 8 MB, for any benchmark.
MAP_BITS = 26


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), signed(np.concatenate([np.zeros(0, np.uint64), *parts])))


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, name, words, shingles, size) for each window of each item; ``items`` is (item string, text)."""

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, rows = word_hashes(batch.column(1), ALNUM)
            owner, names, words, shingles, sizes = [], [], [], [], []
            for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
                length = min(window, b - a)
                if not length:
                    continue
                size = min(shingle, length)
                for start in range(a, b - length + 1):
                    own = hashes[start : start + length]
                    span = np.array([0, length])
                    owner.append(i)
                    names.append(windows(own, span, length)[0])
                    words.append(own)
                    shingles.append(windows(own, span, size)[0])
                    sizes.append(size)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int32())),
                    signed(np.concatenate([np.zeros(0, np.uint64), *names])),
                    _lists(words),
                    _lists(shingles),
                    pa.array(sizes, pa.int32()),
                ],
                ["item", "name", "words", "shingles", "size"],
            )

        return kernel

    return arrow_map(items, make, "item string, name long, words array<long>, shingles array<long>, size int")


def _map_of(found: DataFrame) -> np.ndarray:
    """Bitmap of the ``shingle`` column by leading bits; at most 2**(MAP_BITS - 6) words reach the driver."""
    bit = F.shiftrightunsigned("shingle", 64 - MAP_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = found.select(F.shiftright(bit, 6).alias("slot"), one.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    table = words.toArrow()
    held = np.zeros(1 << (MAP_BITS - 6), np.int64)
    held[table["slot"].to_numpy()] = table["bits"].to_numpy()
    return held


def stretches(docs: DataFrame, maps: dict[int, np.ndarray]) -> DataFrame:
    """(row, id, n_words, runs): maximal stretches whose shingles all are in the map of their size."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def make():
        known = shared.value

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, rows = word_hashes(batch.column(2), ALNUM)
            row_of, sizes, at, words, shingles = [], [], [], [], []
            for size, held in known.items():
                grams, first = windows(hashes, rows, size)
                bit = (grams >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                hit = np.flatnonzero((held[bit >> 6] >> (bit & 63)) & 1)
                if not len(hit):
                    continue
                place = first[hit]
                doc = np.searchsorted(rows, place, "right") - 1
                cuts = np.flatnonzero((np.diff(place) != 1) | (np.diff(doc) != 0)) + 1
                for low, high in zip(np.append(0, cuts).tolist(), np.append(cuts, len(hit)).tolist(), strict=True):
                    begin, end = int(place[low]), int(place[high - 1]) + size
                    row_of.append(int(doc[low]))
                    sizes.append(size)
                    at.append(begin - int(rows[doc[low]]))
                    words.append(hashes[begin:end])
                    shingles.append(grams[hit[low:high]])
            order = np.argsort(np.array(row_of, np.int64), kind="stable")
            ends = np.searchsorted(np.array(row_of, np.int64)[order], np.arange(batch.num_rows + 1))
            runs = pa.StructArray.from_arrays(
                [
                    pa.array([sizes[i] for i in order], pa.int32()),
                    pa.array([at[i] for i in order], pa.int32()),
                    _lists([words[i] for i in order]),
                    _lists([shingles[i] for i in order]),
                ],
                ["size", "at", "words", "shingles"],
            )
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), signed(np.diff(rows)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)],
                ["row", "id", "n_words", "runs"],
            )

        return kernel

    form = "row long, id {}, n_words long, runs array<struct<size: int, at: int, words: array<long>, shingles: array<long>>>"
    return arrow_map(docs, make, form.format(docs.schema["id"].dataType.simpleString()))


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, stop) spans."""
    none = F.struct(F.lit(0).alias("total"), F.lit(0).alias("stop"))
    return F.aggregate(
        spans,
        none,
        lambda s, x: F.struct(
            (s["total"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["stop"], x["start"]))).alias("total"),
            F.greatest(s["stop"], x["stop"]).alias("stop"),
        ),
        lambda s: s["total"].cast("long"),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    shingle: int = 5,
) -> DataFrame:
    """(id, n_words, n_hit, items) per row of ``docs``: words, words inside occurrences, and the sorted items that occur."""
    small_batches(docs.sparkSession)
    stage = Stage(docs.sparkSession, "decontaminate")
    source = text_column(benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")))
    every = stage(item_windows(source, window, shingle))
    distinct = every.groupBy("name", "size").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"))
    tokens = stage(distinct.select("name", "size", "words", F.posexplode("shingles").alias("offset", "shingle")))
    sizes = [r["size"] for r in tokens.select("size").distinct().collect()]  # at most ``shingle`` numbers
    maps = {s: _map_of(tokens.filter(F.col("size") == s).select("shingle").distinct()) for s in sorted(sizes)}

    source = text_column(docs.select(F.col(id).alias("id"), F.col(text).alias("text")))
    source = source.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    rows = stage(stretches(source, maps))
    runs = rows.select("row", F.explode("runs").alias("run")).select("row", "run.*")

    # rarity over all documents, and each window's rarest shingle
    counts = runs.select("size", F.explode("shingles").alias("shingle")).groupBy("size", "shingle").count()
    rarest = F.min(F.struct("count", "shingle", "offset")).alias("rarest")
    prefix = tokens.join(counts, ["size", "shingle"], "left").groupBy("name", "size", F.size("words").alias("length"))
    prefix = prefix.agg(F.min(F.coalesce("count", F.lit(0))).alias("least"), rarest, F.first("words").alias("wanted"))
    prefix = stage(prefix.filter("least > 0").select("name", "size", "length", "wanted", "rarest.shingle", "rarest.offset"))

    # each shingle of a stretch with the words that a window through it can reach
    reach = window - shingle
    near = F.expr(
        f"transform(shingles, (s, i) -> struct(s AS shingle, i AS i, slice(words, greatest(i - {reach}, 0) + 1, {2 * window}) AS around))"
    )
    places = runs.select("row", "size", "at", F.size("words").alias("held"), F.inline(near))
    met = places.join(small(prefix), ["size", "shingle"])
    start, skipped = F.col("i") - F.col("offset"), F.greatest(F.col("i") - reach, F.lit(0))
    inside = (start >= 0) & (start + F.col("length") <= F.col("held"))
    same = F.slice("around", start - skipped + 1, F.col("length")) == F.col("wanted")
    met = met.filter(inside).filter(F.when(inside, same)).withColumn("start", F.col("at") + start)
    met = stage(met.select("row", "name", "start", (F.col("start") + F.col("length")).alias("stop")).distinct())

    hits = met.groupBy("row").agg(_covered(F.sort_array(F.collect_set(F.struct("start", "stop")))).alias("n_hit"))
    owners = every.filter("item IS NOT NULL").select("name", "item").distinct()
    named = met.select("row", "name").distinct().join(owners, "name").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.select("row", "id", "n_words").join(hits, "row", "left").join(named, "row", "left")
    return out.select(
        F.col("id").alias(id),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def is_contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (n_hit > 0) & (share * n_hit >= n_words)

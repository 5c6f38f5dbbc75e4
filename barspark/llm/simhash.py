"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into ``distance // 2 + 1`` segments, so two
fingerprints that differ in at most ``distance`` bits agree in one segment up to at
most one bit. Each segment value is indexed as it is and once per bit position with
that bit left out (a one-wildcard variant). Fingerprints whose segment is equal meet
under the value itself; those that differ in exactly one bit meet under the variant
without that bit, one with the bit set and one without, so each meeting happens once
per segment. What meets is compared bit by bit: the links are exact.

Equal fingerprints are one entry. A segment value shared by more than ``TILE``
fingerprints is dealt into tiles, every pair of tiles being a group of its own. Within
a group links are reported as a spanning forest, at most one per member, so large
groups of near copies stay linear.

Null texts count as empty, and an empty text has fingerprint 0. Rows are never merged:
null or repeated ids are rows like others, ``component_id`` being the smallest id that
isn't null (null if there is none). Other columns are ignored, an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.llm.common import Stage, arrow_map, attach, bytes_of, fresh, pieces, signed, small, small_batches, text_column
from barspark.llm.components import components

SEED = 42
TILE = 2048
#: Runs of up to so many fingerprints are compared with array arithmetic over all runs at once.
SHORT = 64


def shingle_hashes(data: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``size`` words, in portions; of the whole sequence if it is shorter; nothing without words."""
    last: list[bytes] = []
    whole = True
    for piece in pieces(data):
        words = last + piece.lower().split()
        if len(words) < size:
            last = words
            continue
        whole = False
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - size] + 1).tolist()]
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)
        last = words[len(words) - size + 1 :]
    if whole and last:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(last), SEED)], np.uint64)


def simhash(data: bytes, size: int = 4) -> int:
    """A bit is 1 if it is set in over half the shingle hashes."""
    count, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(data, size):
        count += len(hashes)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit number."""
    rows = text_column(docs.select(F.col(id).alias("id"), F.col(text).alias("text")))

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, edges = bytes_of(batch.column(1))
            raw, edges = data.tobytes(), edges.tolist()
            prints = np.array([simhash(raw[a:b], size) for a, b in zip(edges, edges[1:])], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), signed(prints)], ["id", "fp"])

        return kernel

    return arrow_map(rows, make, T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())]))


def _segments(fp: Column, distance: int) -> Column:
    """Array of (seg, width, value)."""
    count = distance // 2 + 1
    edges = [round(64 * i / count) for i in range(count + 1)]
    cut = [
        F.struct(
            F.lit(i).alias("seg"),
            F.lit(high - low).alias("width"),
            F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1)).alias("value"),
        )
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    ]
    return F.array(*cut)


def _variants(segments: DataFrame) -> DataFrame:
    """``key`` and ``side`` of the value itself (side 2) and of each one-wildcard variant (side: the bit left out).

    The key holds the segment's number, the wildcard's place and the remaining bits.
    """
    wild = segments.withColumn("place", F.explode(F.expr("sequence(-1, width - 1)")))
    rest = F.expr("(value & (shiftleft(1L, place) - 1)) | shiftleft(shiftright(value, place + 1), place)")
    return wild.select(
        *[c for c in segments.columns if c not in ("seg", "width", "value")],
        F.shiftleft((F.col("seg") * 64 + F.col("place") + 1).cast("long"), 32).bitwiseOR(F.when(F.col("place") < 0, F.col("value")).otherwise(rest)).alias("key"),
        F.when(F.col("place") < 0, F.lit(2)).otherwise(F.expr("shiftright(value, greatest(place, 0)) & 1").cast("int")).alias("side"),
    )


def links(prints: DataFrame, distance: int, stage: Stage) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (``fp``) that differ in at most ``distance`` bits: a spanning forest per group."""
    segments = prints.select("fp", F.inline(_segments(F.col("fp"), distance)))
    tiles = F.ceil(F.col("count") / F.lit(TILE)).cast("int")
    crowded = segments.groupBy("seg", "width", "value").count().filter(F.col("count") > TILE).withColumn("tiles", tiles)
    dealt = _variants(crowded.drop("count")).groupBy("key").agg(
        F.coalesce(F.max(F.when(F.col("side") != 1, F.col("tiles"))), F.lit(1)).alias("zeros"),
        F.coalesce(F.max(F.when(F.col("side") != 0, F.col("tiles"))), F.lit(1)).alias("ones"),
    )
    rows = _variants(segments).join(small(stage(dealt)), "key", "left")
    zeros, ones, side = F.coalesce("zeros", F.lit(1)), F.coalesce("ones", F.lit(1)), F.col("side")
    own = F.pmod(F.xxhash64("fp"), F.when(side == 1, ones).otherwise(zeros)).cast("int")
    other = F.when(side == 1, zeros).otherwise(ones)
    rows = rows.select("key", "fp", "side", own.alias("own"), F.explode(F.sequence(F.lit(0), other - 1)).alias("to"))
    # Members of one value meet tile by tile: within a tile all with all, else those of the lower with those of the higher.
    lower = (side == 0) | ((side == 2) & (F.col("own") <= F.col("to")))
    tile = F.when(lower, F.shiftleft(F.col("own").cast("long"), 32) + F.col("to")).otherwise(F.shiftleft(F.col("to").cast("long"), 32) + F.col("own"))
    half = F.when((side != 2) | (F.col("own") == F.col("to")), side).otherwise((F.col("own") > F.col("to")).cast("int"))
    placed = rows.select("key", tile.alias("tile"), half.cast("byte").alias("side"), "fp")
    small_batches(prints.sparkSession)
    sorted_rows = placed.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return sorted_rows.mapInArrow(lambda batches: _meet(batches, distance), "a long, b long")


def _meet(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal (key, tile); a run that goes on in the next batch waits for it."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            now = [np.concatenate(pair) for pair in zip(held, now, strict=True)]
        edges = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
        if not len(edges):
            held = now
            continue
        held = [c[edges[-1] :] for c in now]
        yield _links_of([c[: edges[-1]] for c in now], np.concatenate([[0], edges]), distance)
    if held is not None:
        yield _links_of(held, np.array([0, len(held[0])]), distance)


def _links_of(rows: list[np.ndarray], edges: np.ndarray, distance: int) -> pa.RecordBatch:
    side, prints = rows[2], rows[3].astype(np.int64).view(np.uint64)
    length = np.diff(edges)
    left = np.repeat(np.where(length <= SHORT, edges[1:], edges[:-1]), length)  # where the short run of a row ends
    a, b, place = [], [], np.arange(len(prints))
    for step in range(1, SHORT):
        place = place[place + step < left[place]]
        if not len(place):
            break
        x, y = place, place + step
        met = ((side[x] == 2) | (side[x] != side[y])) & (np.bitwise_count(prints[x] ^ prints[y]) <= distance)
        a.append(x[met])
        b.append(y[met])
    pairs = _forest(np.concatenate(a).tolist(), np.concatenate(b).tolist()) if a else []
    for i in np.flatnonzero(length > SHORT):
        pairs += _walk(prints, side, int(edges[i]), int(edges[i + 1]), distance)
    ends = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([signed(prints[ends[:, 0]]), signed(prints[ends[:, 1]])], ["a", "b"])


def _forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The links that join what earlier ones have not joined."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    for x, y in zip(a, b, strict=True):
        one, two = top(x), top(y)
        if one != two:
            parent[two] = one
            kept.append((x, y))
    return kept


def _walk(prints: np.ndarray, side: np.ndarray, first: int, stop: int, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of one long run: each member reached is compared with those not reached yet."""
    unseen, kept = np.arange(first, stop), []
    while len(unseen):
        todo, unseen = [int(unseen[0])], unseen[1:]
        while todo and len(unseen):
            x = todo.pop()
            near = np.bitwise_count(prints[unseen] ^ prints[x]) <= distance
            if side[x] != 2:
                near &= side[unseen] != side[x]
            found = unseen[near].tolist()
            kept += [(x, y) for y in found]
            todo += found
            unseen = unseen[~near]
    return kept


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component_id) of each row: its fingerprint and the smallest id reachable over links."""
    if not 2 <= distance <= 31:
        raise ValueError("distance must lie between 2 and 31")
    stage = Stage(docs.sparkSession, "simhash")
    rows = stage(fingerprints(docs, id, text, size).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(64))))
    prints = stage(rows.select("fp").distinct())
    roots = components(stage(links(prints, distance, stage)), stage)
    rows = attach(rows, roots.select(F.col("id").alias("fp"), "root"), "fp", "salt", "left")
    rows = stage(rows.withColumn("root", F.coalesce("root", "fp")))
    least = rows.groupBy("root").agg(F.min("id").alias("component_id"))
    name = fresh(docs.select(id), "component_id")
    return attach(rows, least, "root", "salt").select(F.col("id").alias(id), F.col("fp"), F.col("component_id").alias(name))

"""Exact Jaccard self-join of word n-gram sets: size-banded tiles, bitmap bounds, sorted-array intersection.

Two documents link when ``100 * |A and B| >= percent * |A or B|`` over their sets of
word n-grams (words between ASCII white space, A-Z lower-cased; a text of fewer words
than ``size`` is one n-gram of its own; an empty one links with nothing).

1. Sizes fall into bands. Linked sets differ in at most ``(100 - percent) / percent``
   of the smaller one's size, so a band has a largest number of differences D. The
   hash space is cut into more than D segments: linked sets agree in at least one
   whole segment. A tile is (band, segment, hash of what the set has there); a set
   enters the tiles of its band, and of the next lower band if a partner can be there.
   Empty segments say nothing and are left out; there are ``spare`` more segments than
   D + 1, and a set with more empty ones than that enters tiles of further cuts too.
   So no link is lost, and tiles follow the input, however common single n-grams are.
2. Equal sets collapse to one class before tiles are dealt, and copies within a task
   enter no tiles at all.
3. In a tile, everyone is compared with its smallest member; linked members are joined
   to components. Tiles with the same smallest member then form one star, and only
   pairs of a star in different components remain. Stars are dealt in squares of at
   most ``SQUARE`` members a side, so a large one is spread over many tasks.
4. A pair is first bounded from above by hashed bitmaps: a bit that A has and B lacks
   stands for at least one n-gram outside the overlap. A square is bounded by array
   arithmetic; members that the bound leaves a partner are met there once more with the
   sorted arrays of their n-gram hashes. Those are intersected until the square's
   components are joined: a square gives at most one link for each member, never its pairs.

Copies are never expanded into pairs. N-grams count as equal when their 64-bit hashes
are. Every row is a document, whatever its id: rows get numbers, and ids are looked at
only for the smallest one of a component (null if all are null; an empty text has its
own). Null texts are empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barspark.llm.common import SPACED, Stage, arrow_map, attach, fresh, mix, signed, small, small_batches, text_column, windows, word_hashes
from barspark.llm.components import components

CUTS = 3  # ways to cut the hash space, for sets with many empty segments
SQUARE = 2048  # members of a star on each side of what one task compares at once
SQUARE_GRAMS = 8_000_000  # n-grams of those members (64 MB a side), as hashing deals them; one text is never cut
PARTS = 4  # tiles are dealt in so many parts, one after the other, so that the shuffle files of one stand at a time
SEEN = 200_000  # sets that a task remembers in order to pass over copies

_SETS = "own long, mark long, n int, h1 long, h2 long, bits binary, tiles array<long>"


class Band:
    """Sizes ``low`` to ``high`` of the smaller set of a pair, and how the hash space is cut for them."""

    def __init__(self, number: int, low: int, high: int, percent: int) -> None:
        self.number, self.low, self.high = number, low, high
        self.differences = (100 - percent) * high // percent
        self.spare = 0
        for _ in range(3):  # about as many spare segments as a smallest set leaves empty; at most half of D, any number is right
            empty = (self.differences + 1 + self.spare) * math.exp(-low / (self.differences + 1 + self.spare))
            self.spare = min(self.differences // 2, math.ceil(empty + 2 * math.sqrt(empty)))
        self.segments = self.differences + 1 + self.spare
        steps = [-(-(j << 32) // self.segments) << 32 for j in range(1, self.segments)]
        self.edges = np.array(steps, np.uint64)
        self.names = mix(np.arange(1, self.segments + 2, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(number << 8))

    def tiles(self, grams: np.ndarray) -> np.ndarray:
        """Hashes of the tiles that a sorted set enters in this band."""
        if self.differences == 0:  # only equal sets link
            return np.zeros(0, np.uint64)
        out = []
        for cut in range(CUTS):
            own = grams if cut == 0 else np.sort(mix(grams + np.uint64(cut)))
            places = np.concatenate([[0], np.searchsorted(own, self.edges), [len(own)]])
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own ^ np.uint64(0x5851F42D4C957F2D)))])
            full = np.flatnonzero(places[1:] > places[:-1])
            content = total[places[1:][full]] - total[places[:-1][full]]
            out.append(mix(content + self.names[full] + np.uint64(cut)))
            if self.segments - len(full) <= self.spare:
                break
        else:  # many empty segments in every cut: those sets meet in a tile of their own
            out.append(self.names[-1:])
        return np.concatenate(out)


@lru_cache(maxsize=8)
def bands(percent: int) -> list[_Lazy]:
    """Bands for sets of up to 2**31 n-grams, more than a text can hold; each half as wide as its lowest size."""
    out, low = [], 1
    while low < 1 << 31:
        nxt = max(low + 1, low * 3 // 2)
        out.append((low, nxt - 1))
        low = nxt
    return [_Lazy(i, a, b, percent) for i, (a, b) in enumerate(out)]


class _Lazy:
    """A band whose arrays are made when a set first falls into it."""

    def __init__(self, *args: int) -> None:
        self.args, self.made = args, None
        self.low, self.high = args[1], args[2]

    def get(self) -> Band:
        if self.made is None:
            self.made = Band(*self.args)
        return self.made


def band_of(n: int, percent: int) -> int:
    table = bands(percent)
    for i, b in enumerate(table):
        if n <= b.high:
            return i
    return len(table) - 1


def width(low: int) -> int:
    """Bits of the bitmaps of a band."""
    return min(1 << 16, max(64, 1 << (4 * low - 1).bit_length()))


def bitmap(grams: np.ndarray, bits: int) -> bytes:
    """A bit for each n-gram by the leading bits of a hash, so halving the width joins neighbours."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    held = np.zeros(bits, bool)
    held[((grams * np.uint64(0xD1342543DE82EF95)) >> shift).astype(np.int64)] = True
    return np.packbits(held).tobytes()


def at_most(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> int:
    """Upper bound of the overlap of two sets."""
    a, b = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    while len(a) > len(b):
        a = _halved(a)
    while len(b) > len(a):
        b = _halved(b)
    return min(n_a - int(np.bitwise_count(a & ~b).sum()), n_b - int(np.bitwise_count(b & ~a).sum()))


def _halved(bits: np.ndarray) -> np.ndarray:
    held = np.unpackbits(bits)
    return np.packbits(held[0::2] | held[1::2])


def links(n_a: int, n_b: int, overlap: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def gram_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted array of the different n-grams of each text."""
    hashes, rows = word_hashes(column, SPACED)
    grams, first = windows(hashes, rows, size)
    cuts = np.searchsorted(first, rows).tolist()
    out = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            out.append(np.unique(grams[a:b]))
        elif rows[i + 1] > rows[i]:
            own = hashes[rows[i] : rows[i + 1]]
            out.append(windows(own, np.array([0, len(own)]), len(own))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets(df: DataFrame, size: int, percent: int) -> DataFrame:
    """One light row per document: set size, 128-bit digest, bitmap and tiles (none for copies seen in the same task)."""

    def make():
        seen: set[tuple[int, int]] = set()

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            table = bands(percent)
            counts, firsts, seconds, bitmaps, tiles, ends = [], [], [], [], [np.zeros(0, np.uint64)], [0]
            for grams in gram_sets(batch.column(1), size):
                n = len(grams)
                h1, h2 = int(grams.sum(dtype=np.uint64)), int(mix(grams + np.uint64(99)).sum(dtype=np.uint64))
                counts.append(n)
                firsts.append(h1)
                seconds.append(h2)
                new = n > 0 and (h1, h2) not in seen
                own = []
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((h1, h2))
                    at = band_of(n, percent)
                    own.append(table[at].get().tiles(grams))
                    if at and 100 * table[at - 1].high >= percent * n:
                        own.append(table[at - 1].get().tiles(grams))
                    tiles += own
                made = sum(map(len, own))
                bitmaps.append(bitmap(grams, width(table[band_of(n, percent)].low)) if made else None)
                ends.append(ends[-1] + made)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(counts, pa.int32()),
                    signed(np.array(firsts, np.uint64)),
                    signed(np.array(seconds, np.uint64)),
                    pa.array(bitmaps, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(np.concatenate(tiles))),
                ],
                ["own", "mark", "n", "h1", "h2", "bits", "tiles"],
            )

        return kernel

    return arrow_map(df, make, _SETS)


def sorted_sets(df: DataFrame, size: int) -> DataFrame:
    """(id, grams): the sorted n-gram hashes of each text as bytes."""

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            grams = [g.tobytes() for g in gram_sets(batch.column(1), size)]
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(grams, pa.binary())], ["id", "grams"])

        return kernel

    return arrow_map(df, make, "id long, grams binary")


def _bounded(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that their bitmaps let through."""

    @F.arrow_udf("boolean")
    def possible(n_a: pa.Array, bits_a: pa.Array, n_b: pa.Array, bits_b: pa.Array) -> pa.Array:
        columns = [c.to_pylist() for c in (n_a, bits_a, n_b, bits_b)]
        return pa.array([links(na, nb, at_most(na, a, nb, b), percent) for na, a, nb, b in zip(*columns, strict=True)])

    with_a = pairs.join(facts.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a")
    both = with_a.join(facts.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return both.filter(fits).filter(possible("n_a", "bits_a", "n_b", "bits_b")).select("a", "b")


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many hashes two sorted arrays share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def _square(rows: list[dict], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of a square, and those after it in another component that its bitmap lets through; ``side`` tells the two sides apart."""
    least = min(len(r["bits"]) for r in rows)
    packed = []
    for r in rows:
        bits = np.frombuffer(r["bits"], np.uint8)
        while len(bits) > least:
            bits = _halved(bits)
        packed.append(bits)
    words = np.ascontiguousarray(np.stack(packed)).view(np.uint64)
    ids, roots, sides = (np.array([r[c] for r in rows], np.int64) for c in ("id", "root", "side"))
    n = np.array([r["n"] for r in rows], np.int64)
    held = np.bitwise_count(words).sum(1).astype(np.int64)
    cross = rows[0]["i"] != rows[0]["j"]
    for first in range(0, len(rows), 256):
        part = slice(first, first + 256)
        shared = np.zeros((len(ids[part]), len(rows)), np.int64)
        for w in range(words.shape[1]):
            shared += np.bitwise_count(words[part, w, None] & words[None, :, w])
        bound = np.minimum((n - held)[part, None], (n - held)[None, :]) + shared
        fits = (ids[part, None] < ids[None, :]) & (roots[part, None] != roots[None, :])
        fits &= 100 * bound >= percent * (n[part, None] + n[None, :] - bound)
        if cross:
            fits &= sides[part, None] != sides[None, :]
        for at in np.flatnonzero(fits.any(1)).tolist():
            yield first + at, np.flatnonzero(fits[at])


def _open(rows: list[dict], percent: int) -> list[dict]:
    """Members of a square that may link with another one of it."""
    found = np.zeros(len(rows), bool)
    for at, others in _square(rows, percent):
        found[at] = True
        found[others] = True
    return [{c: rows[i][c] for c in ("star", "i", "j", "side", "id", "root")} for i in np.flatnonzero(found).tolist()]


def _joined(rows: list[dict], percent: int) -> list[dict]:
    """Links of a square that join two of its components, by exact sets: at most one for each member, not one for each pair."""
    label = np.unique([r["root"] for r in rows], return_inverse=True)[1]
    grams = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    out = []
    for at, others in _square(rows, percent):
        for other in others.tolist():
            if label[at] != label[other] and links(len(grams[at]), len(grams[other]), _overlap(grams[at], grams[other]), percent):
                label[label == label[other]] = label[at]
                out.append({"a": rows[at]["id"], "b": rows[other]["id"]})
    return out


def _by_square(dealt: DataFrame, work: Callable[[list[dict], int], list[dict]], percent: int, schema: str) -> DataFrame:
    """Rows that ``work`` gives for the members of each square (star, i, j)."""
    key = ["star", "i", "j"]
    kinds = T.StructType.fromDDL(schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(found, to_arrow_schema(kinds))

        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                at = (r["star"], r["i"], r["j"])
                if at != now and rows:
                    yield out(work(rows, percent))
                    rows = []
                now = at
                rows.append(r)
        if rows:
            yield out(work(rows, percent))

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, kinds)


def _open_links(
    stars: DataFrame, docs: DataFrame, rows: DataFrame, facts: DataFrame, roots: DataFrame, size: int, percent: int, stage: Stage
) -> DataFrame:
    """Links (a, b) between members of a star in different components, enough to join them. ``stars``: (star, id).

    Bitmaps tell in each square whose sets are needed; only those are read again and dealt to the squares that ask for them.
    """
    sized = stars.join(facts.select("id", "n"), "id")
    placed = stage(sized.join(roots, "id", "left").select("star", "id", "n", F.coalesce("root", "id").alias("root")))
    spread = placed.groupBy("star").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.sum("n").alias("grams"))
    sides = F.ceil(F.greatest(F.col("members") / SQUARE, F.col("grams") / SQUARE_GRAMS)).cast("int")
    spread = spread.filter("low != high").select("star", sides.alias("sides"))
    dealt = placed.drop("n").join(spread, "star").withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1))).drop("sides")
    dealt = dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("other")
    dealt = dealt.select("star", "i", "j", "side", "id", "root")
    asked = stage(_by_square(dealt.join(facts, "id"), _open, percent, "star long, i int, j int, side int, id long, root long"))
    grams = _grams(docs, rows, asked.select("id").distinct(), size, stage)
    out = stage(_by_square(asked.join(facts, "id").join(grams, "id"), _joined, percent, "a long, b long"))
    for done in (grams, asked, placed):
        stage.drop(done)
    return out


def _grams(docs: DataFrame, rows: DataFrame, ids: DataFrame, size: int, stage: Stage) -> DataFrame:
    """(id, grams) of some rows. Only their texts are read again, found by id and hash of the text."""
    ids = stage(ids)
    named = stage(rows.select("id", "own", "mark").join(small(ids), "id")).withColumnRenamed("own", "its").withColumnRenamed("mark", "marked")
    wanted = docs.join(small(named), F.col("own").eqNullSafe(F.col("its")) & (F.col("mark") == F.col("marked"))).select("id", "text")
    grams = stage(sorted_sets(wanted, size).dropDuplicates(["id"]))
    stage.drop(ids)
    return grams


def _linked(docs: DataFrame, rows: DataFrame, pairs: DataFrame, size: int, percent: int, stage: Stage) -> DataFrame:
    """Pairs that really link, by intersecting sorted arrays."""

    @F.arrow_udf("boolean")
    def decided(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            out.append(links(len(p), len(q), _overlap(p, q), percent))
        return pa.array(out)

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    grams = _grams(docs, rows, ids, size, stage)
    with_a = pairs.join(grams.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
    both = with_a.join(grams.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
    out = stage(both.filter(decided("grams_a", "grams_b")).select("a", "b"))
    stage.drop(grams)
    return out


def _documents(df: DataFrame, id: str, text: str) -> DataFrame:
    """(own, text, mark): id, text and its hash."""
    docs = text_column(df.select(F.col(id).cast("long").alias("own"), F.col(text).alias("text")))
    return docs.withColumn("mark", F.xxhash64("text"))


def _grouped(docs: DataFrame, size: int, percent: int, stage: Stage) -> DataFrame:
    """(own, mark, n, component_id, group) per row: the group is the number of a row of its component."""
    small_batches(docs.sparkSession)
    rows = stage(sets(docs, size, percent).withColumn("id", F.monotonically_increasing_id()))
    first_of = F.when(F.size("tiles") > 0, F.col("id"))
    classes = stage(
        rows.filter("n > 0")
        .groupBy("h1", "h2")
        .agg(F.min("own").alias("first"), F.min("id").alias("group"), F.min(first_of).alias("rep"), F.min("n").alias("n"))
    )
    # tiles with more than one member; most have two
    tiles, parts = rows.select("id", F.explode("tiles").alias("tile")), []
    for part in range(PARTS):
        own = tiles.filter(F.pmod("tile", F.lit(PARTS)) == part)
        shared = own.groupBy("tile").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("members"))
        shared = stage(shared.filter("a != b"))
        stage.release()  # the tiles are dealt out once more below
        members = own.join(shared.filter("members > 2").select("tile"), "tile")
        pairs = shared.filter("members = 2").select("tile", F.explode(F.array("a", "b")).alias("id"))
        parts.append(stage(members.select("tile", "id").union(pairs)))
        stage.drop(shared)
    met = reduce(DataFrame.union, parts)
    # what is known of those members: their class, size and bitmap
    known = rows.filter(F.size("tiles") > 0).join(met.select("id").distinct(), "id", "left_semi").select("id", "h1", "h2", "bits")
    facts = known.join(classes.filter("rep is not null").select("h1", "h2", "rep", "n"), ["h1", "h2"])
    facts = stage(facts.select("id", "rep", "n", "bits"))
    met_ids = met.join(facts.select("id", "rep"), "id").select("tile", F.col("rep").alias("id")).distinct()
    met_classes = stage(met_ids)
    for part in parts:
        stage.drop(part)
    facts = facts.filter("id = rep").select("id", "n", "bits").dropDuplicates(["id"])

    # everyone with the smallest member of a tile: the smallest of all its tiles
    lowest = met_classes.groupBy("tile").agg(F.min("id").alias("star"))
    stars = stage(met_classes.join(lowest, "tile").select("star", "id").distinct())
    stage.drop(met_classes)
    nearest = stars.filter("star < id").groupBy("id").agg(F.min("star").alias("star"))
    nearest = stage(nearest.select(F.col("star").alias("a"), F.col("id").alias("b")))
    found = _linked(docs, rows, stage(_bounded(nearest, facts, percent)), size, percent, stage)
    roots = stage(components(found, stage))
    # members of a star that are still in different components
    more = _open_links(stars, docs, rows, facts, roots, size, percent, stage)
    if more.limit(1).count():
        roots = stage(components(found.union(more), stage))

    smallest = classes.join(roots.withColumnRenamed("id", "rep"), "rep")
    lead = smallest.groupBy("root").agg(F.min("first").alias("joined"), F.min("group").alias("whole"))
    named = stage(smallest.join(lead, "root").select("rep", "joined", "whole"))
    least, group = F.when(F.col("whole").isNull(), F.col("first")).otherwise(F.col("joined")), F.coalesce("whole", "group")
    full = classes.join(named, "rep", "left").select("h1", "h2", least.alias("least"), group.alias("group"))
    out = rows.select("own", "mark", "n", "h1", "h2").join(full, ["h1", "h2"], "left")
    return out.select("own", "mark", F.col("n").cast("long").alias("n"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("own")).alias("component_id"), "group")


def similarity_components(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``df``: set size and the smallest id reachable by links."""
    stage = Stage(df.sparkSession, "ngram-join")
    found = _grouped(_documents(df, id, text), size, percent, stage)
    return found.select(F.col("own").alias(id), F.col("n").alias("n_shingles"), "component_id")


def deduplicate(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``df`` of each component: that with the smallest id (null ids last), then the smallest hash of the text; any of equal ones.

    Rows without words stay.
    """
    stage = Stage(df.sparkSession, "near-duplicates")
    docs = _documents(df, id, text)
    inner = Stage(df.sparkSession, "ngram-join")
    found = stage(_grouped(docs, size, percent, inner).filter("n > 0"))
    inner.clear()
    rank = F.struct(F.col("own").isNull().alias("last"), "own", "mark")
    first = found.groupBy("group").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    in_first = F.col("own").eqNullSafe(F.col("first.own")) & (F.col("mark") == F.col("first.mark"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("own", "mark"), F.lit(64)))
    keys = stage(attach(salted, first, "group", "salt").select("own", "mark", in_first.alias("leads")).groupBy("own", "mark").agg(F.max("leads").alias("leads"), F.count(F.lit(1)).alias("rows")))
    gone, again = stage(keys.filter("not leads").select("own", "mark")), stage(keys.filter("leads and rows > 1").select("own", "mark"))
    its, mark = F.col(id).cast("long"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))

    def same(key: DataFrame) -> Column:
        return its.eqNullSafe(key["own"]) & (mark == key["mark"])

    left = df.join(small(gone), same(gone), "left_anti")
    if not again.isEmpty():
        number = fresh(df, "mark")
        one = left.join(small(again), same(again), "left_semi").withColumn(number, mark).dropDuplicates([id, number]).drop(number)
        left = left.join(small(again), same(again), "left_anti").unionByName(one)
    return left.select(*df.columns)

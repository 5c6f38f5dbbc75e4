"""Merkle manifest of a table: one hash tree per group, and one over the groups' roots.

The place of a leaf in its tree is a rank query, not a sort. The ids of each group make
bitmaps: 64-bit words by partial aggregation, merged into compressed containers of 64
words, in which only words that hold ids are kept and a presence word tells which. Each
word carries the count of rows before it in its container, and a directory of counts,
4,096 children per entry at every height, gives the rows before the container. A leaf
finds its place with two bit counts and two additions.

Leaves go to slot arrays keyed by (tree, place / 4,096). One array holds three levels of
runs of 16, so each shuffle reduces the nodes 4,096 times. Proofs come back down the
same staged arrays: an array receives the siblings above its top node and hands each of
its nodes the siblings of its runs.

Leaves are ordered by id, null ids first; rows of one id by leaf hash (equal rows are
interchangeable). These ties alone are numbered by a range-partitioned sort. The null
group comes first, then groups by their UTF-8 bytes. An empty table has no rows and the
root None. Columns beyond the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.llm.common import Stage, attach, numbered, small_batches

ARITY = 16
#: Levels and nodes of one slot array.
HEIGHT = 3
SLOTS = ARITY**HEIGHT


def field(value: Column) -> Column:
    """A value as hash input: its UTF-8 byte count, a colon, itself; a dash if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def node_hash(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


# Places by rank


def _one(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _below(at: Column) -> Column:
    """The bits under bit ``at``."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), at.cast("int")))


def containers(leaves: DataFrame, stage: Stage) -> DataFrame:
    """(tree, chunk, present, words, before): compressed bitmaps of 4,096 ids with their popcount directories.

    ``words`` has for each word that holds ids its bits, the rows before it, and, where an id has
    several rows, the surplus of each such id.
    """
    known = leaves.filter(F.col("id").isNotNull())
    word = F.shiftright("id", 6)
    bits = F.bit_or(_one(F.col("id").bitwiseAND(F.lit(63)))).alias("bits")
    words = stage(known.groupBy("tree", word.alias("word")).agg(bits, F.count(F.lit(1)).alias("n")))
    if words.filter(F.col("n") > F.bit_count("bits")).isEmpty():
        words = words.withColumn("ids", F.lit(None).cast("array<struct<id:bigint,more:bigint>>"))
    else:
        again = known.groupBy("tree", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        ids = again.groupBy("tree", word.alias("word")).agg(F.collect_list(F.struct("id", (F.col("n") - 1).alias("more"))).alias("ids"))
        words = words.join(ids, ["tree", "word"], "left")
    entry = F.struct(F.col("word").bitwiseAND(F.lit(63)).cast("int").alias("at"), "bits", "n", "ids")
    merged = words.groupBy("tree", F.shiftright("word", 6).alias("chunk")).agg(F.sort_array(F.collect_list(entry)).alias("held"), F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    present = F.aggregate("held", zero, lambda all, e: all.bitwiseOR(_one(e["at"])))
    counted = F.transform(
        "held",
        lambda e, i: F.struct(e["bits"].alias("bits"), F.aggregate(F.slice("held", 1, i), zero, lambda s, x: s + x["n"]).alias("before"), e["ids"].alias("ids")),
    )
    bitmaps = stage(merged.select("tree", "chunk", "n", present.alias("present"), counted.alias("words")))
    return bitmaps.drop("n").join(_directory(bitmaps.select("tree", "chunk", "n"), stage), ["tree", "chunk"])


def _directory(counts: DataFrame, stage: Stage) -> DataFrame:
    """(tree, chunk, before, width): rows in the tree's lower chunks and in all, from sums within parents of 4,096 children at each height."""
    span = counts.agg(F.min("chunk"), F.max("chunk")).first()
    low, high = span[0] or 0, span[1] or 0
    heights = [counts]
    while high - low > SLOTS:
        low, high = low >> 12, high >> 12
        heights.append(stage(heights[-1].groupBy("tree", F.shiftright("chunk", 12).alias("chunk")).agg(F.sum("n").alias("n"))))
    whole = Window.partitionBy("tree")
    lower = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = heights[-1].select("tree", "chunk", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("width"))
    for children in reversed(heights[:-1]):
        lower = Window.partitionBy("tree", "parent").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        inside = children.withColumn("parent", F.shiftright("chunk", 12)).withColumn("inside", F.coalesce(F.sum("n").over(lower), F.lit(0)))
        above = before.withColumnRenamed("chunk", "parent")
        before = stage(inside.join(above, ["tree", "parent"]).select("tree", "chunk", (F.col("before") + F.col("inside")).alias("before"), "width"))
    return before


def places(leaves: DataFrame, stage: Stage) -> DataFrame:
    """Add ``place``, the row's number in its tree, and ``width``, the tree's rows, to staged leaves (tree, id, leaf, row, ...)."""
    index = containers(leaves, stage).withColumn("key", F.struct("tree", "chunk")).drop("tree", "chunk")
    bit, word = F.col("id").bitwiseAND(F.lit(63)), F.shiftright("id", 6).bitwiseAND(F.lit(63))
    entry = F.element_at("words", F.bit_count(F.col("present").bitwiseAND(_below(word))).cast("int") + 1)
    surplus = F.aggregate(F.filter(entry["ids"], lambda e: e["id"] < F.col("id")), F.lit(0).cast("long"), lambda s, e: s + e["more"])
    rank = F.col("before") + entry["before"] + F.bit_count(entry["bits"].bitwiseAND(_below(bit))) + F.coalesce(surplus, F.lit(0))
    # Rows of a chunk mostly lie together; the salt splits only an id of very many rows.
    known = leaves.filter(F.col("id").isNotNull()).withColumns({"key": F.struct("tree", F.shiftright("id", 12).alias("chunk")), "salt": F.pmod(F.shiftright("row", 12), F.lit(64))})
    tied = F.coalesce(F.exists(entry["ids"], lambda e: e["id"] == F.col("id")), F.lit(False))
    ranked = attach(known, stage(index), "key", "salt").select(*leaves.columns, rank.cast("long").alias("place"), "width", tied.alias("tied"))
    nulls = leaves.filter(F.col("id").isNull())
    if nulls.isEmpty():
        ranked = stage(ranked)
    else:
        first = {"place": F.lit(0).cast("long"), "width": F.lit(0).cast("long"), "tied": F.lit(True)}
        salted = ranked.unionByName(nulls.withColumns(first)).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)))
        counts = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("id").isNull()).alias("nulls"))
        moved = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.col("place") + F.col("nulls"))
        ranked = stage(attach(stage(salted), counts, "tree", "salt").select(*leaves.columns, moved.alias("place"), F.col("all").alias("width"), "tied"))
    if ranked.filter("tied").isEmpty():
        return ranked.drop("tied")
    ties = ranked.filter("tied").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64)))
    ties = numbered(ties, stage, "number", "tree", "id", "leaf", "row").withColumn("key", F.struct("tree", "place"))
    first = ties.groupBy("key").agg(F.min("number").alias("first"))
    told = attach(ties, first, "key", "salt").withColumn("place", F.col("place") + F.col("number") - F.col("first"))
    return ranked.filter(~F.col("tied")).drop("tied").unionByName(told.select(*ranked.drop("tied").columns))


# Trees


def rounds(width: int) -> int:
    """Levels that one slot array of a tree of ``width`` nodes reduces: three, or as many as lead to one node."""
    if width > SLOTS:
        return HEIGHT
    count = 0
    while width > 1:
        width, count = -(-width // ARITY), count + 1
    return count


def _levels(nodes: list[bytes], width: int) -> list[list[bytes]]:
    levels = [nodes]
    for _ in range(rounds(width)):
        below = levels[-1]
        levels.append([node_hash(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and items put into their slots, and the top node of each array."""
    for batch in batches:
        slots, widths = batch.column("slots"), batch.column("width").to_pylist()
        flat, sizes = slots.flatten(), np.diff(np.asarray(slots.offsets))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        order = np.empty(len(flat), np.int64)
        order[np.repeat(ends[:-1], sizes) + flat.field("slot").to_numpy()] = np.arange(len(flat))
        nodes, items = flat.field("node").take(pa.array(order)), flat.field("item").take(pa.array(order))
        values = [v.hex().encode() for v in nodes.to_pylist()]
        tops = [bytes.fromhex(_levels(values[a:b], w)[-1][0].decode()) for a, b, w in zip(ends, ends[1:], widths)]
        offsets = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, nodes), pa.ListArray.from_arrays(offsets, items)]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("part"), batch.column("width"), *lists, pa.array(tops, pa.binary())], ["tree", "part", "width", "nodes", "items", "top"])


def grow(nodes: DataFrame, stage: Stage) -> list[DataFrame]:
    """Slot arrays (tree, part, width, nodes, items, top) of each height, from nodes (tree, place, width, node, item)."""
    heights: list[DataFrame] = []
    while True:
        slot = F.col("place").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")
        slots = nodes.groupBy("tree", F.shiftright("place", 12).alias("part")).agg(F.first("width").alias("width"), F.collect_list(F.struct(slot, "node", "item")).alias("slots"))
        item = nodes.schema["item"].dataType
        schema = T.StructType([*slots.schema.fields[:3], T.StructField("nodes", T.ArrayType(T.BinaryType())), T.StructField("items", T.ArrayType(item)), T.StructField("top", T.BinaryType())])
        small_batches(nodes.sparkSession)
        heights.append(stage(slots.mapInArrow(_fill, schema)))
        higher = heights[-1].filter(F.col("width") > SLOTS)
        if higher.isEmpty():
            return heights
        none = F.struct(F.lit(0).alias("none"))
        nodes = higher.select("tree", F.col("part").alias("place"), F.ceil(F.col("width") / F.lit(SLOTS)).alias("width"), F.col("top").alias("node"), none.alias("item"))


def tops(heights: list[DataFrame]) -> DataFrame:
    """(tree, top): the root of each tree."""
    found = [h.filter(F.col("width") <= SLOTS).select("tree", "top") for h in heights]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _siblings(levels: list[list[bytes]], slot: int, above: bytes, known: dict[tuple[int, int], bytes], level: int = 0) -> bytes:
    """Siblings of a node, run by run up to the array's top, then those above: ``left.right/`` per run."""
    if level == len(levels) - 1:
        return above
    run = slot // ARITY
    if (level + 1, run) not in known:
        known[level + 1, run] = _siblings(levels, run, above, known, level + 1)
    nodes = levels[level]
    left, right = nodes[run * ARITY : slot], nodes[slot + 1 : (run + 1) * ARITY]
    return b"".join([*left, b".", *right, b"/", known[level + 1, run]])


def fold(leaf: bytes, chain: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for run in chain.split(b"/")[:-1]:
        left, right = run.split(b".")
        leaf = node_hash([left, leaf, right])
    return leaf


def proof(chain: bytes) -> bytes:
    """Hash of all siblings, level by level, left to right."""
    return node_hash([chain.translate(None, b"./")])


def _hand_down(batches: Iterator[pa.RecordBatch], folded: bool) -> Iterator[pa.RecordBatch]:
    """One row per slot: item, place, node and siblings; with ``folded`` the proof's hash and the root from ``item.other`` instead of the siblings."""
    for batch in batches:
        offsets = np.asarray(batch.column("nodes").offsets)
        nodes, items = batch.column("nodes").flatten(), batch.column("items").flatten()
        values = [v.hex().encode() for v in nodes.to_pylist()]
        others = items.field("other").to_pylist() if folded else []
        ends = (offsets - offsets[0]).tolist()
        parts, widths, aboves = (batch.column(c).to_pylist() for c in ("part", "width", "chain"))
        where, out = [], []
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            levels, known = _levels(values[a:b], widths[i]), {}
            for slot in range(b - a):
                chain = _siblings(levels, slot, aboves[i], known)
                if folded:
                    other = others[a + slot]
                    out.append((proof(chain).decode(), fold(other.hex().encode() if other else values[a + slot], chain).decode()))
                else:
                    out.append((chain,))
            where += [(i, parts[i] * SLOTS + slot) for slot in range(b - a)]
        row = pa.array([w[0] for w in where], pa.int64())
        columns = [items, batch.column("tree").take(row), pa.array([w[1] for w in where], pa.int64()), nodes, batch.column("subroot").take(row)]
        named = ["proof", "folded"] if folded else ["chain"]
        kind = pa.string() if folded else pa.binary()
        rest = [pa.array([o[k] for o in out], kind) for k in range(len(named))]
        yield pa.RecordBatch.from_arrays([*columns, *rest], ["item", "tree", "place", "node", "subroot", *named])


def hand_down(heights: list[DataFrame], above: DataFrame, stage: Stage, folded: bool = False) -> DataFrame:
    """(item, tree, place, node, subroot, chain) of every leaf, from (tree, chain, subroot) above the trees' roots."""
    chains: DataFrame | None = None
    for height in range(len(heights) - 1, -1, -1):
        arrays = heights[height]
        ready = arrays.filter(F.col("width") <= SLOTS).join(above, "tree")
        if chains is not None:
            higher = chains.select("tree", F.col("place").alias("part"), "chain", "subroot")
            ready = ready.unionByName(arrays.filter(F.col("width") > SLOTS).join(higher, ["tree", "part"]))
        last = folded and height == 0
        rest = [T.StructField(c, T.StringType()) for c in ("proof", "folded")] if last else [T.StructField("chain", T.BinaryType())]
        fields = [T.StructField("item", arrays.schema["items"].dataType.elementType), arrays.schema["tree"], T.StructField("place", T.LongType())]
        schema = T.StructType([*fields, T.StructField("node", T.BinaryType()), T.StructField("subroot", T.BinaryType()), *rest])
        chains = ready.select("tree", "part", "width", "nodes", "items", "chain", "subroot").mapInArrow(lambda batches, f=last: _hand_down(batches, f), schema)
        if height:
            chains = stage(chains)
    return chains


@dataclass(frozen=True)
class Manifest:
    """The staged trees of a table and the root over them; ``above`` has per tree its root and the siblings above it."""

    heights: list[DataFrame]
    above: DataFrame
    root: str | None
    stage: Stage

    def proofs(self) -> DataFrame:
        """(id, group, place, leaf, subroot, chain): the siblings of each leaf up to the root, ``left.right/`` per run."""
        down = hand_down(self.heights, self.above, self.stage)
        hex = [F.lower(F.hex(c)).alias(n) for c, n in (("node", "leaf"), ("subroot", "subroot"))]
        return down.select("item.id", _group().alias("group"), "place", *hex, F.col("chain").cast("string").alias("chain"))

    def checks(self) -> DataFrame:
        """(id, group, place, leaf, subroot, proof, folded): the hash of each leaf's siblings, and the root recomputed from the changed row where there is one."""
        down = hand_down(self.heights, self.above, self.stage, folded=True)
        hex = [F.lower(F.hex(c)).alias(n) for c, n in (("node", "leaf"), ("subroot", "subroot"))]
        return down.select("item.id", _group().alias("group"), "place", *hex, "proof", "folded")


def _group() -> Column:
    return F.when(F.col("tree") != "", F.expr("substr(tree, 2)"))


def manifest(docs: DataFrame, fields: list[str], group: str = "source", id: str = "doc_id", changed: tuple[Column, dict[str, Column]] | None = None) -> Manifest:
    """The hash trees of ``docs``: leaves from ``fields`` in that order, a tree per ``group``, ordered by the integer ``id``.

    ``changed`` names rows and the values that their fields have been changed to, for ``checks``.
    """
    stage = Stage(docs.sparkSession, "merkle")
    other = F.lit(None).cast("binary")
    if changed is not None:
        where, values = changed
        other = F.when(where, leaf_hash([values.get(c, F.col(c)) for c in fields]))
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col(id).cast("long").alias("id"), leaf_hash([F.col(c) for c in fields]).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("row"))
    placed = places(stage(leaves), stage)
    item = F.struct("id", "other").alias("item")
    nodes = placed.select("tree", "place", "width", F.col("leaf").alias("node"), item)
    heights = grow(nodes, stage)
    roots = numbered(tops(heights), stage, "place", "tree")
    count = F.lit(roots.count()).cast("long")
    over = grow(roots.select(F.lit("").alias("tree"), "place", count.alias("width"), F.col("top").alias("node"), F.struct(F.col("tree").alias("of")).alias("item")), stage)
    root = tops(over).first()
    start = tops(over).select("tree", F.lit("").cast("binary").alias("chain"), F.col("top").alias("subroot"))
    down = hand_down(over, start, stage).select(F.col("item.of").alias("tree"), "chain", F.col("node").alias("subroot"))
    return Manifest(heights, stage(down), root["top"].hex() if root else None, stage)


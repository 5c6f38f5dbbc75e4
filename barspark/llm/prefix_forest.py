"""Nearest neighbours by inner product with a hash-prefix forest.

Rows are dealt into blocks of about ``BLOCK`` by a hash of their id; each block holds
``TREES`` trees. A tree is a sorted array of long hash strings: the signs of ``BITS``
random projections of a row, packed into one number. A query descends every tree to
its longest prefix match by binary search, then all trees ascend together, one letter
at a time, until the ranges of equal prefixes hold the wanted share of the block's
rows; the root holds all of them, so no query goes short. Candidates are scored
exactly, in double precision on the vectors as given, and the best of all blocks are
merged. Queries come in blocks too; each pair of blocks is one group of bounded size.

As the measure is the inner product, rows get one more coordinate that gives all of a
block the same length; for a query it is zero, so the nearest by angle are the nearest
by inner product.

Vectors that are null, all zero, or hold null or non-finite components take no part, as
queries or candidates; nor do rows without an id. Rows that repeat an id count once per
query, at their best. Vectors of another length than the query's are no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import fresh

BLOCK = 8192
QUERIES = 2048
TREES = 64
BITS = 32
#: Share of a block's rows that a query's candidates make up. The given vectors have hardly any structure; see README.
SHARE = 0.6


def usable(vector: Column) -> Column:
    """All components finite, and one not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """The trees of one block."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        count, size = rows.shape
        lengths = np.sqrt((rows**2).sum(1))
        top = lengths.max() if count else 1.0
        self.count, self.bits, self.trees = count, bits, trees
        self.planes = np.random.default_rng(size).standard_normal((size + 1, trees * bits))
        lifted = np.concatenate([rows / top, np.sqrt(np.maximum(0.0, 1 - (lengths / top) ** 2))[:, None]], 1)
        strings = self._strings(lifted)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 0)

    def _strings(self, lifted: np.ndarray) -> np.ndarray:
        """Hash string of each row in each tree, the first letter highest."""
        out = np.zeros((len(lifted), self.trees), np.uint64)
        signs = (lifted @ self.planes > 0).reshape(len(lifted), self.trees, self.bits)
        for b in range(self.bits):
            out = (out << np.uint64(1)) | signs[:, :, b].astype(np.uint64)
        return out

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query the rows whose prefix it shares at the depth that all trees have ascended to."""
        lifted = np.concatenate([queries, np.zeros((len(queries), 1))], 1)
        strings = self._strings(lifted)
        low = np.zeros((self.bits + 1, self.trees, len(queries)), np.int32)
        high = np.zeros_like(low)
        for t in range(self.trees):
            own = self.sorted[:, t]
            for depth in range(self.bits + 1):
                free = np.uint64(self.bits - depth)
                prefix = strings[:, t] >> free
                low[depth, t] = np.searchsorted(own, prefix << free, "left")
                high[depth, t] = np.searchsorted(own, (prefix << free) + np.uint64((1 << (self.bits - depth)) - 1), "right")
        for i in range(len(queries)):
            depth = self.bits
            held = np.zeros(self.count, bool)
            while True:  # the deepest prefixes first, then one letter up in every tree
                for t in range(self.trees):
                    a, b = low[depth, t, i], high[depth, t, i]
                    if b > a:
                        held[self.order[a:b, t]] = True
                if depth == 0 or held.sum() >= wanted:
                    break
                depth -= 1
                while depth and (high[depth, :, i] - low[depth, :, i]).sum() < wanted:
                    depth -= 1  # not enough even if no tree repeats another
            yield np.flatnonzero(held)


def _search(rows: pa.Table, queries: pa.Table, k: int, share: float, trees: int) -> pa.Table:
    found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if rows.num_rows and queries.num_rows:
        ids, own = _matrix(rows)
        names, asked = _matrix(queries)
        order = np.argsort(ids, kind="stable")
        ids, own = ids[order], own[order]
        repeated = bool((ids[1:] == ids[:-1]).any())
        wanted = max(int(np.ceil(share * len(ids))), k + 1)
        forest = Forest(own, trees)
        for name, query, near in zip(names.tolist(), asked, forest.candidates(asked, wanted), strict=True):
            near = near[ids[near] != name]
            scores = np.einsum("ij,j->i", own[near], query)
            best = np.lexsort((ids[near], -scores))
            if repeated:
                _, first = np.unique(ids[near][best], return_index=True)
                best = best[np.sort(first)]
            best = best[:k]
            found["query_id"] += [name] * len(best)
            found["vec_id"] += ids[near][best].tolist()
            found["score"] += scores[best].tolist()
    kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    return pa.table({c: pa.array(v, kinds[c]) for c, v in found.items()})


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    vectors = table.column("vector").combine_chunks()
    return ids, vectors.flatten().to_numpy().reshape(len(ids), -1)


def nearest(
    df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20, share: float = SHARE, trees: int = TREES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of all other rows for each query row, ties to the smaller id."""
    flag = fresh(df, "asked")
    base = df.withColumn(flag, F.coalesce(is_query, F.lit(False))).filter(F.col(id).isNotNull() & usable(F.col(vector)))
    base = base.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(flag).alias("asked"))
    base = base.withColumn("size", F.size("vector"))
    total, asked = base.agg(F.count("*"), F.count_if("asked")).first()
    blocks, parts = max(1, -(-total // BLOCK)), max(1, -(-asked // QUERIES))
    rows = base.select("size", "id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    queries = base.filter("asked").dropDuplicates(["id"]).select("size", "id", "vector", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    key = ["size", "block", "part"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        return _search(left, right, k, share, trees)

    found = rows.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

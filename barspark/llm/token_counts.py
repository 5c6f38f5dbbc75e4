"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a broadcast table of at most ``TABLE`` frequent pre-tokens and their token
counts, learned from at most ``SAMPLE_ROWS`` rows; its size is fixed, and it changes
speed alone, never a count. Tier two is a cache in each Python worker (at most
``CACHE`` pre-tokens, emptied when full): what neither tier knows is encoded by the
tokenizers library. No pre-token is ever shuffled.

Nulls and empty texts have 0 tokens and 0 bytes. Special strings inside texts count as
one token, as the library does by default. Pre-tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.llm.common import HashTable, arrow_map, slices, small_batches, text_column
from barspark.llm.pretokens import Cut, Cutter

TABLE = 1 << 16
SAMPLE_ROWS = 4_000
CACHE = 1 << 20
BATCH = 20_000

_FOUND = T.StructType([T.StructField("hash", T.LongType()), T.StructField("seen", T.LongType()), T.StructField("tokens", T.IntegerType())])


class Library:
    """The tokenizers library, for pre-tokens that no table knows."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def counts(self, words: list[str]) -> np.ndarray:
        out = []
        for i in range(0, len(words), BATCH):
            out += [len(e.ids) for e in self.tokenizer.encode_batch_fast(words[i : i + BATCH], add_special_tokens=False)]
        return np.array(out, np.int32)


def _unknown(cut: Cut, places: np.ndarray) -> list[str]:
    raw = cut.data.tobytes()
    return [raw[a:b].decode() for a, b in zip(cut.starts[places].tolist(), cut.stops[places].tolist(), strict=True)]


class Counter:
    """Token counts of a column of texts; built once per task."""

    def __init__(self, path: str, hashes: np.ndarray, tokens: np.ndarray) -> None:
        self.cut, self.library = Cutter(path), Library(path)
        self.first = HashTable(max(4, int(2 * max(1, len(hashes)) - 1).bit_length() + 1))
        self.first.put(hashes, tokens)
        self.second = HashTable(CACHE.bit_length())

    def __call__(self, column: pa.Array) -> np.ndarray:
        cut = self.cut(column)
        counts = self.first.get(cut.hashes)
        rest = np.flatnonzero(counts == 0)
        counts[rest] = self.second.get(cut.hashes[rest])
        rest = rest[counts[rest] == 0]
        if len(rest):
            names, first, which = np.unique(cut.hashes[rest], return_index=True, return_inverse=True)
            new = self.library.counts(_unknown(cut, rest[first]))
            counts[rest] = new[which]
            if self.second.held + len(names) > CACHE:
                self.second = HashTable(CACHE.bit_length())
            if len(names) <= CACHE:
                self.second.put(names, new)
        total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return np.diff(total[cut.rows])


def frequent(df: DataFrame, path: str, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pre-tokens of a bounded sample and their token counts; at most ``TABLE`` of them.

    Rows are sampled by the share that gives ``SAMPLE_ROWS`` of all, and each task sends
    its own ``TABLE`` most frequent pre-tokens to the sum.
    """
    rows = df.count()
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    share = min(1.0, SAMPLE_ROWS / rows)

    def make():
        cutter, library = Cutter(path), Library(path)

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            cut = cutter(batch.column(0))
            names, first, seen = np.unique(cut.hashes, return_index=True, return_counts=True)
            top = np.sort(np.argsort(-seen, kind="stable")[:TABLE])
            found = {"hash": names[top].view(np.int64), "seen": seen[top], "tokens": library.counts(_unknown(cut, first[top]))}
            return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in found.items()})

        return count

    some = text_column(df.sample(share, seed=7).select(F.col(text).alias("text")))
    found = arrow_map(some, make, _FOUND).groupBy("hash").agg(F.sum("seen").alias("seen"), F.max("tokens").alias("tokens"))
    table = found.orderBy(F.desc("seen"), "hash").limit(TABLE).toArrow()
    return table["hash"].to_numpy().view(np.uint64), table["tokens"].to_numpy().astype(np.int32)


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each whole text. ``path``: a byte-level BPE file that every executor can open."""
    hashes, tokens = frequent(df, path, text)
    table = df.sparkSession.sparkContext.broadcast((hashes, tokens))

    @F.arrow_udf("long")
    def counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(path, *table.value)
        for column in columns:
            parts = [counter(b.column(0)) for b in slices(pa.RecordBatch.from_arrays([column], ["text"]))]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))

    small_batches(df.sparkSession)
    return text_column(df, text).withColumn(out, counted(F.col(text)))

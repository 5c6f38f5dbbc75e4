"""Byte-pair encoding and decoding with an index from each pair to all its positions.

``encode`` adds the token ids that the tokenizers library gives for a byte-level BPE
file; ``decode`` turns ids back into text. Within a group of texts (at most
``GROUP_BYTES``) every different pre-token is laid out once in one symbol array. An
index maps each adjacent pair of symbols to all its positions; active ranks are taken
in ascending order, all positions of a rank are merged at once, and the lists of the
pairs that appear beside them are extended. A merge only creates pairs of higher rank,
so ascending order over the whole group equals the order within each pre-token.

Nulls count as empty texts and have no ids. Special strings inside texts get their own
ids, as the library does by default. Extra columns are kept; an existing ``ids`` or
``decoded`` column is an error of the caller, who names the output column.

Different pre-tokens are told apart by 64-bit hashes within a group.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import fresh, slices, small_batches, text_column
from barspark.llm.pretokens import Cutter

GROUP_BYTES = 8 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level BPE files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge ranks of a file, with a hash table from a pair of ids to its rank."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        model = form["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.byte_id = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_id[byte] = vocab[letter]
        words = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {t["id"]: t["content"].encode() for t in form["added_tokens"]}
        size = max(words) + 1
        spelled = [words.get(i, b"") for i in range(size)]
        self.width = np.array([len(w) for w in spelled], np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.width)])[:-1]
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        keys = self.left << 32 | self.right
        self.bits = max(19, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        open_, rank, step = keys, np.arange(len(keys), dtype=np.int32), 0
        while len(open_):  # linear probing, all open keys at once; the first of equal places stays
            slot = (self._slot(open_) + step) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]] = open_[put], rank[put]
            left = np.ones(len(open_), bool)
            left[put] = False
            open_, rank, step = open_[left], rank[left], step + 1
        self.probes = step

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or -1."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found != -1)
            if not on.any():
                break
            slot, todo = (slot[on] + 1) & ((1 << self.bits) - 1), todo[on]
        return out

    def encode(self, letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words laid end to end in ``letters``, and the offsets of the words into them."""
        words = len(starts)
        n = len(letters) + words + 1  # a wall before each word, and one at the end
        symbol = np.full(n, -1, np.int32)
        inside = np.ones(n, bool)
        walls = starts + np.arange(words)
        inside[walls] = inside[-1] = False
        symbol[inside] = self.byte_id[letters]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank = np.full(n, -1, np.int32)
        both = np.flatnonzero(inside[:-1] & inside[1:])
        rank[both] = self.rank(symbol[both], symbol[both + 1])

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray) -> None:
            """Enter positions under the rank of their pair."""
            own = rank[places]
            places, own = places[own >= 0], own[own >= 0]
            if not len(own):
                return
            if len(own) > 1:
                order = np.argsort(own, kind="stable")
                places, own = places[order], own[order]
                cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
                groups, names = np.split(places, cuts), own[np.append(0, cuts)].tolist()
            else:
                groups, names = [places], [int(own[0])]
            for name, group in zip(names, groups, strict=True):
                known = index.get(name)
                if known is None:
                    index[name] = [group]
                    heapq.heappush(heap, name)
                else:
                    known.append(group)

        add(both)
        while heap:
            now = heapq.heappop(heap)
            lists = index.pop(now)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)  # a position has one pair at a time: no repeats
            at = at[rank[at] == now]
            if not len(at):
                continue
            if self.left[now] == self.right[now] and len(at) > 1:  # runs of one symbol: from the left, without overlap
                at = np.sort(at)
                fresh = np.append(True, after[at[:-1]] != at[1:])
                first = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - first[np.cumsum(fresh) - 1]) % 2 == 0]
            gone = after[at]
            behind = after[gone]
            symbol[at] = self.made[now]
            rank[gone] = -1
            inside[gone] = False
            after[at] = behind
            before[behind] = at
            rank[at] = self.rank(symbol[at], symbol[behind])
            ahead = before[at]
            ahead = ahead[symbol[ahead] != self.made[now]]  # the rest are positions of this rank themselves
            rank[ahead] = self.rank(symbol[ahead], symbol[after[ahead]])
            add(np.concatenate([at, ahead]))
        counts = np.add.reduceat(inside, walls) if words else np.zeros(0, np.int64)
        return symbol[inside], np.concatenate([[0], np.cumsum(counts)])

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> list[bytes]:
        width = self.width[ids]
        ends = np.concatenate([[0], np.cumsum(width)])
        source = np.repeat(self.place[ids] - ends[:-1], width) + np.arange(ends[-1])
        raw = self.spelling[source].tobytes()
        cut = ends[rows].tolist()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Encoder:
    """Texts to ids; built once per task."""

    def __init__(self, path: str) -> None:
        self.cut, self.merges = Cutter(path), Merges(path)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the row offsets into them."""
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for part in self._groups(column):
            some, rows = self._group(part)
            ids.append(some)
            counts.append(np.diff(rows))
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))

    @staticmethod
    def _groups(column: pa.Array) -> Iterator[list[pa.Array]]:
        group, held = [], 0
        for part in slices(pa.RecordBatch.from_arrays([column], ["text"])):
            size = part.nbytes
            if group and held + size > GROUP_BYTES:
                yield group
                group, held = [], 0
            group.append(part.column(0))
            held += size
        if group:
            yield group

    def _group(self, parts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        hashes, rows, special = [], [np.zeros(1, np.int64)], []
        seen, letters = [], []
        base = 0
        for part in parts:
            cut = self.cut(part)
            names, first = np.unique(cut.hashes, return_index=True)
            width = cut.stops[first] - cut.starts[first]
            ends = np.concatenate([[0], np.cumsum(width)])
            source = np.repeat(cut.starts[first] - ends[:-1], width) + np.arange(ends[-1])
            seen.append((names, width))
            letters.append(cut.data[source])
            hashes.append(cut.hashes)
            rows.append(cut.rows[1:] + base)
            special += [(base + i, token) for i, token in cut.special.items()]
            base += len(cut.hashes)
        names, width = np.concatenate([a for a, _ in seen]), np.concatenate([b for _, b in seen])
        place = np.concatenate([[0], np.cumsum(width)])
        vocabulary, first = np.unique(names, return_index=True)
        own = width[first]
        starts = np.concatenate([[0], np.cumsum(own)])
        source = np.repeat(place[first] - starts[:-1], own) + np.arange(starts[-1])
        table, bounds = self.merges.encode(np.concatenate(letters)[source], starts[:-1])
        word = np.searchsorted(vocabulary, np.concatenate(hashes))
        size = np.diff(bounds)[word]
        begin = bounds[word]
        for i, token in special:
            begin[i], size[i] = len(table), 1
            table = np.append(table, np.int32(token))
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = table[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.concatenate(rows)]


def _id_lists(ids: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _texts(merges: Merges, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.array([p.decode("utf-8", "replace") for p in merges.decode(ids, rows)], pa.string())


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the array of token ids of each whole text. ``path``: a byte-level BPE file that every executor can open."""

    @F.arrow_udf("array<int>")
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for column in columns:
            yield _id_lists(*encoder(column))

    small_batches(df.sparkSession)
    return text_column(df, text).withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that ids stand for (null ids: empty); bytes that are no UTF-8 become replacement characters."""

    @F.arrow_udf("string")
    def texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = Merges(path)
        for column in columns:
            rows = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            values = column.values.to_numpy(zero_copy_only=False)[rows[0] : rows[-1]]
            yield _texts(merges, values, rows - rows[0])

    small_batches(df.sparkSession)
    return df.withColumn(out, texts(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``ids`` and ``decoded`` of each text, as ``encode`` and ``decode`` give them, in one pass of one worker.

    A table that has columns of these names already is refused.
    """
    taken = {"ids", "decoded"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"the table already has {', '.join(sorted(taken))}")

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(path)
        for column in columns:
            ids, rows = encoder(column)
            yield pa.StructArray.from_arrays([_id_lists(ids, rows), _texts(encoder.merges, ids, rows)], ["ids", "decoded"])

    small_batches(df.sparkSession)
    made = fresh(df, "both")
    done = text_column(df, text).withColumn(made, both(F.col(text)))
    return done.withColumns({"ids": F.col(f"{made}.ids"), "decoded": F.col(f"{made}.decoded")}).drop(made)

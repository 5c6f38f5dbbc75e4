"""Spelling variants: words within one edit, grouped under the most frequent spelling.

Words are counted over all texts, then searched in FM-indexes over the vocabulary,
written with a delimiter before and after each word. A word one edit away agrees with
the searched word in its first or its second half. So each word is searched twice, from
the delimiter at either end: the far half by exact backward steps, which narrow an
interval of suffix ranks, then the other half with one error (a symbol more, a symbol
less or another symbol), each branch again an interval. The index over the words as
written extends to the left, the index over the reversed words to the right. Both
schemes begin at a delimiter, so neither changes its direction and an interval is kept
in one of the two indexes at a time.

The vocabulary is cut by the ends that an exact half must share: a word and its near
words of one scheme lie in one group. Groups of very many words are dealt into tiles,
and every pair of query tile and index tile is a task's work.

Null texts have no words, and the name of a null id is the empty string. Rows with equal
ids and texts count like others. Other columns are ignored; an empty table gives an
empty result. The most frequent near word is a word's form if it occurs at least twice
as often; of equally frequent ones the smallest in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import Stage, bytes_of, pieces, slices, small, small_batches

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One run in so many loses a code point: the stand-in for misspellings.
DROP_ONE_IN = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Words per index, and the number beyond which a group is dealt into tiles.
GROUP, TILE = 8_192, 32_768
#: From this length of the searched word on, both halves have four letters.
LONG = 8
#: Words searched at a time.
AT_ONCE = 4_096


def damaged(run: bytes, seed: int) -> bytes:
    """The run, or the run without one code point if the checksum that starts with ``seed`` says so."""
    mark = zlib.crc32(run, seed)
    if mark % DROP_ONE_IN:
        return run
    letters = run.decode()
    at = mark % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return batch

    for batch in batches:
        for part in slices(batch):
            data, edges = bytes_of(part.column(1))
            raw, edges = data.tobytes(), edges.tolist()
            for id, a, b in zip(part.column(0).to_pylist(), edges, edges[1:]):
                seed = zlib.crc32(f"{id or ''}:".encode())
                for piece in pieces(raw[a:b]):
                    for run, n in Counter(RUN.findall(piece.lower())).items():
                        total[damaged(run, seed)] += n
                    if len(total) > HELD:
                        yield out()
    if total:
        yield out()


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least five code points that occur at least three times."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id).cast("string").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_count, "word string, n long").filter(F.char_length("word") >= MIN_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


class Index:
    """FM-index over words with a zero before and after each: steps narrow intervals of suffix ranks leftwards."""

    def __init__(self, words: list[bytes]) -> None:
        text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        self.size, self.delimiters, longest = len(text), len(words) + 1, max(map(len, words)) + 2
        rank, reach = text.astype(np.int64), 1
        while True:  # prefix doubling, as far as the longest delimited word
            ahead = np.zeros(self.size, np.int64)
            ahead[: self.size - reach] = rank[reach:] + 1
            pair = rank * (self.size + 257) + ahead
            self.suffixes = np.argsort(pair, kind="stable")
            ordered = pair[self.suffixes]
            rank = np.empty(self.size, np.int64)
            rank[self.suffixes] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            reach *= 2
            if reach >= longest:
                break
        self.before = text[self.suffixes - 1]
        # For each symbol the ranks that it stands before, in order: a step is one binary search.
        by_symbol = np.argsort(self.before, kind="stable")
        self.steps = self.before[by_symbol].astype(np.int64) * (self.size + 1) + by_symbol
        self.symbols = np.unique(text)[1:].astype(np.int64)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        self.word_at = np.full(self.size, -1, np.int64)
        self.word_at[starts[:-1]] = np.arange(len(words))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol * (self.size + 1)
        return np.searchsorted(self.steps, base + low), np.searchsorted(self.steps, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, symbol) of every letter that stands before an interval's suffixes."""
        width = high - low
        few = np.flatnonzero(width <= len(self.symbols))
        each = np.repeat(few, width[few])
        offset = np.arange(len(each)) - np.repeat(np.cumsum(width[few]) - width[few], width[few])
        seen = np.unique(each * 256 + self.before[low[each] + offset])
        seen = seen[seen % 256 > 0]
        many = np.flatnonzero(width > len(self.symbols))
        return np.concatenate([seen // 256, np.repeat(many, len(self.symbols))]), np.concatenate([seen % 256, np.tile(self.symbols, len(many))])

    def near(self, queries: list[bytes], free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of all words one edit away whose edit lies in the first ``free`` symbols of the query, the rest being equal."""
        length = np.array([len(q) for q in queries])
        flat, first = np.frombuffer(b"".join(queries), np.uint8).astype(np.int64), np.cumsum(length) - length
        query = np.arange(len(queries))
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), self.delimiters)
        at = length.copy()
        while (todo := np.flatnonzero((at > free) & (high > low))).size:
            at[todo] -= 1
            low[todo], high[todo] = self.step(flat[first[todo] + at[todo]], low[todo], high[todo])
        alive = high > low
        clean = query[alive], at[alive], low[alive], high[alive]  # states without an error so far
        spent = tuple(np.zeros(0, np.int64) for _ in range(4))  # states with their error made
        found = []
        while len(clean[0]) or len(spent[0]):
            query, at, low, high = spent
            done = at == 0
            a, b = self.step(np.zeros(int(done.sum()), np.int64), low[done], high[done])
            whole = b > a
            found.append((query[done][whole], self.word_at[self.suffixes[a[whole]]]))
            query, at, low, high = (x[~done] for x in spent)
            low, high = self.step(flat[first[query] + at - 1], low, high)
            alive = high > low
            on = [(query[alive], at[alive] - 1, low[alive], high[alive])]
            query, at, low, high = clean
            more = at > 0
            on.append((query[more], at[more] - 1, low[more], high[more]))  # a symbol less
            state, symbol = self.branches(low, high)
            a, b = self.step(symbol, low[state], high[state])
            state, symbol, a, b = (x[b > a] for x in (state, symbol, a, b))
            on.append((query[state], at[state], a, b))  # a symbol more
            mine = np.where(more[state], flat[np.maximum(first[query[state]] + at[state] - 1, 0)], -1)
            other, same = more[state] & (symbol != mine), symbol == mine
            on.append((query[state][other], at[state][other] - 1, a[other], b[other]))  # another symbol
            clean = query[state][same], at[state][same] - 1, a[same], b[same]
            spent = tuple(np.concatenate(x) for x in zip(*on))
        pairs = np.unique(np.concatenate([f[0] for f in found]) * self.size + np.concatenate([f[1] for f in found])) if found else np.zeros(0, np.int64)
        return pairs // self.size, pairs % self.size


def _search(table: pa.Table) -> pa.Table:
    """Near words of the queries of one group among its indexed words, by the scheme of its side."""
    side = table.column("side")[0].as_py()
    words = [w.encode("latin-1")[:: -1 if side else 1] for w in table.column("word").to_pylist()]
    counts = table.column("n").to_numpy()
    indexed, asked = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("indexed", "asked"))
    index, out = Index([words[i] for i in indexed]) if len(indexed) else None, []
    for first in range(0, len(asked) if index else 0, AT_ONCE):
        some = asked[first : first + AT_ONCE]
        length = np.array([len(words[i]) for i in some])
        query, word = index.near([words[i] for i in some], length - length // 2 if side else length // 2)
        out.append((some[query], indexed[word]))
    a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
    spelled = table.column("word").combine_chunks()
    return pa.table([spelled.take(pa.array(a)), spelled.take(pa.array(b)), pa.array(counts[b], pa.int64())], ["word", "near", "near_n"])


def near_words(words: DataFrame, stage: Stage) -> DataFrame:
    """(word, near, near_n): all ordered pairs of staged words (word, n) one edit apart; a pair may come twice."""
    length = F.char_length("word")
    kind = (length >= LONG).cast("int")
    places = F.array_distinct(F.transform(F.array(length - 1, length, length + 1), lambda m: (m >= LONG).cast("int")))

    def end(side: Column, kind: Column) -> Column:
        letters = F.when(kind == 1, 4).otherwise(2)
        return F.when(side == 1, F.substring("word", F.lit(1), letters)).otherwise(F.substring("word", -letters, letters))

    rows = words.select("word", "n", kind.alias("own"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("kind", F.explode(places))
    parts = max(1, -(-words.count() // GROUP))
    name = F.pmod(F.xxhash64("kind", end(F.col("side"), F.col("kind"))), F.lit(parts))
    rows = stage(rows.select("word", "n", "side", (F.col("own") == F.col("kind")).alias("asks"), (name * 2 + F.col("side")).alias("grp")))
    tiles = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("tiles"))
    dealt = rows.join(small(stage(tiles)), "grp").withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    here = F.col("own") == F.col("to")
    as_word = F.struct(F.col("to").alias("q"), F.col("own").alias("t"), F.lit(True).alias("indexed"), (F.col("asks") & here).alias("asked"))
    as_query = F.struct(F.col("own").alias("q"), F.col("to").alias("t"), F.lit(False).alias("indexed"), F.lit(True).alias("asked"))
    roles = F.when(here | ~F.col("asks"), F.array(as_word)).otherwise(F.array(as_word, as_query))
    work = dealt.select("grp", "side", "word", "n", F.inline(roles))
    return work.groupBy("grp", "q", "t").applyInArrow(_search, "word string, near string, near_n long")


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    stage = Stage(docs.sparkSession, "spelling")
    words = stage(vocabulary(docs, id, text))
    best = F.min(F.struct((-F.col("near_n")).alias("rest"), "near")).alias("best")
    chosen = near_words(words, stage).groupBy("word").agg(F.count_distinct("near").alias("n_near"), best)
    enough = -F.col("best.rest") >= 2 * F.col("n")
    formed = stage(
        words.join(chosen, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"),
            F.when(enough, -F.col("best.rest")).alias("form_n"),
        )
    )
    # Counts at least double from word to form, so doubling the steps ends after a few passes.
    reach = formed.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reach = stage(reach.join(onward, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if reach.filter("moved").isEmpty():
            break
        reach = reach.drop("moved")
    return formed.join(reach.drop("moved"), "word").select("word", "form", "root", "n", "n_near", "form_n")

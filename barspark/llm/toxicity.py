"""Toxicity scores: a learned lexicon, met exactly or misspelled, weighed by the words around it.

``learn`` finds terms that mark toxic texts in at most ``SAMPLE`` labelled rows: whole
words or word beginnings whose documents are toxic far beyond chance. The terms form a
trie, together with the whole words of the same evidence that stand behind a beginning.
A Levenshtein automaton of the word at hand (one edit, a swap of neighbours included) is
intersected with that trie, so misspelled terms count too; words that are one edit from a
term but known from clean texts are no misspellings.

Each meeting is weighed by its context window: inside quotation marks, or after words
of reporting, it is quotation and counts little; beside words that address somebody it
counts more. The sum goes through a logistic curve fitted on the same rows.

Null and empty texts, and texts without any term, get the curve's lowest score. Ties and
repeated rows are scored alike; extra columns are kept. A table without labels of both
kinds gives a model without terms that finds nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import (
    ALNUM,
    HashTable,
    Stage,
    arrow_map,
    bytes_of,
    fresh,
    slices,
    small_batches,
    text_column,
    windows,
    word_hashes,
    word_spans,
)

#: Bound of the labelled rows that terms and curve are learned from: those with the smallest hashes of their id.
SAMPLE = 20_000
#: Bounds of the terms considered and kept, those with the most evidence.
LONGEST = 14
#: Least twice log likelihood ratio of a term, and its least share of toxic documents. A term's weight grows with that share.
EVIDENCE, PURITY = 24.0, 0.5
#: Minimum hashes of a text, and how many of them near copies share (which estimates a Jaccard similarity of two thirds).
SKETCH, AGREED = 15, 10
FUZZY_LENGTH = 5  # shorter terms are met exactly only
STATES = 50_000
CACHE = 1 << 20
WINDOW = 40  # characters of context on each side

FUZZY, QUOTED, ADDRESSED = 0.85, 0.25, 1.25
WORD = re.compile(r"[^\W\d_]+")
# Quotation marks as (opening, closing), and words of reporting and of address.
MARKS = [('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("‘", "’"), ("`", "`")]
REPORTING = {"said", "says", "wrote", "called", "quote", "quoted", "word", "term", "sagte", "schrieb", "wort", "dit", "mot", "dijo", "palabra"}
ADDRESS = {"you", "your", "you're", "u", "du", "dich", "ihr", "tu", "vous", "te", "toi", "usted", "eres"}


class Trie:
    """Terms by letter; ``terms`` are met as the beginning of a word, misspelled ones as the whole word, ``forms`` only misspelled.

    ``near`` runs the Levenshtein automaton of one edit over the trie. A state is the set
    of (node, edits, letter still to come) that the letters read so far can stand for;
    states and steps between them are made when first needed, so a word costs one look-up
    per letter. At most ``STATES`` are remembered.
    """

    def __init__(self, terms: dict[str, float], forms: dict[str, float] | None = None) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.weight = [0.0]
        self.long = [0.0]  # the weight again, for terms that are long enough to be misspelled
        for term, weight, begins in [*((t, w, True) for t, w in terms.items()), *((t, w, False) for t, w in (forms or {}).items())]:
            node = 0
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.weight.append(0.0)
                    self.long.append(0.0)
                node = self.children[node][letter]
            if begins:
                self.weight[node] = weight
            if len(term) >= FUZZY_LENGTH:
                self.long[node] = max(self.long[node], weight)
        self.terms = terms
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepted: list[float] = []
        self._number(frozenset([(0, 0, "")]))

    def begins(self, word: str) -> float:
        """Weight of the term that the word begins with, or 0."""
        node = 0
        for letter in word:
            node = self.children[node].get(letter, -1)
            if node < 0:
                return 0.0
            if self.weight[node]:
                return self.weight[node]
        return 0.0

    def near(self, word: str) -> float:
        """Weight of a term that is at most one edit or one swap of neighbours from the word, or 0."""
        if len(self.states) > STATES:
            self._forget()
        state = 0
        for letter in word:
            after = self.steps[state].get(letter)
            if after is None:
                after = self.steps[state][letter] = self._number(self._step(self.states[state], letter))
            if after < 0:
                return 0.0
            state = after
        return self.accepted[state]

    def _number(self, state: frozenset) -> int:
        if not state:
            return -1
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            ends = [self.long[node] for node, _, waits in state if not waits]
            ends += [self.long[child] for node, edits, waits in state if not edits for child in self.children[node].values()]
            self.accepted.append(max(ends, default=0.0))
        return self.numbers[state]

    def _step(self, state: frozenset, letter: str) -> frozenset:
        after = set()
        for node, edits, waits in state:
            own = self.children[node]
            if waits:  # the second of two swapped letters
                if waits == letter:
                    after.add((node, 1, ""))
                continue
            if letter in own:
                after.add((own[letter], edits, ""))
            if edits:
                continue
            after.add((node, 1, ""))  # a letter put in
            for other, child in own.items():
                after.add((child, 1, ""))  # another letter
                if letter in self.children[child]:
                    beyond = self.children[child][letter]
                    after.add((beyond, 1, ""))  # a letter left out
                    after.add((beyond, 1, other))  # or two letters swapped
        return frozenset(after)


@dataclass
class Model:
    """Terms with their weights, words that are no misspellings of them, the curve from summed weight and length to a score,
    and the whole words behind terms that are beginnings."""

    terms: dict[str, float]
    innocent: set[str]
    curve: tuple[float, float, float]
    forms: dict[str, float] = field(default_factory=dict)


class Matcher:
    """Summed weights of the terms in texts; built once per task."""

    def __init__(self, model: Model) -> None:
        self.trie, self.innocent = Trie(model.terms, model.forms), model.innocent
        self.known = HashTable(CACHE.bit_length())

    def kind(self, word: str) -> tuple[float, float]:
        """Weight of the term that a word is, and of the one that it misspells."""
        exact = self.trie.begins(word)
        return exact, 0.0 if exact or word in self.innocent else FUZZY * self.trie.near(word)

    def weights(self, column: pa.Array) -> np.ndarray:
        """Only texts with a suspicious word are looked at closely; words are judged once and remembered."""
        out = np.zeros(len(column))
        if not self.trie.terms:
            return out
        data, offsets = bytes_of(column)
        starts, stops, hashes, rows = word_spans(column, ALNUM)
        names, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        state = self.known.get(names)
        new = np.flatnonzero(state == 0)
        if len(new):
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)]
            judged = np.array([2 if any(any(self.kind(w)) for w in WORD.findall(word.lower())) else 1 for word in words], np.int32)
            if self.known.held + len(new) > CACHE:
                self.known = HashTable(CACHE.bit_length())
            if len(new) <= CACHE:
                self.known.put(names[new], judged)
            state[new] = judged
        hit = np.flatnonzero(state[which] == 2)
        for i in np.unique(np.searchsorted(rows, hit, "right") - 1).tolist():
            out[i] = self.weigh(data[offsets[i] : offsets[i + 1]].tobytes().decode())
        return out

    def weigh(self, text: str) -> float:
        """Sum over the terms of a text, each by its context window."""
        low = text.lower() if len(text.lower()) == len(text) else text
        quotes = _quoted(text)
        total = 0.0
        for m in WORD.finditer(low):
            weight = max(self.kind(m[0]))
            if not weight:
                continue
            at = int(np.searchsorted(quotes[:, 0], m.start(), "right")) - 1
            before = low[max(0, m.start() - WINDOW) : m.start()]
            around = set(WORD.findall(before)) | set(WORD.findall(low[m.end() : m.end() + WINDOW]))
            if at >= 0 and m.end() <= quotes[at, 1] or set(WORD.findall(before)[-3:]) & REPORTING:
                weight *= QUOTED
            elif around & ADDRESS:
                weight *= ADDRESSED
            total += weight
        return total


def _quoted(text: str) -> np.ndarray:
    """(start, end) of quotations: a pair of marks in one line."""
    spans = []
    for a, b in MARKS:
        if a in text:
            spans += [m.span() for m in re.finditer(f"{re.escape(a)}[^{re.escape(a + b)}\n]{{1,300}}{re.escape(b)}", text)]
    return np.array(sorted(spans), np.int64).reshape(-1, 2)


def _beginnings(text: str) -> set[str]:
    """Beginnings of the words of a text, from three letters to ``LONGEST``."""
    words = {w[:LONGEST] for w in WORD.findall(text.lower()) if len(w) >= 3}
    return {w[:k] for w in words for k in range(3, len(w) + 1)}


def _counted(df: DataFrame, make_words) -> DataFrame:
    """Documents per term, added up per slice before they are shuffled."""

    def make():
        pick = make_words()

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(pick(text))
            return pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        return kernel

    return arrow_map(df.select("text"), make, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _ratio(hit: int, other: int, toxic: int, clean: int) -> float:
    """Twice the log likelihood ratio of a term's documents being toxic as often as any."""
    n, share = hit + other, toxic / (toxic + clean)
    own = hit / n
    gain = hit * math.log(own / share) if hit else 0.0
    return 2 * (gain + (other * math.log((1 - own) / (1 - share)) if other else 0.0))


def choose_terms(found: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms by evidence, with weights of at most 1; of beginnings with the same documents the longest, and nothing that a chosen one begins."""
    scored = []
    for term, (hit, other) in found.items():
        if hit / (hit + other) >= PURITY:
            gain = _ratio(hit, other, toxic, clean)
            if gain >= EVIDENCE:
                scored.append((-gain, -len(term), term, hit))
    chosen: dict[str, int] = {}
    for _, _, term, hit in sorted(scored):
        covered = any(term[:k] in chosen for k in range(3, len(term) + 1))
        if covered or any(c.startswith(term) and hit <= 1.25 * n for c, n in chosen.items()):
            continue
        chosen = {c: n for c, n in chosen.items() if not c.startswith(term)}
        chosen[term] = hit
    return {term: _weight(*found[term], toxic, clean) for term in sorted(chosen)}


def _weight(hit: int, other: int, toxic: int, clean: int) -> float:
    return min(1.0, (math.log((hit + 0.5) / (other + 0.5)) - math.log(toxic / clean)) / 6)


def _least_hits(toxic: int, clean: int) -> int:
    """Toxic documents that a term without clean ones needs for ``EVIDENCE``."""
    return max(1, math.ceil(EVIDENCE / (2 * math.log((toxic + clean) / toxic)) - 1e-9))


def _whole_words(terms: dict[str, float]):
    """Maker of a function from a text to its words that a term begins and that are long enough to be misspelled."""

    def make():
        trie = Trie(terms)
        return lambda text: {w for w in set(WORD.findall(text.lower())) if len(w) >= FUZZY_LENGTH and w not in terms and trie.begins(w)}

    return make


def _forms(toxic: DataFrame, clean: DataFrame, terms: dict[str, float], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Whole words behind the terms, with their own weights, if they alone have the evidence and purity of a term."""
    hits = _counted(toxic, _whole_words(terms)).filter(F.col("n") >= _least_hits(n_toxic, n_clean))
    others = _counted(clean, _whole_words(terms)).withColumnRenamed("n", "other")
    forms = {}
    for r in hits.join(others, "term", "left").fillna(0, ["other"]).filter(F.col("n") >= PURITY * (F.col("n") + F.col("other"))).toLocalIterator():
        if _ratio(r.n, r.other, n_toxic, n_clean) >= EVIDENCE:
            forms[r.term] = _weight(r.n, r.other, n_toxic, n_clean)
    return dict(sorted(forms.items()))


def _curve(weights: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic fit of label on log1p(weight) and log length (chance meetings grow with it), weakly pulled to 0, classes equal."""
    x = np.stack([np.ones(len(weights)), np.log1p(weights), np.log(100.0 + lengths)], 1)
    share = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    beta, pull = np.zeros(3), np.array([1e-3, 0.3, 0.3])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        gradient = x.T @ (share * (labels - p)) - pull * beta
        bend = (x * (share * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(bend, gradient)
        beta += step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(beta.tolist())


def _sketch(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``SKETCH`` minimum hashes of a text's three-word runs (of its words, if it has fewer)."""
    draw = np.random.default_rng(1)
    keys = draw.integers(0, 1 << 63, (SKETCH, 2), np.uint64)
    for column in columns:
        out = []
        for batch in slices(pa.RecordBatch.from_arrays([column], ["text"])):
            hashes, rows = word_hashes(batch.column(0), ALNUM)
            runs, first = windows(hashes, rows, 3)
            cuts = np.searchsorted(first, rows)
            least = np.zeros((batch.num_rows, SKETCH), np.int64)
            for values, ends, chosen in ((hashes, rows, cuts[1:] == cuts[:-1]), (runs, cuts, cuts[1:] > cuts[:-1])):
                some = np.flatnonzero(chosen & (ends[1:] > ends[:-1]))
                if not len(some):
                    continue
                # segments of other texts lie between those of the chosen ones; odd places are left out
                at = np.stack([ends[:-1][some], ends[1:][some]], 1).ravel()
                at = at[: -1 if at[-1] == len(values) else None]
                for j, (key, odd) in enumerate(keys):
                    mixed = (values.view(np.uint64) ^ key) * (odd | np.uint64(1))
                    least[some, j] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), at)[::2].view(np.int64)
            out += least.tolist()
        yield pa.array(out, pa.list_(pa.int64()))


def far_apart(sketches: np.ndarray) -> np.ndarray:
    """Numbers of the rows that no kept row before them shares ``AGREED`` hashes with."""
    kept, numbers = np.empty_like(sketches), []
    for i, own in enumerate(sketches):
        m = len(numbers)
        if not m or not ((kept[:m] == own).sum(1) >= AGREED).any():
            kept[m] = own
            numbers.append(i)
    return np.array(numbers, np.int64)


def _without_copies(sample: DataFrame) -> DataFrame:
    """Of copies and near copies with one label one row; ``sample`` is staged, has at most about SAMPLE rows, and a number per row."""
    rows = sample.select("row", "place", "label", "sketch").toPandas().sort_values(["label", "place", "row"])
    kept: list[int] = []
    for _, own in rows.groupby("label"):
        kept += own["row"].to_numpy()[far_apart(np.stack(own["sketch"].to_list()))].tolist()
    numbers = sample.sparkSession.createDataFrame([(i,) for i in kept], "row long")
    return sample.join(F.broadcast(numbers), "row", "left_semi")


def _candidates(toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(term, n, other) of the beginnings with evidence and purity: parts of words of at most ``SAMPLE`` texts."""
    hit, other = F.col("n"), F.col("other")
    share = n_toxic / (n_toxic + n_clean)
    likely = _counted(toxic, lambda: _beginnings).filter(hit >= _least_hits(n_toxic, n_clean))
    both = likely.join(_counted(clean, lambda: _beginnings).withColumnRenamed("n", "other"), "term", "left").fillna(0, ["other"])
    own = hit / (hit + other)
    gain = hit * F.log(own / share) + F.when(other > 0, other * F.log((1 - own) / (1 - share))).otherwise(0.0)
    return both.filter(own >= PURITY).withColumn("gain", 2 * gain).filter(F.col("gain") >= EVIDENCE - 1e-9)


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled rows given; the caller leaves out what is to be held out.

    Of copies and near copies one text is learned from, or every word of a text that is
    often copied would seem to mark its label.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "toxicity")
    own = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(label).alias("label"))
    own = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    source = text_column(docs.select(F.col(id).alias("id"), F.col(text).alias("text")))
    small_batches(spark)
    sketch = F.arrow_udf(_sketch, "array<long>")
    sample = source.join(F.broadcast(own), "id").withColumn("sketch", sketch("text")).dropDuplicates(["sketch", "label"])
    sample = stage(sample.select(F.monotonically_increasing_id().alias("row"), F.xxhash64("id", "text").alias("place"), "text", "label", "sketch"))
    sample = stage(_without_copies(sample).select("text", "label"))
    toxic, clean = sample.filter("label = 1"), sample.filter("label = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return Model({}, set(), (-3.0, 1.0, 0.0))
    found = _candidates(toxic, clean, n_toxic, n_clean).collect()
    terms = choose_terms({r.term: (r.n, r.other) for r in found}, n_toxic, n_clean)
    forms = _forms(toxic, clean, terms, n_toxic, n_clean)

    def near_terms():
        matcher = Matcher(Model(terms, set(), (0.0, 1.0, 0.0), forms))
        judged: dict[str, bool] = {}

        def pick(text: str) -> list[str]:
            words = set(WORD.findall(text.lower()))
            for w in words - judged.keys():
                judged[w] = matcher.kind(w)[1] > 0
            return [w for w in words if judged[w]]

        return pick

    spread = clean.repartition(spark.sparkContext.defaultParallelism * 4)  # a word near a term costs more than reading it
    found = _counted(spread, near_terms)
    model = Model(terms, {r.term for r in found.collect()}, (0.0, 1.0, 0.0), forms)
    weighed = weigh(sample, model).select("label", "weight", F.length("text").alias("chars")).toPandas()  # at most SAMPLE rows
    model.curve = _curve(weighed["weight"].to_numpy(), weighed["chars"].to_numpy(), weighed["label"].to_numpy().astype(float))
    return model


def weigh(docs: DataFrame, model: Model, text: str = "text", out: str = "weight") -> DataFrame:
    """Add the summed weight of the terms of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def weights(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value)
        for column in columns:
            parts = [matcher.weights(b.column(0)) for b in slices(pa.RecordBatch.from_arrays([column], ["text"]))]
            yield pa.array(np.concatenate([np.zeros(0), *parts]))

    small_batches(docs.sparkSession)
    return docs.withColumn(out, weights(F.coalesce(F.col(text), F.lit(""))))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add a score from 0 to 1 for each whole text."""
    offset, slope, length = model.curve
    made = fresh(docs, "weight")
    chars = F.coalesce(F.length(text), F.lit(0))
    x = F.lit(offset) + F.lit(slope) * F.log1p(made) + F.lit(length) * F.log(chars + 100.0)
    return weigh(docs, model, text, made).withColumn(out, 1 / (1 + F.exp(-x))).drop(made)

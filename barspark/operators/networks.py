"""Many small classification networks at once, one per key.

A network has one hidden layer of rectified units and a softmax over classes. Its rows
lie in blocks of bounded size. In an epoch each block goes through its rows once in
mini-batches (decoupled weight decay, dropout on the hidden layer), starting from the
key's common state; then the states of a key's blocks are averaged by their row counts.
A key with one block thus trains exactly as one loop over mini-batches would, in one
task and without further passes; a key with many blocks takes one pass over its packed
blocks per epoch. Training stops early when the loss of the validation rows has not
improved for ``patience`` epochs; the weights of that epoch are kept.

Draws depend on the seed, the epoch and the block only, so a network doesn't depend on
what other keys are trained beside it, nor on a task being run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barspark.series import BLK, stage

DOUBLES = T.ArrayType(T.DoubleType())
#: States of at most so many numbers in all are broadcast to the blocks; more are shuffled to them.
BROADCAST_NUMBERS = 4_000_000


@dataclass(frozen=True)
class Training:
    """Settings of a network and its training."""

    hidden: int = 64
    classes: int = 5
    dropout: float = 0.5
    epochs: int = 30
    rate: float = 1e-4
    decay: float = 0.01
    batch: int = 256
    patience: int = 5
    seed: int = 42


@lru_cache(maxsize=16)
def initial(inputs: int, t: Training) -> np.ndarray:
    """Weights before training: normal draws scaled by fan in and out, biases 0.

    The k-th draw comes from md5(seed:k) by the Box-Muller rule.
    """
    h, c = t.hidden, t.classes
    digests = [hashlib.md5(f"{t.seed}:{k}".encode()).hexdigest() for k in range(inputs * h + h * c)]
    u, v = (np.array([(int(d[a : a + 8], 16) + 0.5) / 2**32 for d in digests]) for a in (0, 8))
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    first = z[: inputs * h] * np.sqrt(2 / (inputs + h))
    second = z[inputs * h :] * np.sqrt(2 / (h + c))
    return np.concatenate([first, np.zeros(h), second, np.zeros(c)])


def layers(w: np.ndarray, inputs: int, t: Training) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Views of a flat weight vector."""
    a = inputs * t.hidden
    b = a + t.hidden
    c = b + t.hidden * t.classes
    return w[:a].reshape(inputs, t.hidden), w[a:b], w[b:c].reshape(t.hidden, t.classes), w[c:]


def probabilities(w: np.ndarray, x: np.ndarray, t: Training) -> np.ndarray:
    first, bias, second, end = layers(w, x.shape[1], t)
    logits = np.maximum(x @ first + bias, 0) @ second + end
    logits -= logits.max(axis=1, keepdims=True)
    out = np.exp(logits)
    return out / out.sum(axis=1, keepdims=True)


def losses(w: np.ndarray, x: np.ndarray, y: np.ndarray, t: Training) -> np.ndarray:
    """Cross-entropy of each row."""
    return -np.log(np.maximum(probabilities(w, x, t)[np.arange(len(y)), y], 1e-300))


def gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray, t: Training, mask: np.ndarray | None = None) -> np.ndarray:
    """Gradient of the mean cross-entropy of a batch; ``mask`` scales the hidden units."""
    first, bias, second, end = layers(w, x.shape[1], t)
    before = x @ first + bias
    hidden = np.maximum(before, 0)
    if mask is not None:
        hidden = hidden * mask
    logits = hidden @ second + end
    logits -= logits.max(axis=1, keepdims=True)
    out = np.exp(logits)
    out /= out.sum(axis=1, keepdims=True)
    out[np.arange(len(y)), y] -= 1
    out /= len(y)
    back = out @ second.T
    if mask is not None:
        back *= mask
    back *= before > 0
    return np.concatenate([(x.T @ back).ravel(), back.sum(0), (hidden.T @ out).ravel(), out.sum(0)])


@dataclass
class State:
    """Weights, both moments of their gradients, and the steps taken."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    steps: float

    @staticmethod
    def start(inputs: int, t: Training) -> State:
        w = initial(inputs, t)
        return State(w.copy(), np.zeros_like(w), np.zeros_like(w), 0.0)


def epoch(s: State, x: np.ndarray, y: np.ndarray, t: Training, number: int, block: int) -> State:
    """One pass over a block in shuffled mini-batches."""
    w, m, v, steps = s.w.copy(), s.m.copy(), s.v.copy(), s.steps
    draw = np.random.default_rng([t.seed, number, block])
    order = draw.permutation(len(y))
    for first in range(0, len(y), t.batch):
        rows = order[first : first + t.batch]
        mask = (draw.random((len(rows), t.hidden)) >= t.dropout) / (1 - t.dropout) if t.dropout else None
        g = gradient(w, x[rows], y[rows], t, mask)
        steps += 1
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w * (1 - t.rate * t.decay) - t.rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return State(w, m, v, steps)


def train(x: np.ndarray, y: np.ndarray, vx: np.ndarray, vy: np.ndarray, t: Training) -> np.ndarray | None:
    """The weights of a network whose rows fit one block; None without training rows."""
    if not len(y):
        return None
    s, best, bad = State.start(x.shape[1], t), np.inf, 0
    for number in range(t.epochs):
        s = epoch(s, x, y, t, number, 0)
        loss = float(losses(s.w, vx, vy, t).mean()) if len(vy) else 0.0
        best, bad = (loss, 0) if loss < best else (best, bad + 1)
        if bad >= t.patience:
            break
    return s.w


# On Spark


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _packed(table: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """Training rows and validation rows of a block in series order."""
    table = table.sort_by([("place", "ascending")]).combine_chunks()
    x = _matrix(table.column("x").combine_chunks(), width)
    y = table.column("label").to_numpy().astype(np.int64)
    mine = table.column("train").to_numpy(zero_copy_only=False).astype(bool)
    return x[mine], y[mine], x[~mine], y[~mine]


def fit_networks(rows: DataFrame, keys: list[str], inputs: int, t: Training, block: int) -> DataFrame:
    """(keys, network): the flat weights of a network per key that has training rows.

    ``rows`` has the keys, ``x`` (array of double), ``label`` (class number), ``train`` (else a row
    for validation), ``place`` (place in the series) and ``whole`` (rows of the series).
    """
    fields = [rows.schema[k] for k in keys]
    packs = ["tx", "ty", "vx", "vy"]
    schema = T.StructType([*fields, T.StructField(BLK, T.LongType()), T.StructField("network", DOUBLES), *[T.StructField(p, T.BinaryType()) for p in packs]])

    def pack(table: pa.Table) -> pa.Table:
        parts = _packed(table, inputs)
        head = {k: table.column(k).slice(0, 1) for k in [*keys, BLK]}
        alone = table.column("whole")[0].as_py() <= block
        weights = train(*parts, t) if alone else None
        packed = [None if alone else (p.astype(np.int64) if p.ndim == 1 else p).tobytes() for p in parts]
        network = pa.array([None if weights is None else weights.tolist()], pa.list_(pa.float64()))
        return pa.table([*head.values(), network, *[pa.array([p], pa.binary()) for p in packed]], [*head, "network", *packs])

    dealt = rows.withColumn(BLK, F.floor(F.col("place") / F.lit(block)).cast("long")).select(*keys, BLK, "place", "whole", "x", "label", "train")
    done = stage(dealt.groupBy(*keys, BLK).applyInArrow(pack, schema))
    alone = done.filter(F.col("network").isNotNull()).select(*keys, "network")
    blocks = done.filter(F.col("tx").isNotNull()).drop("network")
    if blocks.isEmpty():
        return alone
    return alone.unionByName(_in_passes(blocks, keys, inputs, t))


def _in_passes(blocks: DataFrame, keys: list[str], inputs: int, t: Training) -> DataFrame:
    """Networks of keys with several blocks: an epoch is one pass, in which a block trains from its key's state."""
    names = ["w", "m", "v"]
    start = State.start(inputs, t)
    state = blocks.select(*keys).distinct().select(
        *keys, F.array(*[F.lit(float(x)) for x in start.w]).alias("w"), *[F.array_repeat(F.lit(0.0), len(start.w)).alias(c) for c in "mv"],
        F.lit(0.0).alias("steps"), F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"),
    )
    state, finished = stage(state), []
    few = state.count() * 3 * len(start.w) <= BROADCAST_NUMBERS
    fields = [blocks.schema[k] for k in keys]
    schema = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in ("rows", "loss", "judged", "steps")], *[T.StructField(c, DOUBLES) for c in names]])
    for number in range(t.epochs):
        joined = blocks.join(F.broadcast(state) if few else state, keys)
        parts = joined.mapInArrow(_one_epoch(keys, inputs, t, number), schema)
        sums = _averaged(stage(parts), keys, names)
        loss = F.when(F.lit(number) > 0, F.coalesce(F.col("loss") / F.col("judged"), F.lit(0.0))).otherwise(F.lit(float("inf")))
        old = state.select(*keys, F.col("w").alias("before"), "best", "bad")
        moved = sums.join(old, keys).withColumn("now", loss)
        better = F.col("now") < F.col("best")
        bad = F.when(better | F.lit(number == 0), F.lit(0)).otherwise(F.col("bad") + 1)
        moved = stage(moved.select(*keys, *names, "steps", "before", F.least("best", "now").alias("best"), bad.alias("bad")))
        # The loss just seen is that of the weights before this pass: those stay if it was the last straw.
        finished.append(moved.filter(F.col("bad") >= t.patience).select(*keys, F.col("before").alias("network")))
        state = moved.filter(F.col("bad") < t.patience).drop("before")
        if state.isEmpty():
            break
    finished.append(state.select(*keys, F.col("w").alias("network")))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def _one_epoch(keys: list[str], inputs: int, t: Training, number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i].as_py() for c in ("tx", "ty", "vx", "vy", "w", "m", "v", "steps", BLK)}
                x, vx = (np.frombuffer(one[c]).reshape(-1, inputs) for c in ("tx", "vx"))
                y, vy = (np.frombuffer(one[c], np.int64) for c in ("ty", "vy"))
                s = State(*(np.array(one[c]) for c in ("w", "m", "v")), one["steps"])
                loss = float(losses(s.w, vx, vy, t).sum()) if len(vy) else 0.0
                new = epoch(s, x, y, t, number, one[BLK]) if len(y) else s
                values = [pa.array([float(v)], pa.float64()) for v in (len(y), loss, len(vy), new.steps)]
                arrays = [pa.array([a.tolist()], pa.list_(pa.float64())) for a in (new.w, new.m, new.v)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, 1) for k in keys], *values, *arrays], [*keys, "rows", "loss", "judged", "steps", "w", "m", "v"])

    return run


def _averaged(parts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """States of a key's blocks, averaged by training rows, number by number, so that partial sums meet before the shuffle."""
    whole = parts.groupBy(*keys).agg(F.sum("loss").alias("loss"), F.sum("judged").alias("judged"), F.max("steps").alias("steps"))
    each = parts.filter("rows > 0").select(*keys, "rows", F.posexplode(F.arrays_zip(*names)).alias("at", "one"))
    means = each.groupBy(*keys, "at").agg(*[(F.sum(F.col("one")[c] * F.col("rows")) / F.sum("rows")).alias(c) for c in names])
    lists = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", *names))).alias("all"))
    return whole.join(lists.select(*keys, *[F.col(f"all.{c}").alias(c) for c in names]), keys)

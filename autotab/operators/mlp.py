"""Multilayer perceptron for classes: ReLU layers with dropout, mini-batches, Adam.

A step draws a mini-batch by hashing row numbers. Steps follow each other, so an epoch deals the rows of all blocks of
``matrix.packed`` out by runs of consecutive mini-batches (one shuffle), and each run is one task that takes ``MERGE`` blocks
of bytes at most, makes its Adam steps and hands the weights on: jobs follow the bytes, not the steps. Dropout masks follow from the
step and the row number, so a task that runs again makes the same steps. Where the matrix fits into one block, its task makes
the steps of an epoch by itself; one of up to ``HELD_BYTES`` is gathered in one partition, and a task makes the steps of
``EPOCHS`` epochs. Two classes have one output with a sigmoid, more have a softmax.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.proba import argmax
from . import matrix
from .boosting import margins_to_proba, probabilities
from .features import _Fitted
from .matrix import TRAIN, Block, mixed, packed, rows_of

#: Blocks of bytes that a run of mini-batches holds.
MERGE = 4
#: Bytes of a matrix that one task holds, and epochs that it then makes.
HELD_BYTES, EPOCHS = 512 << 20, 10


@dataclass(frozen=True)
class MlpOptions:
    hidden: tuple[int, ...] = (128,)
    dropout: float = 0.1
    learningRate: float = 1e-3
    epochs: int = 25
    batchSize: int = 128
    seed: int = 42


def start_weights(sizes: list[int], seed: int) -> list[np.ndarray]:
    """Glorot-uniform weights and zero biases, layer by layer."""
    rng, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:], strict=False):
        bound = math.sqrt(6 / (a + b))
        out += [rng.uniform(-bound, bound, (a, b)), np.zeros(b)]
    return out


def margins_of(weights: list[np.ndarray], x: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Output margins and every layer's input."""
    inputs, h = [], x
    for i in range(0, len(weights), 2):
        inputs.append(h)
        h = h @ weights[i] + weights[i + 1]
        if i + 2 < len(weights):
            h = np.maximum(h, 0)
            if masks is not None:
                h = h * masks[i // 2]
    return h, inputs


def loss_and_gradient(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray, masks: list[np.ndarray] | None = None) -> tuple[float, list[np.ndarray]]:
    """Summed weighted log loss and its derivatives by the weights."""
    m, inputs = margins_of(weights, x, masks)
    p = margins_to_proba(m)
    loss = -float((w * np.log(np.maximum(p[np.arange(len(y)), y.astype(int)], 1e-15))).sum())
    delta = w[:, None] * ((p[:, 1:] - (y == 1)[:, None]) if m.shape[1] == 1 else p - (y[:, None] == np.arange(m.shape[1])))
    out: list[np.ndarray] = [None] * len(weights)
    for i in range(len(weights) - 2, -1, -2):
        out[i], out[i + 1] = inputs[i // 2].T @ delta, delta.sum(0)
        if i:
            delta = delta @ weights[i].T * (inputs[i // 2] > 0)
            if masks is not None:
                delta = delta * masks[i // 2 - 1]
    return loss, out


def masks_of(uid: np.ndarray, o: MlpOptions, step: int) -> list[np.ndarray] | None:
    """Dropout masks (kept units are scaled up) that follow from row, unit and step."""
    if o.dropout <= 0:
        return None
    return [(mixed(uid[:, None] * 4096 + np.arange(n)[None, :], o.seed * 31 + step * 64 + layer) >= o.dropout) / (1 - o.dropout) for layer, n in enumerate(o.hidden)]


def turns_of(b: Block, o: MlpOptions, epoch: int, steps: int) -> np.ndarray:
    """The mini-batch of every row; an epoch's batches part the rows."""
    return np.floor(mixed(b.uid, o.seed * 1_009 + epoch) * steps).astype(np.int64)


def batch_gradient(b: Block, rows: np.ndarray, weights: list[np.ndarray], o: MlpOptions, step: int) -> np.ndarray | None:
    """(loss, weight, gradient) of the block's share of a mini-batch, flat."""
    if not len(rows):
        return None
    x = b.x[rows] if b.finite else np.nan_to_num(b.x[rows])
    loss, g = loss_and_gradient(weights, x, b.y[rows], b.w[rows], masks_of(b.uid[rows], o, step))
    return np.concatenate([[loss, b.w[rows].sum()], *[v.ravel() for v in g]])


class Adam:
    """All weights stand in one vector, ``weights`` are views of it: a step is a few operations however many layers there are."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.rate, self.t, self.shapes = rate, 0, [w.shape for w in weights]
        self.flat = np.concatenate([np.ravel(w).astype(float) for w in weights])
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)

    @property
    def weights(self) -> list[np.ndarray]:
        ends = np.cumsum([math.prod(s) for s in self.shapes])
        return [v.reshape(s) for v, s in zip(np.split(self.flat, ends[:-1]), self.shapes, strict=True)]

    def step(self, flat: np.ndarray) -> None:
        """One step from summed (loss, weight, gradient)."""
        self.t += 1
        g = flat[2:] / max(flat[1], 1e-300)
        # Adam's usual decay rates and epsilon.
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        self.flat = self.flat - self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-7)


def steps_inside(own: list[Block], adam: Adam, o: MlpOptions, epoch: int, steps: int, turns: range) -> np.ndarray:
    """The Adam steps of an epoch's mini-batches ``turns``, whose rows are all in ``own``; their summed (loss, weight)."""
    total, sorted_rows = np.zeros(2), []
    for b in own:
        turn = np.where(b.train, turns_of(b, o, epoch, steps), -1)
        order = np.argsort(turn, kind="stable")
        sorted_rows.append((b, order, np.searchsorted(turn[order], np.arange(turns.start, turns.stop + 1))))
    for i, turn in enumerate(turns):
        parts = [g for b, order, at in sorted_rows if (g := batch_gradient(b, order[at[i]:at[i + 1]], adam.weights, o, epoch * steps + turn)) is not None]
        if parts:
            adam.step(sum(parts))
            total += sum(parts)[:2]
    return total


def dealt(data: DataFrame, o: MlpOptions, epoch: int, steps: int, run: int) -> DataFrame:
    """The training rows as blocks per ``run`` consecutive mini-batches of the epoch (column ``g``), each run in one partition."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                g = np.where(b.train, turns_of(b, o, epoch, steps) // run, -1)
                for i in np.unique(g[g >= 0]).tolist():
                    rows = g == i
                    n = int(rows.sum())
                    parts = [v[rows].tobytes() for v in (b.uid, b.y, b.w)] + [np.full(n, TRAIN, np.int8).tobytes(), b.x[rows].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (i, b.set, n, b.d)] + [pa.array([v]) for v in parts],
                                                     names=["g", "set", "n", "d", "uid", "y", "w", "role", "x"])

    return data.mapInArrow(deal, f"g int, {matrix.PACKED}").repartition(-(-steps // run), "g").persist(StorageLevel.MEMORY_AND_DISK)


def gathered(data: DataFrame) -> DataFrame:
    """The training rows by themselves in one partition, in the order of their numbers: batches of them stay small."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                ends = np.arange(0, (b.n + 1) * 8 * b.d, 8 * b.d, dtype=np.int32) if b.d else np.zeros(b.n + 1, np.int32)
                x = pa.Array.from_buffers(pa.binary(), b.n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(r["x"])])
                yield pa.RecordBatch.from_arrays([pa.array(b.uid), pa.array(b.y), pa.array(b.w), x], names=["uid", "y", "w", "x"])

    return data.mapInArrow(rows, "uid long, y double, w double, x binary").repartition(1).sortWithinPartitions("uid").persist(StorageLevel.MEMORY_AND_DISK)


def held(batches: Iterator[pa.RecordBatch], n: int, d: int) -> Block | None:
    """The rows of ``gathered`` as one block, without NaN."""
    b, at = Block.__new__(Block), 0
    b.finite = True
    b.set, b.n, b.d, b.uid, b.y, b.w, b.train, b.x = 0, n, d, np.empty(n, np.int64), np.empty(n), np.empty(n), np.ones(n, bool), np.empty((n, d))
    for batch in batches:
        end = at + batch.num_rows
        b.uid[at:end], b.y[at:end], b.w[at:end] = (batch.column(c).to_numpy() for c in ("uid", "y", "w"))
        b.x[at:end] = np.nan_to_num(np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, d))
        at = end
    return b if at else None


class Perceptron(Estimator):
    """MLP classifier as a Spark ML estimator; ``losses`` of the model hold the mean loss of every epoch."""

    def __init__(self, classes: int = 2, labelCol: str = "label", featuresCol: str = "features", weightCol: str | None = None, key: list[str] | None = None, **options):
        super().__init__()
        self.classes, self.labelCol, self.featuresCol, self.weightCol, self.key, self.o = classes, labelCol, featuresCol, weightCol, key, MlpOptions(**options)

    def _fit(self, df):
        o, k = self.o, self.classes if self.classes > 2 else 1
        key = self.key or [c for c, t in df.dtypes if t != "vector"]
        blocks, whole = packed([rows_of(df, key, 0, TRAIN, self.weightCol, self.labelCol, self.featuresCol)])
        data = blocks.drop("keys")
        size = data.agg(F.sum("n").alias("n"), F.max("d").alias("d")).first()
        if not size["n"]:
            raise ValueError("no rows to learn from")
        steps = max(1, -(-size["n"] // o.batchSize))
        run = steps if whole else min(steps, max(1, MERGE * matrix.BLOCK_BYTES // (8 * max(1, size["d"]) * o.batchSize)))
        adam, lost = Adam(start_weights([size["d"], *o.hidden, k], o.seed), o.learningRate), []
        n, d = int(size["n"]), int(size["d"])
        one = not whole and 8 * n * (d + 3) <= HELD_BYTES

        def inside(adam: Adam, epoch: int, turns: range):
            def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                own = [Block(r) for batch in batches for r in batch.to_pylist()]
                if own:
                    total = steps_inside(own, adam, o, epoch, steps, turns)
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((adam, total))])], names=["v"])
            return task

        def epochs_of(adam: Adam, first: int, last: int):
            def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                b = held(batches, n, d)
                if b is not None:
                    totals = [steps_inside([b], adam, o, epoch, steps, range(steps)) for epoch in range(first, last)]
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((adam, totals))])], names=["v"])
            return task

        if one:
            rows = gathered(data)
            for first in range(0, o.epochs, EPOCHS):
                for r in rows.mapInArrow(epochs_of(adam, first, min(o.epochs, first + EPOCHS)), "v binary").collect():
                    adam, totals = pickle.loads(r["v"])
                    lost += [float(t[0] / max(t[1], 1e-300)) for t in totals]
            rows.unpersist()
        for epoch in range(0 if one else o.epochs):
            total, rows = np.zeros(2), data if whole else dealt(data, o, epoch, steps, run)
            for g in range(-(-steps // run)):
                turns = range(g * run, min(steps, (g + 1) * run))
                mine = rows if whole else rows.where(F.col("g") == g).drop("g")
                for r in mine.mapInArrow(inside(adam, epoch, turns), "v binary").collect():
                    adam, part = pickle.loads(r["v"])
                    total += part
            if not whole:
                rows.unpersist()
            lost.append(float(total[0] / max(total[1], 1e-300)))
        blocks.unpersist()
        return PerceptronModel({"classes": self.classes, "weights": [w.tolist() for w in adam.weights], "losses": lost, "features": self.featuresCol})


class PerceptronModel(_Fitted):
    """Scores without dropout; transforms like a Spark ML model (prediction, rawPrediction, probability)."""

    predictionCol, probabilityCol, rawPredictionCol = "prediction", "probability", "rawPrediction"

    def setPredictionCol(self, c):
        self.predictionCol = c
        return self

    def setProbabilityCol(self, c):
        self.probabilityCol = c
        return self

    def setRawPredictionCol(self, c):
        self.rawPredictionCol = c
        return self

    @property
    def losses(self) -> list[float]:
        return self.state["losses"]

    def _transform(self, df):
        weights = [np.array(w) for w in self.state["weights"]]

        @F.pandas_udf("array<double>")
        def margins(v: pd.Series) -> pd.Series:
            return pd.Series(list(margins_of(weights, np.nan_to_num(np.stack(v.to_list())))[0])) if len(v) else pd.Series([], dtype=object)

        classes, m = self.state["classes"], F.col("__margins")
        d = df.withColumn("__margins", margins(vector_to_array(F.col(self.state["features"])))).withColumn("__p", probabilities(m, classes))
        return (d.withColumn(self.rawPredictionCol, array_to_vector(F.array(-m[0], m[0]) if classes <= 2 else m)).withColumn(self.probabilityCol, array_to_vector("__p"))
                .withColumn(self.predictionCol, argmax(F.col("__p")).cast("double")).drop("__margins", "__p"))

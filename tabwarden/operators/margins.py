"""Linear margins by mini-batches, and random features in place of a kernel.

The mini-batch fit deals rows by hash into batches that lie apart in a stored table; a step reads one batch, adds its gradient up by a tree of
tasks and moves the weights, whose average over the later steps is the model. Random Fourier features turn a linear margin into one of a radial kernel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.store import stored
from .boosting import InSql
from .side_by_side import PACKED, summed, tasks_of

#: Batches of an epoch, epochs, and the share of the steps, at the end, whose weights are averaged.
BATCHES, EPOCHS, AVERAGED = 8, 6, 0.5
#: Random features of a kernel, and the seed of their draw.
LIFTED, SEED = 100, 42


def numbers(values) -> str:
    """SQL of an array of doubles."""
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def dot(x: str, weights) -> str:
    return f"aggregate(zip_with({x}, {numbers(weights)}, (a, b) -> a * b), 0.0D, (s, v) -> s + v)"


@dataclass
class Linear(InSql):
    """Margins of one output for two classes, else of one for each class against the rest; a score is where the margin lies between -1 and 1."""

    k: int
    weights: np.ndarray
    intercepts: np.ndarray

    def margins(self, x: str) -> list[str]:
        return [f"({dot(x, w)} + ({float(b)!r}D))" for w, b in zip(self.weights, self.intercepts)]

    def chances(self, margins: list[str]) -> list[str]:
        each = [f"((greatest(-1.0D, least(1.0D, {m})) + 1.0D) / 2.0D)" for m in margins]
        if self.k == 2:
            return [f"(1.0D - {each[0]})", each[0]]
        total = f"({' + '.join(each)})"
        return [f"(CASE WHEN {total} > 0 THEN {e} / {total} ELSE {1 / self.k!r}D END)" for e in each]


def huber_slope(margin: np.ndarray, side: np.ndarray) -> np.ndarray:
    """By the margin, the slope of max(0, 1 - y f)² for y f from -1 on, of -4 y f below; side is y, -1 or 1."""
    at = side * margin
    return np.where(at >= 1, 0.0, np.where(at >= -1, -2 * (1 - at), -4.0)) * side


def huber_loss(margin: np.ndarray, side: np.ndarray) -> np.ndarray:
    at = side * margin
    return np.where(at >= -1, np.maximum(0.0, 1 - at) ** 2, -4 * at)


def fit_by_batches(rows: DataFrame, k: int, width: int, regParam: float = 0.0001, elasticNetParam: float = 0.15, rate: float = 1.0, epochs: int = EPOCHS) -> Linear:
    """The modified Huber loss with an elastic net on weights of scaled features, by stochastic gradient steps over rows (label, features).

    A step over a batch has the size rate / (2 (1 + width) sqrt(1 + t / BATCHES)) and is followed by the shrinking of the L1 part. Batches follow from the rows'
    values, equal rows share one; a batch may be empty. Deterministic but for the order of sums.
    """
    out = 1 if k == 2 else k
    batch = F.pmod(F.xxhash64("label", vector_to_array("features")), F.lit(BATCHES)).cast("int")
    dealt = rows.select(batch.alias("batch"), F.col("label").cast("int").alias("label"), vector_to_array("features").alias("x")).repartitionByRange("batch", F.rand(SEED)).sortWithinPartitions("batch")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column(0).to_numpy()
            label, x = b.column(1).to_numpy(), b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, width)
            for one in np.unique(of):
                mine = of == one
                yield pa.RecordBatch.from_pydict({
                    "fold": [of[mine].tobytes()], "label": [label[mine].tobytes()], "x": [x[mine].tobytes()], "wide": pa.array([width], pa.int32()), "batch": pa.array([one], pa.int32()),
                })

    data = stored(dealt.mapInArrow(pack, PACKED + ", batch int"), "batches")
    parts = tasks_of(data)  # of a batch no more
    every = lambda df, work, size: summed(df.select("fold", "label", "x", "wide"), work, size, parts)
    first = every(data, lambda _, __, x: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]), 1 + 2 * width)
    mean = first[1 : 1 + width] / max(first[0], 1)
    std = np.sqrt(np.maximum(first[1 + width :] / max(first[0], 1) - mean**2, 0))
    scale = np.where(std > 1e-12 * np.maximum(np.abs(mean), 1), 1 / np.where(std > 0, std, 1), 0.0)

    w, b, kept, steps = np.zeros((out, width)), np.zeros(out), [], epochs * BATCHES
    for t in range(steps):
        def slope(_, label: np.ndarray, x: np.ndarray, w=w, b=b) -> np.ndarray:
            z = (x - mean) * scale
            side = np.where((label == 1)[:, None] if out == 1 else label[:, None] == np.arange(k), 1.0, -1.0)
            r = huber_slope(z @ w.T + b, side)
            return np.concatenate([[len(x)], (r.T @ z).ravel(), r.sum(axis=0)])

        found = every(data.filter(F.col("batch") == t % BATCHES), slope, 1 + out * (width + 1))
        size = rate / (2 * (1 + width) * np.sqrt(1 + t / BATCHES))
        if found[0]:
            w = w - size * (found[1 : 1 + out * width].reshape(out, width) / found[0] + regParam * (1 - elasticNetParam) * w)
            b = b - size * found[1 + out * width :] / found[0]
            w = np.sign(w) * np.maximum(np.abs(w) - size * regParam * elasticNetParam, 0)
        if t >= steps * (1 - AVERAGED):
            kept.append((w, b))
    w, b = (np.mean([x[i] for x in kept], axis=0) for i in (0, 1))
    return Linear(k, w * scale, b - (w * scale) @ mean)


@dataclass
class Lift:
    """Random Fourier features: sqrt(2 / D) cos(w x + b), whose inner products are near those of a radial kernel exp(-gamma |x - y|²)."""

    weights: np.ndarray
    shifts: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, width: int, gamma: float | None = None, lifted: int = LIFTED) -> Lift:
        """gamma: if not given, 1 over the number of features and the variance of all their values."""
        if gamma is None:
            told = rows.select(Summarizer.metrics("mean", "variance").summary(F.col("features")).alias("s")).select("s.mean", "s.variance").first()
            mean, variance = told["mean"].toArray(), told["variance"].toArray()
            gamma = 1 / (width * max(float(variance.mean() + mean.var()), 1e-12))
        draw = np.random.default_rng(SEED)
        return cls(draw.normal(0, np.sqrt(2 * gamma), (lifted, width)), draw.uniform(0, 2 * np.pi, lifted))

    def sql(self, x: str) -> str:
        """SQL of the array of random features of an array."""
        each = f"array({', '.join(numbers(w) for w in self.weights)})"
        inner = f"aggregate(zip_with(w, {x}, (a, b) -> a * b), 0.0D, (s, v) -> s + v)"
        return f"transform({each}, (w, i) -> {float(np.sqrt(2 / len(self.shifts)))!r}D * cos({inner} + get({numbers(self.shifts)}, i)))"

    def lifted(self, df: DataFrame, features: str, name: str) -> DataFrame:
        """df with a vector column of the random features of another one."""
        return df.withColumn(f"{name}x", vector_to_array(features)).withColumn(name, array_to_vector(F.expr(self.sql(f"`{name}x`")))).drop(f"{name}x")


def folds_of_rows(folds: int) -> Column:
    """A fold by the values of a row (label, features), equal rows in one."""
    return F.pmod(F.xxhash64("label", vector_to_array("features"), F.lit("curve")), F.lit(folds))

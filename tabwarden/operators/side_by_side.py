"""Logistic models of many candidates and folds fitted side by side: one pass over the rows for each step of all of them.

Rows are packed once into blocks, which stay stored. A step multiplies each block with the weights of all candidates and folds, one
matrix, and adds losses and gradients up over rows, tasks and a tree of tasks. The driver holds weights only, as many as there are
candidates, folds, classes and features, and moves each candidate by itself (limited-memory steps; orthants where there is an L1 part).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from ..functions.store import stored

#: Rows of a block, partial sums that one task of a level adds up, and numbers that a partial sum may have.
BLOCK, FAN, MOST_NUMBERS = 4096, 32, 4_000_000
#: Steps that a candidate remembers, the least relative gain of a step, most steps, and halvings of one step.
MEMORY, TOLERANCE, MOST_STEPS, HALVINGS = 10, 1e-9, 200, 30

PACKED = "fold binary, label binary, x binary, wide int"
SUMS = "numbers binary"


def packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (fold, label, features as a vector) as stored blocks of numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = len(b.column(2)[0]) if b.num_rows else 0
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, wide)
            fold, label = b.column(0).to_numpy(zero_copy_only=False).astype(np.int32), b.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            for at in range(0, b.num_rows, BLOCK):
                part = slice(at, at + BLOCK)
                yield pa.RecordBatch.from_pydict({"fold": [fold[part].tobytes()], "label": [label[part].tobytes()], "x": [x[part].tobytes()], "wide": pa.array([wide], pa.int32())})

    return stored(rows.select(*columns, vector_to_array("features").alias("x")).mapInArrow(work, PACKED), "blocks")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            fold, label = (np.frombuffer(b.column(j)[i].as_buffer(), np.int32) for j in (0, 1))
            yield fold, label, np.frombuffer(b.column(2)[i].as_buffer(), np.float64).reshape(len(fold), b.column(3)[i].as_py())


def totals(df: DataFrame, parts_of, size: int, parts: int | None = None) -> np.ndarray:
    """The sum of the arrays of `size` numbers that parts_of(batches) yields over all rows: by task, then by a tree of tasks, then here. parts: tasks of df, if known."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for part in parts_of(batches):
            total += part
        yield pa.RecordBatch.from_pydict({"numbers": [total.tobytes()]})

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for i in range(b.num_rows):
                total += np.frombuffer(b.column(0)[i].as_buffer(), np.float64)
        yield pa.RecordBatch.from_pydict({"numbers": [total.tobytes()]})

    parts, found = tasks_of(df) if parts is None else parts, df.mapInArrow(one, SUMS)
    while parts > FAN:
        parts = math.ceil(parts / FAN)
        found = found.repartition(parts).mapInArrow(more, SUMS)
    return sum((np.frombuffer(r["numbers"], np.float64) for r in found.collect()), np.zeros(size))  # FAN rows at most


def tasks_of(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def summed(df: DataFrame, work, size: int, parts: int | None = None) -> np.ndarray:
    """The sum over all blocks of what work(fold, label, x) gives, an array of `size` numbers."""
    return totals(df, lambda batches: (work(*block) for block in blocks(batches)), size, parts)


class Descent:
    """The way of one candidate to the least of loss + l1 |w|: limited-memory quasi-Newton steps that stay within an orthant where l1 > 0."""

    def __init__(self, size: int, l1: np.ndarray, steps: int):
        self.at, self.l1, self.left = np.zeros(size), l1, steps
        self.trial, self.done, self.worth, self.first = self.at, False, None, True
        self.past: list[tuple[np.ndarray, np.ndarray]] = []
        self.halved, self.step = 0, 1.0

    def slope(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The steepest way up: where a weight is 0, none while the loss's slope is within l1."""
        up, down = g + self.l1, g - self.l1
        return np.where(w > 0, up, np.where(w < 0, down, np.where(down > 0, down, np.where(up < 0, up, 0.0))))

    def told(self, loss: float, g: np.ndarray) -> None:
        """Loss and gradient at `trial`; sets the next trial."""
        worth = loss + float(np.abs(self.trial) @ self.l1)
        if not self.first:
            if worth > self.worth + 1e-4 * float(self.up @ (self.trial - self.at)) and self.halved < HALVINGS:
                self.halved, self.step = self.halved + 1, self.step / 2
                self.trial = self.moved()
                return
            if worth >= self.worth:
                self.done = True
                return
            s, y = self.trial - self.at, g - self.g
            if s @ y > 1e-12 * (y @ y):
                self.past = [*self.past, (s, y)][-MEMORY:]
            gain, self.left = (self.worth - worth) / max(abs(worth), 1e-12), self.left - 1
            self.done = gain < TOLERANCE or self.left <= 0
        self.at, self.g, self.worth, self.first = self.trial, g, worth, False
        self.up = self.slope(self.at, g)
        self.done = self.done or float(np.abs(self.up).max(initial=0)) < 1e-9
        self.way = self.direction()
        self.halved, self.step = 0, 1.0 if self.past else 1.0 / max(1.0, float(np.linalg.norm(self.up)))
        self.trial = self.at if self.done else self.moved()

    def direction(self) -> np.ndarray:
        q, used = self.up.copy(), []
        for s, y in reversed(self.past):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append((a, s, y))
        if self.past:
            s, y = self.past[-1]
            q *= (s @ y) / (y @ y)
        for a, s, y in reversed(used):
            q += (a - (y @ q) / (s @ y)) * s
        way = -q
        way[(way * self.up >= 0) & (self.l1 > 0)] = 0.0
        return way if way @ self.up < 0 else -self.up

    def moved(self) -> np.ndarray:
        to = self.at + self.step * self.way
        side = np.where(self.at != 0, np.sign(self.at), -np.sign(self.up))
        return np.where((self.l1 > 0) & (to * side < 0), 0.0, to)


def fit_logistic(data: DataFrame, k: int, width: int, folds: int, candidates: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, intercepts) of each candidate and fold over raw features: arrays of candidates x folds x outputs (1 for two classes, else K) x features, and without the last.

    data: blocks of packed(). A model of fold f is fitted on the rows of the others; candidates have regParam, elasticNetParam and maxIter. Penalties are on weights of
    features scaled by their sample deviation over the rows of the fit, and not on intercepts, as `pyspark.ml` has them, so both have one optimum.
    """
    out, parts = 1 if k == 2 else k, tasks_of(data)
    moments = summed(data, lambda fold, label, x: np.concatenate([
        np.concatenate([[np.sum(fold != f)], x[fold != f].sum(axis=0), (x[fold != f] ** 2).sum(axis=0)]) for f in range(folds)
    ]), folds * (1 + 2 * width), parts).reshape(folds, 1 + 2 * width)
    n = moments[:, 0]
    mean = moments[:, 1 : 1 + width] / np.maximum(n, 1)[:, None]
    spread = np.sqrt(np.maximum(moments[:, 1 + width :] - n[:, None] * mean**2, 0) / np.maximum(n - 1, 1)[:, None])
    flat = spread <= 1e-12 * np.maximum(np.abs(mean), 1)  # a constant feature has no weight
    scale = np.where(flat, 0.0, 1 / np.where(flat, 1.0, spread))

    reg = np.array([float(c.get("regParam", 0.0)) for c in candidates])
    mix = np.array([float(c.get("elasticNetParam", 0.0)) for c in candidates])
    size = out * (width + 1)
    penal = np.zeros((out, width + 1))
    penal[:, :width] = 1.0
    ways = [[Descent(size, reg[c] * mix[c] * penal.ravel(), int(candidates[c].get("maxIter", 100))) for _ in range(folds)] for c in range(len(candidates))]
    l2 = reg * (1 - mix)
    if len(candidates) * folds * (size + 1) > MOST_NUMBERS:
        raise ValueError("too many candidates for so many features")

    for _ in range(MOST_STEPS * 2):
        live = [(c, f) for c in range(len(candidates)) for f in range(folds) if not ways[c][f].done]
        if not live:
            break
        trial = np.array([ways[c][f].trial for c, f in live]).reshape(len(live), out, width + 1)
        mine = np.array([f for _, f in live])
        raw = trial[:, :, :width] * scale[mine][:, None, :]
        plus = trial[:, :, width] - (raw * mean[mine][:, None, :]).sum(axis=2)

        def step(fold: np.ndarray, label: np.ndarray, x: np.ndarray, raw=raw, plus=plus, mine=mine) -> np.ndarray:
            z = np.einsum("nd,mod->nmo", x, raw, optimize=True) + plus
            used = (fold[:, None] != mine).astype(np.float64)
            if out == 1:
                y = (label == 1).astype(np.float64)[:, None]
                s = z[:, :, 0]
                loss = (np.logaddexp(0.0, s) - y * s) * used
                r = ((1 / (1 + np.exp(-np.clip(s, -700, 700))) - y) * used)[:, :, None]
            else:
                top = z.max(axis=2, keepdims=True)
                e = np.exp(z - top)
                total = e.sum(axis=2, keepdims=True)
                one = (np.arange(k) == label[:, None])[:, None, :]
                loss = (np.log(total[:, :, 0]) + top[:, :, 0] - (z * one).sum(axis=2)) * used
                r = (e / total - one) * used[:, :, None]
            g = np.einsum("nmo,nd->mod", r, x, optimize=True)
            return np.concatenate([loss.sum(axis=0), g.ravel(), r.sum(axis=0).ravel()])

        found = summed(data, step, len(live) * (1 + out * width + out), parts)
        loss = found[: len(live)]
        g, r = found[len(live) : len(live) * (1 + out * width)].reshape(len(live), out, width), found[len(live) * (1 + out * width) :].reshape(len(live), out)
        for i, (c, f) in enumerate(live):
            w = trial[i, :, :width]
            inner = (g[i] - r[i][:, None] * mean[f]) * scale[f] / n[f] + l2[c] * w
            ways[c][f].told(loss[i] / n[f] + l2[c] * float((w**2).sum()) / 2, np.concatenate([inner, r[i][:, None] / n[f]], axis=1).ravel())

    at = np.array([[w.at for w in row] for row in ways]).reshape(len(candidates), folds, out, width + 1)
    weights = at[..., :width] * scale[None, :, None, :]
    return weights, at[..., width] - (weights * mean[None, :, None, :]).sum(axis=3)


def scores(data: DataFrame, k: int, weights: np.ndarray, intercepts: np.ndarray) -> DataFrame:
    """(model, y, p): of each candidate (by number, as text) the scores of each row by the model that did not see its fold."""
    out = weights.shape[2]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, label, x in blocks(batches):
            for c in range(len(weights)):
                z = np.einsum("nd,nod->no", x, weights[c][fold]) + intercepts[c][fold]
                if out == 1:
                    p1 = 1 / (1 + np.exp(-np.clip(z[:, 0], -700, 700)))
                    p = np.stack([1 - p1, p1], axis=1)
                else:
                    e = np.exp(z - z.max(axis=1, keepdims=True))
                    p = e / e.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_pydict({"model": [str(c)] * len(fold), "y": pa.array(label, pa.int32()), "p": pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), k).cast(pa.list_(pa.float64()))})

    return data.mapInArrow(work, "model string, y int, p array<double>")

"""Boosted trees of second order: soft-max over all classes, quantile bins, gradient and hessian histograms summed by a tree of tasks.

Rows are binned once and stored as blocks of small numbers with their margins. A pass over the blocks gives, for every node of a level of
every class's tree, feature and bin, the sums of gradients and hessians; the driver holds those sums only, picks the splits, and
sends the trees out with the next pass. Margins are stored anew every few rounds, so that a pass adds up few trees.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.store import stored
from .side_by_side import BLOCK, MOST_NUMBERS, tasks_of, totals

#: Bins of a feature, rounds after which margins are stored anew, and the least hessian of a child.
BINS, REFRESH, LEAST_WEIGHT = 64, 10, 1e-3

PACKED = "label binary, bins binary, margin binary, rows int"


@dataclass
class Tree:
    """A complete binary tree by levels, node i over 2 i + 1 and 2 i + 2: a row goes left where its feature is at or below the threshold. A node without a feature (-1) is a leaf."""

    feature: list[int]
    threshold: list[float]
    bin: list[int]
    value: list[float]

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins comes to."""
        at, feature, cut = np.zeros(len(bins), np.int64), np.array(self.feature), np.array(self.bin)
        while (live := np.flatnonzero(feature[at] >= 0)).size:
            f = feature[at[live]]
            at[live] = 2 * at[live] + 1 + (bins[live, f] > cut[at[live]])
        return at

    def nodes(self, i: int = 0):
        """As nested nodes (feature, threshold, below or at it, above it) and leaves [value]."""
        return [self.value[i]] if self.feature[i] < 0 else (self.feature[i], self.threshold[i], self.nodes(2 * i + 1), self.nodes(2 * i + 2))

    def sql(self, x: str, depth: int) -> str:
        """SQL of its value for an array of features, a walk of `depth` steps over arrays, so that the expression does not grow with the tree's shape."""
        told = lambda numbers: f"array({', '.join(map(str, numbers))})"
        doubles = lambda numbers: f"array({', '.join(f'{v!r}D' for v in numbers)})"
        walk = f"CASE WHEN get({told(self.feature)}, n) < 0 THEN n WHEN get({x}, get({told(self.feature)}, n)) <= get({doubles(self.threshold)}, n) THEN 2 * n + 1 ELSE 2 * n + 2 END"
        return f"get({doubles(self.value)}, aggregate(sequence(1, {max(1, depth)}), 0, (n, i) -> {walk}))"


class InSql:
    """A model of k classes that is SQL over an array of features: margins(x) of its outputs, and chances(margins) of the classes."""

    def scored(self, df: DataFrame, features: str, tag: str) -> tuple[DataFrame, Column]:
        """df with hidden columns, and the class scores over them, from a vector column."""
        x, m = f"_x{tag}", [f"_m{tag}{c}" for c in range(1 if self.k == 2 else self.k)]
        df = df.withColumn(x, vector_to_array(features)).withColumns({n: F.expr(s) for n, s in zip(m, self.margins(f"`{x}`"))})
        return df, F.array(*[F.expr(s) for s in self.chances([f"`{n}`" for n in m])])


@dataclass
class Boosted(InSql):
    """A fitted model: a tree for each round and output (one output for two classes, else one for each class)."""

    k: int
    depth: int
    trees: list[list[Tree]] = field(default_factory=list)
    #: What all splits on a feature gained.
    gains: dict[int, float] = field(default_factory=dict)

    def margins(self, x: str) -> list[str]:
        """SQL of each output's margin for an array of features."""
        out = 1 if self.k == 2 else self.k
        return [" + ".join(["0.0D", *(r[c].sql(x, self.depth) for r in self.trees)]) for c in range(out)]

    def chances(self, margins: list[str]) -> list[str]:
        """SQL of each class's score from the outputs' margins."""
        if self.k == 2:
            p = f"(1.0D / (1.0D + exp(-({margins[0]}))))"
            return [f"(1.0D - {p})", p]
        top = f"greatest({', '.join(margins)})"
        parts = [f"exp({m} - {top})" for m in margins]
        return [f"({e} / ({' + '.join(parts)}))" for e in parts]


def cut_points(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """The thresholds of each feature: all values but the greatest where there are at most `bins`, else quantiles by a sketch."""
    x = rows.select(vector_to_array("features").alias("x")).select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(width)])
    names, out = x.columns, []
    few = x.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    sketch = x.approxQuantile(names, [i / bins for i in range(bins + 1)], 0.2 / bins) if width else []
    for i, c in enumerate(names):
        values = [r[0] for r in x.select(c).distinct().limit(bins + 1).collect()] if few[c] <= bins * 1.2 else None
        points = sorted(values) if values is not None and len(values) <= bins else sorted(set(sketch[i]))
        out.append(np.array(points[:-1], np.float64))
    return out


def binned(rows: DataFrame, cuts: list[np.ndarray], outputs: int) -> DataFrame:
    """Rows (label, features) as stored blocks: a feature's bin is the number of thresholds below its value. NaN is above all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, len(cuts))
            placed = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8) if cuts else np.zeros((b.num_rows, 0), np.uint8)
            label = b.column(0).to_numpy(zero_copy_only=False).astype(np.int32)
            for at in range(0, b.num_rows, BLOCK):
                n = len(label[at : at + BLOCK])
                yield pa.RecordBatch.from_pydict({
                    "label": [label[at : at + BLOCK].tobytes()], "bins": [placed[at : at + BLOCK].tobytes()], "margin": [np.zeros((n, outputs)).tobytes()], "rows": pa.array([n], pa.int32()),
                })

    return stored(rows.select("label", vector_to_array("features").alias("x")).mapInArrow(work, PACKED), "binned")


def opened(batches: Iterator[pa.RecordBatch], width: int, outputs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            n = b.column(3)[i].as_py()
            yield (
                np.frombuffer(b.column(0)[i].as_buffer(), np.int32), np.frombuffer(b.column(1)[i].as_buffer(), np.uint8).reshape(n, width),
                np.frombuffer(b.column(2)[i].as_buffer(), np.float64).reshape(n, outputs),
            )


def added(bins: np.ndarray, margin: np.ndarray, rounds: list[list[Tree]]) -> np.ndarray:
    margin = margin.copy()
    for trees in rounds:
        for c, t in enumerate(trees):
            margin[:, c] += np.array(t.value)[t.of_bins(bins)]
    return margin


def slopes(label: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the log loss by each output's margin."""
    if margin.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
        return p - (label == 1)[:, None], p * (1 - p)
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return p - (label[:, None] == np.arange(margin.shape[1])), p * (1 - p)


def fit_boosted(
    rows: DataFrame, k: int, width: int, rounds: int = 10, depth: int = 5, step: float = 0.1, reg_lambda: float = 1.0, gamma: float = 0.0, share: float = 1.0,
    columns: float = 1.0, positive: float = 1.0, bins: int = BINS, seed: int = 42,
) -> Boosted:
    """A model of all classes from rows (label 0 to K - 1, features).

    A split gains (GL² / (HL + λ) + GR² / (HR + λ) - G² / (H + λ)) / 2 - gamma and is made where that is above 0, ties to the first feature and least threshold; a leaf adds
    -step G / (H + λ). `share` of the rows, drawn for each round, and `columns` of the features, drawn for each tree, take part. Of two
    classes, rows of class 1 count `positive` times. Deterministic by seed and stored blocks. ValueError where a level's sums would be more than MOST_NUMBERS.
    """
    out = 1 if k == 2 else k
    cuts = cut_points(rows, width, min(bins, 255))
    wide = max([len(c) + 1 for c in cuts], default=1)
    if (1 << max(depth - 1, 0)) * out * width * wide * 2 > MOST_NUMBERS:
        raise ValueError("too many nodes, features and bins for one level")
    data, kept, draw = binned(rows, cuts, out), 0, np.random.default_rng(seed)
    model, parts = Boosted(k, depth), tasks_of(data)
    for r in range(rounds):
        taken = [np.sort(draw.permutation(width)[: max(1, round(columns * width))]) for _ in range(out)] if width else [np.zeros(0, int)] * out
        size = 2 ** (depth + 1) - 1
        trees = [Tree([-1] * size, [0.0] * size, [0] * size, [0.0] * size) for _ in range(out)]
        for level in range(depth + 1):
            first, n = 2**level - 1, 2**level
            live = [[i for i in range(first, first + n) if level == 0 or trees[c].feature[(i - 1) // 2] >= 0] for c in range(out)]
            if not any(live):
                break
            recent, last = model.trees[kept:], level == depth

            def sums(label: np.ndarray, bin_: np.ndarray, margin: np.ndarray, recent=recent, trees=trees, first=first, n=n, last=last, r=r) -> np.ndarray:
                g, h = slopes(label, added(bin_, margin, recent))
                if out == 1 and positive != 1:
                    weight = np.where(label == 1, positive, 1.0)[:, None]
                    g, h = g * weight, h * weight
                if share < 1:
                    mine = np.random.default_rng([seed, r, zlib.crc32(bin_.tobytes())]).random(len(label)) < share
                    g, h, bin_ = g[mine], h[mine], bin_[mine]
                found = []
                for c, tree in enumerate(trees):
                    node = tree.of_bins(bin_) - first
                    here = (node >= 0) & (node < n)
                    for v in (g[here, c], h[here, c]):
                        if last:
                            found.append(np.bincount(node[here], v, n))
                        else:
                            found += [np.bincount(node[here] * wide + bin_[here, f], v, n * wide) for f in range(width)]
                return np.concatenate(found)

            numbers = totals(data, lambda batches: (sums(*x) for x in opened(batches, width, out)), 2 * out * n * (1 if last else width * wide), parts)
            if last:
                for c, (g, h) in enumerate(numbers.reshape(out, 2, n)):
                    for i in live[c]:
                        trees[c].value[i] = float(-step * g[i - first] / (h[i - first] + reg_lambda))
                continue
            for c, (g, h) in enumerate(numbers.reshape(out, 2, width, n, wide)):
                for i in live[c]:
                    split(trees[c], i, g[:, i - first], h[:, i - first], cuts, taken[c], step, reg_lambda, gamma, model)
        model.trees.append(trees)
        if len(model.trees) - kept >= REFRESH and r + 1 < rounds:
            data, kept = refreshed(data, model.trees[kept:], width, out), len(model.trees)
    return model


def split(tree: Tree, i: int, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], taken: np.ndarray, step: float, reg_lambda: float, gamma: float, model: Boosted) -> None:
    """Make node i of a tree a split or a leaf by its sums, features x bins."""
    total_g, total_h = (float(x[0].sum()) if len(x) else 0.0 for x in (g, h))
    tree.value[i] = -step * total_g / (total_h + reg_lambda)
    best = (0.0, -1, 0)
    for f in taken:
        left_g, left_h = np.cumsum(g[f])[: len(cuts[f])], np.cumsum(h[f])[: len(cuts[f])]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = (left_g**2 / (left_h + reg_lambda) + right_g**2 / (right_h + reg_lambda) - total_g**2 / (total_h + reg_lambda)) / 2 - gamma
        gain = np.where((left_h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT), gain, -np.inf)
        if len(gain) and gain.max() > best[0] + 1e-12:
            at = int(np.flatnonzero(gain >= gain.max() - 1e-12)[0])
            best = (float(gain[at]), int(f), at)
    if best[1] >= 0:
        tree.feature[i], tree.bin[i], tree.threshold[i] = best[1], best[2], float(cuts[best[1]][best[2]])
        model.gains[best[1]] = model.gains.get(best[1], 0.0) + best[0]


def refreshed(data: DataFrame, rounds: list[list[Tree]], width: int, outputs: int) -> DataFrame:
    """The blocks with the margins that these rounds add, stored anew."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (_, bins, margin) in enumerate(opened(iter([b]), width, outputs)):
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([added(bins, margin, rounds).tobytes()]), row.column(3)], ["label", "bins", "margin", "rows"])

    return stored(data.mapInArrow(work, PACKED), "binned")

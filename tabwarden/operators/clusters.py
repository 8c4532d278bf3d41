"""Subgroups by self-organising maps, their quality, and the audit within each.

Maps of all sizes are trained and judged side by side: a pass over the rows serves an epoch of all of them, and only sums by unit leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import named, ratio
from .bias import audit
from .side_by_side import packed, summed, tasks_of

#: Passes over the rows that train a map, and how narrow its bell curve is in the last one.
EPOCHS, LAST_SIGMA = 10, 0.3


def davies_bouldin(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """(index): mean over clusters of the worst (scatter + scatter) / distance of centroids; null for a single cluster.

    Only centroids are paired: as many as there are clusters.
    """
    places = [f"f{i}" for i in range(len(features))]
    rows = df.select(named(cluster).alias("c"), *[named(f).cast("double").alias(p) for f, p in zip(features, places)]).alias("r")
    centre = rows.groupBy("c").agg(*[F.avg(p).alias(p) for p in places])
    away = lambda a, b: F.sqrt(sum(((F.col(f"{a}.{p}") - F.col(f"{b}.{p}")) ** 2 for p in places), F.lit(0.0)))
    scatter = rows.join(centre.alias("m"), F.col("r.c") == F.col("m.c")).groupBy(F.col("r.c").alias("c")).agg(F.avg(away("r", "m")).alias("s"))
    sized = centre.join(scatter, "c")
    pairs = sized.alias("a").join(sized.alias("b"), F.col("a.c") != F.col("b.c"))
    worst = pairs.groupBy(F.col("a.c").alias("c")).agg(F.max(ratio(F.col("a.s") + F.col("b.s"), away("a", "b"))).alias("r"))
    return worst.agg(F.avg("r").alias("index"))


@dataclass
class Map:
    """A self-organising map: unit x dim_y + y at (x, y) of a grid, in z-scores of the features."""

    dims: tuple[int, int]
    units: np.ndarray

    @classmethod
    def of(cls, k: int, width: int) -> Map:
        """The grid for at least k units. At first even features rise along x and odd ones along y, between -1 and 1."""
        x = math.ceil(math.sqrt(k))
        made = cls((x, math.ceil(k / x)), np.zeros((0, width)))
        level = [(2 * at + 1) / n - 1 for at, n in zip(made.places().T, made.dims)]
        made.units = np.stack([level[f % 2] for f in range(width)], axis=1) if width else np.zeros((len(level[0]), 0))
        return made

    def places(self) -> np.ndarray:
        return np.array([(x, y) for x in range(self.dims[0]) for y in range(self.dims[1])])

    def nearness(self, epoch: int) -> np.ndarray:
        """How far each unit follows what falls to another one: by a bell curve of their distance on the grid, narrower with each epoch."""
        first = max(min(self.dims) / 2, LAST_SIGMA)
        sigma = first * (LAST_SIGMA / first) ** (epoch / max(1, EPOCHS - 1))
        at = self.places()
        return np.exp(-((at[:, None] - at[None]) ** 2).sum(axis=2) / (2 * sigma**2))


@dataclass
class Scaled:
    """Mean and population deviation of each feature, and the number of rows."""

    mean: np.ndarray
    std: np.ndarray
    rows: int

    def z(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.std > 0, (x - self.mean) / np.where(self.std > 0, self.std, 1), 0.0)


def blocks_of(df: DataFrame, features: list[str]) -> tuple[DataFrame, Scaled]:
    """The features as stored blocks, and their scale: two passes."""
    places, d = [f"_{i}" for i in range(len(features))], len(features)
    rows = df.select(F.lit(0).alias("fold"), F.lit(0).alias("label"), *[named(f).cast("double").alias(p) for f, p in zip(features, places)])
    data = packed(VectorAssembler(inputCols=places, outputCol="features").transform(rows), ["fold", "label"])
    first = summed(data, lambda _, __, x: np.concatenate([[len(x)], x.sum(axis=0)]), 1 + d)
    mean = first[1:] / max(first[0], 1)
    std = np.sqrt(summed(data, lambda _, __, x: ((x - mean) ** 2).sum(axis=0), d) / max(first[0], 1))
    return data, Scaled(mean, std, int(first[0]))


def nearest(z: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit nearest to each row, the first of equal ones, and the squared distance to it."""
    far = np.zeros((len(z), len(units)))
    for f in range(z.shape[1]):
        far += (z[:, f, None] - units[None, :, f]) ** 2
    at = far.argmin(axis=1)
    return at, far[np.arange(len(z)), at]


def batch_maps(data: DataFrame, scale: Scaled, ks: Sequence[int]) -> tuple[list[Map], np.ndarray]:
    """Maps of all sizes trained side by side, and the mean squared distance to the nearest unit by epoch and map.

    In an epoch each unit becomes the mean of all rows, weighted by how near on the grid the row's own unit is.
    """
    d = len(scale.mean)
    maps, errors, parts = [Map.of(k, d) for k in ks], [], tasks_of(data)
    for epoch in range(EPOCHS):
        units = [m.units for m in maps]

        def step(_, __, x: np.ndarray, units=units) -> np.ndarray:
            z, found = scale.z(x), []
            for u in units:
                at, far = nearest(z, u)
                found += [np.bincount(at, minlength=len(u)), *(np.bincount(at, z[:, f], len(u)) for f in range(d)), [far.sum()]]
            return np.concatenate(found).astype(np.float64)

        sums, at, error = summed(data, step, sum(len(u) * (d + 1) + 1 for u in units), parts), 0, []
        for m in maps:
            n = len(m.units)
            part, near = sums[at : at + n * (d + 1)].reshape(d + 1, n), m.nearness(epoch)
            weight = near @ part[0]
            m.units = np.where(weight[:, None] > 0, (near @ part[1:].T) / np.where(weight > 0, weight, 1)[:, None], m.units)
            at += n * (d + 1)
            error.append(sums[at] / max(scale.rows, 1))
            at += 1
        errors.append(error)
    return maps, np.array(errors)


def judged(data: DataFrame, scale: Scaled, maps: list[Map], by: str) -> list[float | None]:
    """For each map the Davies-Bouldin index of its clusters or the mean silhouette by squared distances, over the features as they are; null for a single cluster. Two passes for all maps."""
    d, units = len(scale.mean), [m.units for m in maps]

    def moments(_, __, x: np.ndarray) -> np.ndarray:
        z, found = scale.z(x), []
        for u in units:
            at, _far = nearest(z, u)
            found += [np.bincount(at, minlength=len(u)), np.bincount(at, (x**2).sum(axis=1), len(u)), *(np.bincount(at, x[:, f], len(u)) for f in range(d))]
        return np.concatenate(found).astype(np.float64)

    sums, known, at = summed(data, moments, sum(len(u) * (d + 2) for u in units)), [], 0
    for u in units:
        known.append(sums[at : at + len(u) * (d + 2)].reshape(d + 2, len(u)))
        at += len(u) * (d + 2)

    def spread(_, __, x: np.ndarray) -> np.ndarray:
        z, found = scale.z(x), []
        for u, (n, squares, *total) in zip(units, known):
            at, _far = nearest(z, u)
            centre = np.array(total) / np.maximum(n, 1)
            if by != "silhouette":
                found.append(np.bincount(at, np.sqrt(((x - centre.T[at]) ** 2).sum(axis=1)), len(u)))
                continue
            mean = (x**2).sum(axis=1)[:, None] + squares / np.maximum(n, 1) - 2 * x @ centre
            own = mean[np.arange(len(x)), at] * n[at] / np.maximum(n[at] - 1, 1)
            mean[:, n == 0] = np.inf
            mean[np.arange(len(x)), at] = np.inf
            other = mean.min(axis=1)
            top = np.maximum(own, other)
            found.append([np.where((n[at] > 1) & np.isfinite(other) & (top > 0), (other - own) / np.where(top > 0, top, 1), 0.0).sum()])
        return np.concatenate(found)

    sizes = [1 if by == "silhouette" else len(u) for u in units]
    sums, out = summed(data, spread, sum(sizes)), []
    for (n, _squares, *total), size, end in zip(known, sizes, np.cumsum(sizes)):
        live, part = np.flatnonzero(n), sums[end - size : end]
        if len(live) < 2:
            out.append(None)
        elif by == "silhouette":
            out.append(float(part[0] / max(scale.rows, 1)))
        else:
            centre, scatter = (np.array(total) / np.maximum(n, 1)).T[live], (part / np.maximum(n, 1))[live]
            away = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
            worth = np.where(away > 0, (scatter[:, None] + scatter[None]) / np.where(away > 0, away, 1), -np.inf)
            out.append(float(np.mean([w.max() for w in worth])))
    return out


def placed(df: DataFrame, features: list[str], made: Map, scale: Scaled, name: str = "cluster") -> DataFrame:
    """df with the unit nearest to each row, the first of equal ones."""
    z = [(named(f).cast("double") - float(m)) / float(s) if s > 0 else F.lit(0.0) for f, m, s in zip(features, scale.mean, scale.std)]
    units = F.array(*[F.array(*map(F.lit, map(float, u))) for u in made.units])
    far = lambda u: F.aggregate(F.zip_with("_z", u, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    best = F.array_min(F.transform(units, lambda u, i: F.struct(far(u).alias("far"), i.alias("unit"))))
    return df.withColumn("_z", F.array(*z)).select(*map(named, df.columns), best["unit"].alias(name))


def cluster(df: DataFrame, features: list[str], k: int, name: str = "cluster") -> DataFrame:
    """df with a cluster number: the unit of a self-organising map of at least k units over z-scores. Deterministic; some units may have no rows."""
    data, scale = blocks_of(df, features)
    return placed(df, features, batch_maps(data, scale, [k])[0][0], scale, name)


def choose_clusters(df: DataFrame, features: list[str], ks: range = range(2, 31), by: str = "davies_bouldin") -> tuple[int, DataFrame]:
    """(number of non-empty clusters, df with clusters) for the map of the least Davies-Bouldin index or the greatest silhouette, the first of equal ones.

    All maps are trained and judged side by side: the passes over the rows are those of one.
    """
    data, scale = blocks_of(df, features)
    maps, _ = batch_maps(data, scale, ks)
    worth = [(w if by == "davies_bouldin" else -w, i) for i, w in enumerate(judged(data, scale, maps, by)) if w is not None]
    if not worth:
        raise ValueError("no number of clusters gives more than one cluster")
    chosen = placed(df, features, maps[min(worth)[1]], scale)
    return chosen.select("cluster").distinct().count(), chosen


def audit_clusters(df: DataFrame, scope: Column, facet: str, outcome: str, label=1, numeric: bool = True) -> DataFrame:
    """The audit within each cluster in which neither facet nor outcome is constant; one pass for all clusters."""
    live = df.select("*", scope.cast("string").alias("_scope"))
    ends = live.groupBy("_scope").agg(F.min(named(facet)).alias("a0"), F.max(named(facet)).alias("a1"), F.min(named(outcome)).alias("y0"), F.max(named(outcome)).alias("y1"))
    good = ends.filter("a0 <> a1 and y0 <> y1").select("_scope")
    return audit(live.join(good, "_scope", "left_semi"), facet, outcome, label, None, F.concat(F.lit("Cluster "), F.col("_scope")), numeric)

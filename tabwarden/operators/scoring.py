"""Evaluation of scored rows: confusion counts, rates, AUC, thresholds, fold summaries.

Scored rows are (model, fold, y, p): p is the score of class 1, or an array of scores of classes 0 to K - 1. K, the number of
classes, is told by the caller once and holds for every fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_where, or_zero, ratio
from ..functions.ranges import cut_points, running
from ..functions.store import stored

GROUP = ["model", "fold"]
METRICS = ("sensitivity", "specificity", "auc", "f1", "accuracy", "balanced_accuracy")
#: Thresholds that are tried: 0.02 to 0.97 by 0.05; where none is better than 0, this one.
GRID = tuple(round(0.02 + 0.05 * i, 2) for i in range(20))
FALLBACK = 0.5


def hard_binary(threshold: Column | float = FALLBACK) -> Column:
    """1 where the score is above the threshold, else 0."""
    return F.when(F.col("p") > threshold, 1).otherwise(0)


def hard_class(scores: str = "p") -> Column:
    """Index of the greatest score, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def confusion(scored: DataFrame, threshold: Column | float = FALLBACK, by: list[str] = GROUP) -> DataFrame:
    """tp, fp, tn, fn of each group; counts only cross the shuffle."""
    hit, up = F.col("y") == 1, hard_binary(threshold) == 1
    return scored.groupBy(*by).agg(
        count_where(hit & up).alias("tp"), count_where(~hit & up).alias("fp"), count_where(~hit & ~up).alias("tn"), count_where(hit & ~up).alias("fn"),
    )


def rates(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rates of tp, fp, tn, fn; 0 where a denominator is."""
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    sens, spec, prec = or_zero(tp, tp + fn), or_zero(tn, tn + fp), or_zero(tp, tp + fp)
    return counts.select(
        *by, sens.alias("sensitivity"), spec.alias("specificity"), or_zero(2 * prec * sens, prec + sens).alias("f1"),
        or_zero(tp + tn, tp + fp + tn + fn).alias("accuracy"), ((sens + spec) / 2).alias("balanced_accuracy"),
    )


def score_histogram(scored: DataFrame, by: list[str], positive: Column | None = None) -> DataFrame:
    """(by, p, pos, neg): rows per distinct score. What follows works on distinct scores, not rows."""
    hit = F.col("y") == 1 if positive is None else positive
    return scored.groupBy(*by, "p").agg(count_where(hit).alias("pos"), count_where(~hit).alias("neg"))


def auc(scored: DataFrame, by: list[str] = GROUP, positive: Column | None = None, empty: float | None = None) -> DataFrame:
    """(by, auc): chance that a positive scores above a negative, ties for half; `empty` where a class has no rows."""
    counted = stored(score_histogram(scored, by, positive), "scores")
    h = running(counted, by, "p", cut_points(counted, "p"), {"below": F.col("neg")})
    h = h.select(*by, "pos", "neg", (F.col("pos") * (F.col("below") - 0.5 * F.col("neg"))).alias("won"))
    return h.groupBy(*by).agg(F.coalesce(ratio(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")), F.lit(empty).cast("double")).alias("auc"))


def bundle(scored: DataFrame, threshold: Column | float = FALLBACK, by: list[str] = GROUP) -> DataFrame:
    """Confusion counts and the six metrics of each group, one row."""
    counts = confusion(scored, threshold, by)
    return counts.join(rates(counts, by), by).join(auc(scored, by), by).select(*by, "tp", "fp", "tn", "fn", *METRICS)


def long_metrics(wide: DataFrame, by: list[str] = GROUP, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return wide.unpivot(by, list(metrics), "metric", "value")


def class_confusion(scored: DataFrame, k: int, by: list[str] = GROUP) -> DataFrame:
    """(by, actual, predicted, n) over all K x K cells, those without rows included."""
    seen = scored.select(*by, F.col("y").cast("int").alias("actual"), hard_class().alias("predicted")).groupBy(*by, "actual", "predicted").agg(F.count("*").alias("n"))
    numbers = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    grid = seen.select(*by).distinct().select("*", numbers.alias("actual")).select("*", numbers.alias("predicted"))
    return grid.join(seen, [*by, "actual", "predicted"], "left").select(*by, "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_counts(cells: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """(by, class, tp, fp, tn, fn), each class against the rest, from the cells."""
    n, w = F.col("n"), Window.partitionBy(*by)
    sides = cells.select(*by, F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.when(F.col("actual") == F.col("predicted"), n).otherwise(0).alias("tp"), n.alias("row"), F.lit(0).cast("long").alias("col")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("row"), n.alias("col")),
    )).alias("x")).select(*by, "x.*")
    one = sides.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("row").alias("row"), F.sum("col").alias("col"))
    return one.select(
        *by, "class", "tp", (F.col("col") - F.col("tp")).alias("fp"),
        (F.sum("row").over(w) - F.col("row") - F.col("col") + F.col("tp")).alias("tn"), (F.col("row") - F.col("tp")).alias("fn"),
    )


def one_against_rest(scored: DataFrame, k: int, by: list[str] = GROUP) -> DataFrame:
    """(by, class, y, p): each row once per class, with its score of it and whether it is of it."""
    return scored.select(*by, F.col("y").alias("_y"), F.posexplode(F.slice("p", 1, k)).alias("class", "p")).select(
        *by, "class", (F.col("_y") == F.col("class")).cast("int").alias("y"), "p"
    )


def class_bundle(scored: DataFrame, k: int, by: list[str] = GROUP) -> DataFrame:
    """The six metrics for K classes: macro means over the classes, accuracy over all rows; balanced accuracy is mean recall.

    The AUC of a class that has all rows or none is 0.5.
    """
    per = class_counts(class_confusion(scored, k, by), by)
    known = rates(per, [*by, "class"]).join(per.select(*by, "class", "tp", (F.col("tp") + F.col("fn")).alias("row")), [*by, "class"])
    area = auc(one_against_rest(scored, k, by), [*by, "class"], empty=0.5)
    return known.join(area, [*by, "class"]).groupBy(*by).agg(
        F.avg("sensitivity").alias("sensitivity"), F.avg("specificity").alias("specificity"), F.avg("auc").alias("auc"), F.avg("f1").alias("f1"),
        or_zero(F.sum("tp"), F.sum("row")).alias("accuracy"), F.avg("sensitivity").alias("balanced_accuracy"),
    )


def at_thresholds(scored: DataFrame, grid: tuple[float, ...], by: list[str] = GROUP) -> DataFrame:
    """Confusion counts of each group at each threshold of the grid, from the histogram of scores: rows are read once.

    A threshold's counts are sums over the histogram above and below it, so the thresholds are events among the scores and a
    running sum serves them all.
    """
    events = F.explode(F.array(*[F.lit(float(t)) for t in grid]))
    # Scores between two thresholds fall into one bucket: at most one row more than there are thresholds, per group.
    place = reduce(lambda c, t: c + (F.col("p") > F.lit(float(t))).cast("int"), grid, F.lit(0))
    hit = F.col("y") == 1
    buckets = scored.groupBy(*by, place.alias("_above")).agg(count_where(hit).alias("pos"), count_where(~hit).alias("neg"))
    marks = buckets.select(*by).distinct().select(*by, events.alias("threshold"))
    order = {t: i for i, t in enumerate(sorted(grid))}
    number = reduce(lambda c, x: c.when(F.col("threshold") == F.lit(float(x[0])), x[1]), order.items(), F.when(F.lit(False), 0))
    both = marks.select("*", number.alias("_i")).join(buckets, by)
    up = F.col("_above") > F.col("_i")
    return both.groupBy(*by, "threshold").agg(
        count_where(up, F.col("pos")).alias("tp"), count_where(up, F.col("neg")).alias("fp"), count_where(~up, F.col("neg")).alias("tn"), count_where(~up, F.col("pos")).alias("fn"),
    )


def threshold_sweep(scored: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Sensitivity, specificity and F1 at thresholds 0, 0.1, ..., 1."""
    counts = at_thresholds(scored, tuple(round(i / 10, 1) for i in range(11)), by)
    return rates(counts, [*by, "threshold"]).select(*by, "threshold", "sensitivity", "specificity", "f1")


def best_threshold(scored: DataFrame, metric: str = "balanced_accuracy", by: list[str] = GROUP) -> DataFrame:
    """(by, threshold, score): the smallest threshold of the grid with the greatest metric, rounded to 12 places for ties.

    FALLBACK and a null score where no threshold gives more than 0. The AUC does not depend on the threshold, so by it the
    smallest one is best.
    """
    table = rates(at_thresholds(scored, GRID, by), [*by, "threshold"])
    if metric == "auc":
        table = table.join(auc(scored, by), by)
    best = table.select(*by, F.struct(F.round(metric, 12).alias("s"), (-F.col("threshold")).alias("t")).alias("x")).groupBy(*by).agg(F.max("x").alias("x"))
    good = F.col("x.s") > 0
    return best.select(*by, F.when(good, -F.col("x.t")).otherwise(FALLBACK).alias("threshold"), F.when(good, F.col("x.s")).alias("score"))


def fold_summary(metrics: DataFrame) -> DataFrame:
    """(model, metric, mean, std, summary) over folds, with the population's standard deviation and `mean ± std` as text."""
    one = metrics.groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return one.select("model", "metric", "mean", "std", F.format_string("%.4f ± %.4f", "mean", "std").alias("summary"))


def mean_confusion(cells: DataFrame) -> DataFrame:
    """(model, actual, predicted, n): mean over folds of cells that hold zeros too."""
    return cells.groupBy("model", "actual", "predicted").agg(F.avg("n").alias("n"))


def binary_cells(counts: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """(by, actual, predicted, n) of tp, fp, tn, fn: the layout of a report, actual classes in rows."""
    cell = lambda a, p, c: F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
    return counts.select(*by, F.explode(F.array(cell(1, 1, "tp"), cell(1, 0, "fn"), cell(0, 1, "fp"), cell(0, 0, "tn"))).alias("x")).select(*by, "x.*")


def wide_report(metrics: DataFrame, column: str = "value", by: str = "model") -> DataFrame:
    """One row per model, one column per metric."""
    return metrics.groupBy(by).pivot("metric", list(METRICS)).agg(F.first(column))


def mean_threshold(thresholds: DataFrame) -> DataFrame:
    """Mean over folds of each model's thresholds, FALLBACK if it has none."""
    return thresholds.groupBy("model").agg(F.coalesce(F.avg("threshold"), F.lit(FALLBACK)).alias("threshold"))

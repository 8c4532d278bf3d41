"""ROC and precision-recall curves over distinct scores, per model and class, micro and macro.

Areas are added up from the counts at each score, so no row needs the one before it; running counts of many scores are taken in two
levels, over ranges that follow the scores (`functions/ranges.py`), so no task holds a whole curve. Counts by score are stored first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import or_zero
from ..functions.ranges import cut_points, running
from ..functions.store import stored
from .scoring import one_against_rest, score_histogram

#: Slopes are added and taken away exactly.
SLOPE = "decimal(38,18)"


def cumulative(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, pos, neg, tp, fp, positives, negatives): rows at each score, and rows that score at least it."""
    h = stored(score_histogram(scored, by), "scores")
    down = running(h, by, "p", cut_points(h, "p"), {"tp": F.col("pos"), "fp": F.col("neg")}, {"positives": "tp", "negatives": "fp"}, down=True)
    return down.select(*by, F.col("p").alias("threshold"), "pos", "neg", "tp", "fp", "positives", "negatives")


def true_rate(count: str) -> Column:
    return or_zero(F.col(count), F.col("positives"))


def false_rate(count: str) -> Column:
    return or_zero(F.col(count), F.col("negatives"))


def roc(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, fpr, tpr) from (0, 0), whose threshold is null, to (1, 1); a side without rows is 0 throughout."""
    points = cumulative(scored, by).select(*by, "threshold", false_rate("fp").alias("fpr"), true_rate("tp").alias("tpr"))
    zero = F.lit(0.0)
    return points.unionByName(scored.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"), zero.alias("fpr"), zero.alias("tpr")))


def areas(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc, ap) of cumulative counts: trapezoids under the ROC points; precision at each score weighted by the recall it adds."""
    under = false_rate("neg") * (true_rate("tp") - true_rate("pos") / 2)
    return counts.groupBy(*by).agg(F.sum(under).alias("auc"), F.sum(true_rate("pos") * or_zero(F.col("tp"), F.col("tp") + F.col("fp"))).alias("ap"))


def roc_area(scored: DataFrame, by: list[str]) -> DataFrame:
    return areas(cumulative(scored, by), by).select(*by, "auc")


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    return areas(cumulative(scored, by), by).select(*by, "ap")


def micro(scored: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Every (row, class) as a binary row: a micro curve is the curve of these."""
    return one_against_rest(scored, k, by).drop("class")


def macro_steps(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, fpr, gap, step, tpr): the sum of the classes' curves at each false positive rate of any class, over their number.

    A score with negatives is a line of a class's curve: its slope holds between two rates. One without is a vertical part: a
    jump, whose top counts at its rate. Slopes in force times the gap to the rate before, and jumps, are what the sum rises by.
    """
    own = [*by, "fpr"]
    slope = F.when(F.col("negatives") > 0, or_zero(true_rate("pos"), false_rate("neg"))).otherwise(0.0).cast(SLOPE)
    none, line = F.lit(0.0), F.col("neg") > 0
    events = counts.select(*by, "class", F.explode(F.array(
        F.struct(false_rate("fp").alias("fpr"), F.when(line, none).otherwise(true_rate("pos")).alias("jump"), F.when(line, -slope).otherwise(F.lit(0).cast(SLOPE)).alias("turn")),
        F.struct(or_zero(F.col("fp") - F.col("neg"), F.col("negatives")).alias("fpr"), none.alias("jump"), F.when(line, slope).otherwise(F.lit(0).cast(SLOPE)).alias("turn")),
    )).alias("e")).select(*by, "e.*")
    classes = counts.select(*by, "class").distinct().groupBy(*by).agg(F.count("*").alias("classes"))
    rates = stored(events.groupBy(*own).agg(F.sum("jump").alias("jump"), F.sum("turn").cast(SLOPE).alias("turn")), "rates")
    bounds = cut_points(rates, "fpr")
    turned = running(rates, by, "fpr", bounds, {"slope": F.col("turn")}, before={"last": F.col("fpr")})
    gap = F.coalesce(F.col("fpr") - F.col("last"), none)
    in_force = (F.col("slope") - F.col("turn")).cast("double")
    steps = turned.join(classes, by).select(*own, gap.alias("gap"), ((in_force * gap + F.col("jump")) / F.col("classes")).alias("step"))
    return running(steps, by, "fpr", bounds, {"tpr": F.col("step")})


def macro_roc(scored: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(by, fpr, tpr): the mean over classes of their curves at every false positive rate of any class, between points by line."""
    return macro_steps(cumulative(one_against_rest(scored, k, by), [*by, "class"]), by).select(*by, "fpr", "tpr")


def macro_area(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, auc): trapezoids under the macro curve."""
    return macro_steps(counts, by).groupBy(*by).agg(F.sum(F.col("gap") * (F.col("tpr") - F.col("step") / 2)).alias("auc"))


def precision_recall(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, precision, recall) at each distinct score."""
    c = cumulative(scored, by)
    return c.select(*by, "threshold", or_zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), true_rate("tp").alias("recall"))


def curve_report(scored: DataFrame, k: int, by: list[str]) -> DataFrame:
    """(by, curve, class, value): AUC and AP of each class and micro, macro AUC; class is null for micro and macro."""
    own = [*by, "class"]
    each = cumulative(one_against_rest(scored, k, by), own)

    def said(df: DataFrame, single: bool, **curves: str) -> DataFrame:
        rows = F.explode(F.array(*[F.struct(F.lit(name).alias("curve"), F.col(column).alias("value")) for name, column in curves.items()])).alias("_c")
        return df.select(*by, (F.lit(None).cast("int") if single else F.col("class")).alias("class"), rows).select(*by, "_c.curve", "class", "_c.value")

    return (
        said(areas(each, own), False, roc="auc", pr="ap")
        .unionByName(said(areas(cumulative(micro(scored, k, by), by), by), True, roc_micro="auc", pr_micro="ap"))
        .unionByName(said(macro_area(each, by), True, roc_macro="auc"))
    )

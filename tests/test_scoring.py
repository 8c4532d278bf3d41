import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwarden.operators import curves, scoring

# Worked out by hand: above 0.5 are three of four positives and one of four negatives; 14 of 16 pairs are in order.
Y = [1, 0, 1, 1, 0, 0, 1, 0]
P = [0.95, 0.15, 0.35, 0.85, 0.65, 0.05, 0.75, 0.45]
# Scores with ties between the classes.
TIED = [0.6, 0.6, 0.3, 0.9, 0.3, 0.1, 0.4, 0.6]


def scored(spark, y, p, fold=0):
    kind = "array<double>" if isinstance(p[0], list) else "double"
    return spark.createDataFrame([("m", fold, a, b) for a, b in zip(y, p)], f"model string, fold int, y int, p {kind}")


def test_counts_and_rates(spark):
    r = scoring.bundle(scored(spark, Y, P)).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (3, 1, 3, 1)
    assert [r[m] for m in ("sensitivity", "specificity", "f1", "accuracy", "balanced_accuracy")] == pytest.approx([0.75] * 5)
    assert r["auc"] == pytest.approx(14 / 16)


def test_threshold_is_strict(spark):
    r = scoring.confusion(scored(spark, [1, 0], [0.5, 0.5])).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (0, 0, 1, 1)
    sweep = {r["threshold"]: r for r in scoring.threshold_sweep(scored(spark, [1, 0], [0.5, 0.5])).collect()}
    assert sweep[0.4]["sensitivity"] == 1.0 and sweep[0.5]["sensitivity"] == 0.0 and len(sweep) == 11


def test_auc_edges(spark):
    assert scoring.auc(scored(spark, [0, 1], [0.3, 0.3])).first()["auc"] == 0.5
    assert scoring.auc(scored(spark, [1, 1], [0.3, 0.4])).first()["auc"] is None
    up, down = scored(spark, Y, TIED), None
    down = up.withColumn("p", 1 - F.col("p"))
    assert scoring.auc(up).first()["auc"] + scoring.auc(down).first()["auc"] == pytest.approx(1)


def test_best_threshold(spark):
    r = scoring.best_threshold(scored(spark, Y, P)).first()
    assert r["threshold"] == pytest.approx(0.67) and r["score"] == pytest.approx(0.875)  # three positives and no negative lie above
    none = scoring.best_threshold(scored(spark, [0, 0], [0.98, 0.975]), "f1").first()
    assert none["threshold"] == 0.5 and none["score"] is None
    assert scoring.best_threshold(scored(spark, Y, P), "auc").first()["threshold"] == pytest.approx(0.02)


def test_classes(spark):
    s = scored(spark, [0, 1, 2, 2], [[0.4, 0.4, 0.2], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6], [0.5, 0.3, 0.2]])
    cells = {(r["actual"], r["predicted"]): r["n"] for r in scoring.class_confusion(s, 3).collect()}
    assert len(cells) == 9 and cells[0, 0] == 1 and cells[2, 0] == 1 and cells[2, 2] == 1 and cells[1, 1] == 1
    r = scoring.class_bundle(s, 3).first()
    assert r["accuracy"] == 0.75 and r["sensitivity"] == pytest.approx((1 + 1 + 0.5) / 3)
    missing = scoring.class_bundle(s.filter("y < 2"), 3).first()
    assert missing["auc"] == pytest.approx((0.5 + 2 * 1.0) / 3, abs=0.34)


def test_fold_summary(spark):
    rows = spark.createDataFrame([("m", 0, "auc", 0.8), ("m", 1, "auc", 0.6)], "model string, fold int, metric string, value double")
    r = scoring.fold_summary(rows).first()
    assert r["summary"] == "0.7000 ± 0.1000" and r["std"] == pytest.approx(0.1)


def test_layout(spark):
    cells = {(r["actual"], r["predicted"]): r["n"] for r in scoring.binary_cells(scoring.confusion(scored(spark, Y, P))).collect()}
    assert cells == {(1, 1): 3, (1, 0): 1, (0, 1): 1, (0, 0): 3}


def test_curves(spark):
    s = scored(spark, Y, TIED)
    by = ["model", "fold"]
    assert curves.roc_area(s, by).first()["auc"] == pytest.approx(scoring.auc(s).first()["auc"])
    points = curves.roc(s, by).collect()
    assert (0.0, 0.0) in {(r["fpr"], r["tpr"]) for r in points} and (1.0, 1.0) in {(r["fpr"], r["tpr"]) for r in points}
    assert curves.average_precision(scored(spark, [1, 0], [0.9, 0.1]), by).first()["ap"] == 1.0
    two = s.withColumn("p", F.array(1 - F.col("p"), F.col("p")))
    # By the definition: the curves' means at every rate, np.interp between a curve's points.
    one = scoring.one_against_rest(two, 2, by)
    lines = {c: sorted((r["fpr"], r["tpr"]) for r in curves.roc(one.filter(F.col("class") == c), by).collect()) for c in (0, 1)}
    grid = sorted({x for line in lines.values() for x, _ in line})
    mean = np.mean([np.interp(grid, *zip(*line)) for line in lines.values()], axis=0)
    macro = {r["fpr"]: r["tpr"] for r in curves.macro_roc(two, 2, by).collect()}
    assert sorted(macro) == grid and [macro[x] for x in grid] == pytest.approx(list(mean))
    found = curves.macro_area(curves.cumulative(one, [*by, "class"]), by).first()["auc"]
    assert found == pytest.approx(np.trapezoid(mean, grid))


@pytest.mark.parametrize("small", [None, 40])
@pytest.mark.parametrize("down", [False, True])
def test_running_sums_equal_plain_windows(spark, small, down):
    """In one level, and over ranges that follow the numbers; nulls and NaN have their places, a group may be null."""
    from pyspark.sql import Window

    from tabwarden.functions.ranges import cut_points, running

    df = spark.range(800).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 801 / 800 - 0.0).alias("p"), (F.col("id") % 11).alias("n")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    df = df.withColumn("p", F.when(F.col("p") == 0.5, float("nan")).when(F.col("p") != 0.25, F.col("p")))
    bounds = cut_points(df, "p", small)
    assert bool(bounds) == bool(small)
    up = Window.partitionBy("g").orderBy(F.col("p").desc() if down else F.col("p"))
    got = running(df, ["g"], "p", bounds, {"s": F.col("n")}, {"all": "s"}, {"last": F.col("n")}, down)
    plain = got.select(
        "*", F.sum("n").over(up).alias("s0"), F.sum("n").over(Window.partitionBy("g")).alias("all0"), F.max("n").over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("last0"),
    )
    assert plain.count() == 800 and plain.filter("not (s <=> s0 and all <=> all0 and last <=> last0)").count() == 0


def test_ranges_follow_the_data(spark, monkeypatch):
    """Scores within a hundredth of each other, and texts that begin alike, are dealt evenly: no range has twice the rows of the median one."""
    from tabwarden.functions import ranges

    df = spark.range(60_000).select((0.5 + F.col("id") / 6e6).alias("p"), F.concat(F.lit("a common beginning of all "), F.md5(F.col("id").cast("string"))).alias("t"))
    bounds = ranges.cut_points(df, "p", 1000)
    sizes = sorted(r["count"] for r in ranges.cut_at(df, "p", bounds, "cut").groupBy("cut").count().collect())
    assert len(sizes) >= 50 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    kept = []
    monkeypatch.setattr(ranges, "stored", lambda d, what, own=ranges.stored: kept.append(own(d, what)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ranges.rank_in_order(df, [], [F.col("t")], "r")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["count"] for r in kept[0].groupBy(F.shiftright("_at", ranges.PLACE_BITS)).count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[1]
    assert ranked.agg(F.count_distinct("r"), F.min("r"), F.max("r")).first()[:] == (60_000, 1, 60_000)
    assert ranked.alias("a").join(ranked.alias("b"), F.col("b.r") == F.col("a.r") + 1).filter("a.t >= b.t").count() == 0


def test_empty(spark):
    none = scored(spark, Y, P).filter("y = 9")
    assert scoring.bundle(none).count() == 0 and scoring.best_threshold(none).count() == 0

"""Attributions of tree models by their leaves, exact for any number of features.

A tree is a table of its leaves: a value for each class, and for each feature on the leaf's path the interval that leads there. Between
a row and a background row a leaf counts for the row's features in A (the row is in their intervals, the background row is not) and
against those in B (the other way round); it is out of reach if a feature has neither inside. The Shapley value of that game is closed:
v (|A|-1)! |B|! / (|A|+|B|)! for each feature of A, and -v |A|! (|B|-1)! / (|A|+|B|)! for each of B. Rows with the same bits inside and outside of a leaf's intervals
are one case, so the work is leaves by distinct cases, not rows by background rows.
"""

from __future__ import annotations

from math import comb

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import named

#: Rows of a background, and features on one path: as deep as trees of `pyspark.ml` can be.
BACKGROUND, MOST_ON_A_PATH = 100, 30

LEAVES = "leaf int, conds array<struct<feature: int, low: double, high: double>>, worth array<double>"

#: A node: (feature, threshold, below or at it, above it), or a leaf: a list of a value for each class.
Node = tuple | list


def leaves_of(trees: list[Node]) -> list[tuple]:
    """Rows of a leaf table; a feature that a path asks several times has one interval. ValueError for longer paths than MOST_ON_A_PATH features."""
    out: list[tuple] = []

    def walk(node: Node, path: dict[int, tuple[float | None, float | None]]) -> None:
        if isinstance(node, list):
            if len(path) > MOST_ON_A_PATH:
                raise ValueError(f"a path asks for more than {MOST_ON_A_PATH} features")
            out.append((len(out), [(f, low, high) for f, (low, high) in sorted(path.items())], [float(v) for v in node]))
            return
        feature, at, below, above = node
        low, high = path.get(feature, (None, None))
        walk(below, {**path, feature: (low, at if high is None else min(high, at))})
        walk(above, {**path, feature: (at if low is None else max(low, at), high)})

    for tree in trees:
        walk(tree, {})
    return out


def leaf_table(spark: SparkSession, trees: list[Node]) -> DataFrame:
    return spark.createDataFrame(leaves_of(trees), LEAVES)


def trees_of(model: Transformer) -> list[Node]:
    """The trees of a fitted tree, forest or boosted model of `pyspark.ml`, leaves worth what they add to the class scores: probabilities, or for a boosted one the margin of class 1."""
    boosted = model.hasParam("lossType")
    single = not hasattr(model, "trees")
    parts, weights = ([model], [1.0]) if single else (model.trees, model.treeWeights)
    total = 1.0 if boosted else sum(weights)

    def node(java, weight: float) -> Node:
        if java.getClass().getSimpleName() == "LeafNode":
            if boosted:
                return [weight * java.prediction()]
            stats = list(java.impurityStats().stats())
            return [weight * x / (sum(stats) or 1.0) for x in stats]
        split = java.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise ValueError("splits by sets of categories are not explained")
        return (split.featureIndex(), split.threshold(), node(java.leftChild(), weight), node(java.rightChild(), weight))

    return [node(t._java_obj.rootNode(), w / total) for t, w in zip(parts, weights)]


def mask(x: str) -> Column:
    """Bit i is set where the features are inside the leaf's i-th interval; NaN is above all numbers."""
    value = lambda c: F.get(F.col(x), c["feature"])
    inside = lambda c: (c["low"].isNull() | (value(c) > c["low"])) & (c["high"].isNull() | ~(value(c) > c["high"]))
    bits = F.transform("conds", lambda c, i: F.when(inside(c), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def tree_shap(df: DataFrame, key: str, features: list[str], leaves: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """(id, class, feature, value, shap): interventional Shapley values of a sum of trees, exact, for any number of features and rows.

    leaves: from leaf_table(), features by their place in `features`. The background (df itself, if not given) has at most BACKGROUND rows,
    else ValueError; without any there are no values. Values of a row add up to its score less the background's mean. Null features are in no interval with an end.
    """
    vector = F.array(*[named(f).cast("double") for f in features])
    base = (df if background is None else background).select(vector.alias("x"))
    n = base.limit(BACKGROUND + 1).count()
    if n > BACKGROUND:
        raise ValueError(f"a background has at most {BACKGROUND} rows")
    rows = df.select(named(key).alias("id"), vector.alias("x"))
    # Leaves are as many as the model has, whatever the data: each row meets all of them.
    small = F.broadcast(leaves)
    seen = rows.join(small).select("id", "leaf", mask("x").alias("mine"))
    theirs = base.join(small).select("leaf", mask("x").alias("theirs")).groupBy("leaf", "theirs").agg(F.count("*").alias("n"))
    cases = seen.select("leaf", "mine").distinct().join(theirs, "leaf").join(F.broadcast(leaves), "leaf")
    a, b = F.col("mine").bitwiseAND(F.bitwise_not("theirs")), F.col("theirs").bitwiseAND(F.bitwise_not("mine"))
    size = F.size("conds")
    reached = F.bit_count(F.col("mine").bitwiseOR(F.col("theirs"))) == size
    most = MOST_ON_A_PATH + 1
    # 1 / (i C(i + j, i)): what each of i features gets that are for, where j are against.
    part = F.array(*[F.lit(1.0 / (i * comb(i + j, i)) if i else 0.0) for i in range(most) for j in range(most)])
    for_, against = F.bit_count(a).cast("int"), F.bit_count(b).cast("int")
    gain, loss = F.get(part, for_ * most + against), -F.get(part, against * most + for_)
    has = lambda m, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1
    told = cases.filter(reached).select("leaf", "mine", "n", "conds", a.alias("_a"), b.alias("_b"), gain.alias("_gain"), loss.alias("_loss"))
    each = told.select("leaf", "mine", "n", "_a", "_b", "_gain", "_loss", F.posexplode("conds").alias("i", "cond"))
    weight = F.when(has(F.col("_a"), F.col("i")), F.col("_gain")).when(has(F.col("_b"), F.col("i")), F.col("_loss"))
    shares = each.select("leaf", "mine", F.col("cond.feature").alias("f"), (F.col("n") * weight / n).alias("w")).filter("w is not null").groupBy("leaf", "mine", "f").agg(F.sum("w").alias("w"))
    parts = seen.join(shares, ["leaf", "mine"]).join(F.broadcast(leaves.select("leaf", "worth")), "leaf")
    sums = parts.select("id", "f", F.posexplode(F.transform("worth", lambda v: v * F.col("w"))).alias("class", "s")).groupBy("id", "class", "f").agg(F.sum("s").alias("s"))
    classes = leaves.agg(F.max(F.size("worth")).alias("k"))
    grid = rows.join(F.broadcast(classes)).select("id", "x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("class")).select("id", "class", F.posexplode("x").alias("f", "value"))
    named_ = F.get(F.array(*map(F.lit, features)), F.col("f")).alias("feature")
    return grid.join(sums, ["id", "class", "f"], "left").filter(F.lit(n > 0)).select("id", "class", named_, "value", F.coalesce("s", F.lit(0.0)).alias("shap"))

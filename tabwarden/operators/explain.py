"""Feature attributions: closed form for linear models, Shapley values for any model, exact over few features and sampled over many, and reports."""

from __future__ import annotations

from math import comb, factorial

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import named
from .boosting import Boosted
from .trees import leaf_table, tree_shap, trees_of

#: Rows that are explained and rows of the background, by kind of explainer; features that exact values allow.
TREE_ROWS, KERNEL_ROWS, MOST_FEATURES = 100, 14, 12
#: Orders of the features that sampled values are averaged over, by pairs of an order and its reverse.
ORDERS = 64
#: Coalitions of a kernel regression, and groups of drawn ones.
COALITIONS, GROUPS = 2048, 8
TOP = 10


def explainer(model_name: str) -> str:
    """Which explainer a model of the registry gets."""
    return {"Random Forest": "tree", "XGBoost": "tree", "Decision Tree": "tree", "Logistic Regression": "linear"}.get(model_name, "kernel")


def linear_shap(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(id, feature, value, shap): w (x - mean), on the scale of the log odds; the background is the explained rows."""
    means = df.agg(*[F.avg(named(f).cast("double")).alias(f"_m {f}") for f in weights])
    wide = df.join(F.broadcast(means))  # a single row
    return wide.select(named(key).alias("id"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), named(f).cast("double").alias("value"), (F.lit(float(w)) * (named(f) - named(f"_m {f}"))).alias("shap")) for f, w in weights.items()
    ])).alias("x")).select("id", "x.*")


def exact_shapley(df: DataFrame, key: str, features: list[str], predict, background: DataFrame | None = None) -> DataFrame:
    """(id, class, feature, value, shap): interventional Shapley values of any model, by all coalitions of the features.

    df and background are samples of at most TREE_ROWS rows (see stratified_sample), else ValueError; predict takes a DataFrame with a vector column
    `features` and adds an array `p` of class scores. Each (row, background row, coalition) is a row that the model scores, so
    the work is spread over the cluster; at most MOST_FEATURES features, else ValueError (see sampled_shapley).
    """
    d = len(features)
    if d > MOST_FEATURES:
        raise ValueError(f"exact values take at most {MOST_FEATURES} features")
    rows = df.select(named(key).alias("id"), F.array(*[named(f).cast("double") for f in features]).alias("x"))
    base = bounded_rows(df if background is None else background, features)
    others = df.sparkSession.createDataFrame([([float(v) for v in b],) for b in base], "b array<double>")
    mixed = rows.join(F.broadcast(others)).select("id", "x", "b", F.explode(F.sequence(F.lit(0), F.lit(2**d - 1))).alias("s"))
    hybrid = mixed.select("id", "x", "s", array_to_vector(F.transform("x", lambda v, i: F.when(F.get(binary("s", d), i) == 1, v).otherwise(F.get("b", i)))).alias("features"))
    worth = predict(hybrid).select("id", "x", "s", F.posexplode("p").alias("class", "p")).groupBy("id", "x", "class", "s").agg(F.avg("p").alias("v"))
    # A coalition's worth counts for its members with one sign and for the others with the other.
    inside = F.array(*[F.lit(factorial(max(m - 1, 0)) * factorial(d - m) / factorial(d) if m else 0.0) for m in range(d + 1)])
    outside = F.array(*[F.lit(factorial(m) * factorial(d - m - 1) / factorial(d) if m < d else 0.0) for m in range(d + 1)])
    m = F.bit_count("s")
    sign = lambda i: F.when(F.get(binary("s", d), F.lit(i)) == 1, F.get(inside, m)).otherwise(-F.get(outside, m))
    parts = worth.groupBy("id", "x", "class").agg(*[F.sum(F.col("v") * sign(i)).alias(f"_{i}") for i in range(d)])
    return parts.select("id", "class", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.get("x", F.lit(i)).alias("value"), F.col(f"_{i}").alias("shap")) for i, f in enumerate(features)
    ])).alias("e")).select("id", "class", "e.*")


def bounded_rows(df: DataFrame, features: list[str]) -> list[list[float]]:
    """The rows' features, sorted; ValueError beyond TREE_ROWS rows."""
    found = [list(r) for r in df.select(*[named(f).cast("double") for f in features]).limit(TREE_ROWS + 1).collect()]
    if len(found) > TREE_ROWS:
        raise ValueError(f"a background has at most {TREE_ROWS} rows")
    return sorted(found, key=str)


def sampled_shapley(df: DataFrame, key: str, features: list[str], predict, background: DataFrame | None = None, orders: int = ORDERS) -> DataFrame:
    """(id, class, feature, value, shap, error): interventional Shapley values by drawn orders of the features, for any number of them.

    In each order features go from a background row's values to the row's own, one by one; a feature's value is the mean change that
    it brings, and `error` the standard error of that mean. Orders come in pairs, one the reverse of the other, with a background row
    for each pair, all by a fixed seed. For each row the values add up to its score less the mean score of the background rows drawn.
    """
    d = len(features)
    base, draw = bounded_rows(df if background is None else background, features), np.random.default_rng(11)
    drawn = []
    for pair in range(orders // 2 if base else 0):
        rank = draw.permutation(d)
        drawn += [(2 * pair + turn, (rank if turn == 0 else d - 1 - rank).tolist(), [float(v) for v in base[pair % len(base)]]) for turn in (0, 1)]
    plans = df.sparkSession.createDataFrame(drawn, "j int, rank array<int>, b array<double>")
    rows = df.select(named(key).alias("id"), F.array(*[named(f).cast("double") for f in features]).alias("x"))
    steps = rows.join(F.broadcast(plans)).select("id", "x", "j", "rank", "b", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("t"))
    hybrid = steps.select("id", "x", "j", "rank", "t", array_to_vector(F.transform("x", lambda v, i: F.when(F.get("rank", i) < F.col("t"), v).otherwise(F.get("b", i)))).alias("features"))
    worth = predict(hybrid).select("id", "x", "j", "rank", "t", F.posexplode("p").alias("class", "p"))
    along = worth.groupBy("id", "x", "class", "j", "rank").agg(F.sort_array(F.collect_list(F.struct("t", "p"))).alias("w"))  # d + 1 entries
    change = F.transform("rank", lambda r, i: F.struct(i.alias("i"), (F.get(F.col("w.p"), r + 1) - F.get(F.col("w.p"), r)).alias("c")))
    told = along.select("id", "x", "class", "j", F.explode(change).alias("e"))
    pairs = told.groupBy("id", "x", "class", "e.i", F.floor(F.col("j") / 2).alias("pair")).agg(F.avg("e.c").alias("c"))
    means = pairs.groupBy("id", "x", "class", "i").agg(F.avg("c").alias("shap"), (F.stddev_samp("c") / F.sqrt(F.count("*"))).alias("error"))
    return means.select("id", "class", F.get(F.array(*map(F.lit, features)), F.col("i")).alias("feature"), F.get("x", F.col("i")).alias("value"), "shap", "error")


def drawn_coalitions(d: int, most: int) -> tuple[list[int], list[float], list[int]]:
    """(coalitions as bits, weights, groups): all but the empty and the whole one by their kernel weight, one group, if they are at most `most`; else drawn.

    Drawn ones: first a size in proportion to the kernel weight of all coalitions of that size, then a coalition of it, and its complement beside it,
    each of weight 1, dealt to GROUPS groups in turn.
    """
    if d <= 1:
        return [], [], []
    if 2**d - 2 <= most:
        sizes = [s.bit_count() for s in range(1, 2**d - 1)]
        return list(range(1, 2**d - 1)), [(d - 1) / (comb(d, m) * m * (d - m)) for m in sizes], [0] * (2**d - 2)
    draw, weight = np.random.default_rng(17), np.array([(d - 1) / (m * (d - m)) for m in range(1, d)])
    chosen, groups = [], []
    for pair in range(most // 2):
        inside = draw.permutation(d)[: draw.choice(np.arange(1, d), p=weight / weight.sum())]
        s = sum(1 << int(i) for i in inside)
        chosen += [s, 2**d - 1 - s]
        groups += [pair % GROUPS] * 2
    return chosen, [1.0] * len(chosen), groups


def solver(d: int, coalitions: list[int], weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(M, c): the least squares over the coalitions, with values that add up to the change from nothing to all, are M b + c (that change), b being the weighted
    sum of each coalition's change over its members. The normal equations are the same for all rows: d x d."""
    z = np.array([[s >> i & 1 for i in range(d)] for s in coalitions], np.float64).reshape(-1, d)
    inverse = np.linalg.pinv(z.T @ (np.array(weights)[:, None] * z))
    one = inverse.sum(axis=1)
    return inverse - np.outer(one, one) / one.sum(), one / one.sum()


def kernel_shapley(df: DataFrame, key: str, features: list[str], predict, background: DataFrame | None = None, coalitions: int = COALITIONS) -> DataFrame:
    """(id, class, feature, value, shap, error): interventional Shapley values of any model by kernel regression, for any number of features up to 60.

    The model scores each row with the features of each coalition, the others from each background row; the weighted sums of the changes are
    added up by row and class in Spark, and the values follow by one small matrix. With all coalitions they are exact and `error` is 0; else coalitions are
    drawn by a fixed seed, and `error` is the standard error over GROUPS groups of them. Values add up to the row's score less the background's mean. df and
    background as in exact_shapley().
    """
    d, spark = len(features), df.sparkSession
    if d > 60:
        raise ValueError("coalitions are the bits of a long: at most 60 features")
    base = bounded_rows(df if background is None else background, features)
    chosen, weights, groups = drawn_coalitions(d, coalitions)
    n_groups = max(groups, default=0) + 1
    others = spark.createDataFrame([([float(v) for v in b],) for b in base], "b array<double>")
    plans = spark.createDataFrame([(0, 0.0, -1), (2**d - 1, 0.0, -1), *zip(chosen, weights, groups)], "s long, w double, g int")
    rows = df.select(named(key).alias("id"), F.array(*[named(f).cast("double") for f in features]).alias("x"))
    # Both are bounded: BACKGROUND rows and `coalitions`.
    mixed = rows.join(F.broadcast(others)).join(F.broadcast(plans))
    bit = lambda s, i: F.call_function("shiftright", s, i).bitwiseAND(F.lit(1)) == 1
    hybrid = mixed.select("id", "x", "s", "w", "g", array_to_vector(F.transform("x", lambda v, i: F.when(bit(F.col("s"), i), v).otherwise(F.get("b", i)))).alias("features"))
    worth = predict(hybrid).select("id", "x", "s", "w", "g", F.posexplode("p").alias("class", "p")).groupBy("id", "x", "s", "w", "g", "class").agg(F.avg("p").alias("v"))
    ends = [F.max(F.when((F.col("g") == -1) & (F.col("s") == s), F.col("v"))).alias(n) for n, s in (("_none", 0), ("_all", 2**d - 1))]
    # A coalition's change is its worth less that of nothing; the latter's part is added when both are known.
    part = lambda g, i: F.sum(F.when((F.col("g") == g) & bit(F.col("s"), F.lit(i)), F.col("w") * F.col("v")).otherwise(0.0)).alias(f"_{g}_{i}")
    sums = worth.groupBy("id", "x", "class").agg(*ends, *[part(g, i) for g in range(n_groups) for i in range(d)])
    estimates = []
    for g in range(n_groups):
        mine = [(s, w) for s, w, own in zip(chosen, weights, groups) if own == g]
        m, c = solver(d, [s for s, _ in mine], [w for _, w in mine]) if mine else (np.zeros((d, d)), np.ones(d))
        total = [sum(w for s, w in mine if s >> i & 1) for i in range(d)]
        change = F.array(*[F.col(f"_{g}_{i}") - F.col("_none") * total[i] for i in range(d)])
        dot = lambda r: F.aggregate(F.zip_with(F.array(*map(F.lit, map(float, r))), F.col(f"_b{g}"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        sums = sums.withColumn(f"_b{g}", change)
        estimates.append(F.array(*[dot(r) + (F.col("_all") - F.col("_none")) * float(c[i]) for i, r in enumerate(m)]))
    found = sums.select("id", "x", "class", F.posexplode(F.arrays_zip(*[e.alias(f"e{g}") for g, e in enumerate(estimates)])).alias("i", "e"))
    each = F.array(*[F.col(f"e.e{g}") for g in range(n_groups)])
    mean = F.aggregate(each, F.lit(0.0), lambda a, v: a + v) / n_groups
    spread = F.aggregate(each, F.lit(0.0), lambda a, v: a + (v - F.col("shap")) * (v - F.col("shap")))
    told = found.withColumn("shap", mean).withColumn("error", F.sqrt(spread / (n_groups * (n_groups - 1))) if n_groups > 1 else F.lit(0.0))
    return told.select("id", "class", F.get(F.array(*map(F.lit, features)), F.col("i")).alias("feature"), F.get("x", F.col("i")).alias("value"), "shap", "error")


def explained(df: DataFrame, key: str, features: list[str], predict, background: DataFrame | None = None) -> DataFrame:
    """(id, class, feature, value, shap, error): by kernel regression, exact with error 0 while the features have at most COALITIONS coalitions."""
    return kernel_shapley(df, key, features, predict, background)


def of_trees(models: list, df: DataFrame, key: str, features: list[str], background: DataFrame | None = None) -> DataFrame:
    """(id, class, feature, value, shap, error): exact values of fitted tree models by their leaves, for any number of features.

    A tree or forest is explained in class probabilities, boosted trees in margins: of class 1 where there are two classes, else of each.
    """
    forests: list[tuple[int | None, list]] = []
    for c, model in enumerate(models):
        if isinstance(model, Boosted):
            forests += [(1 if model.k == 2 else o, [r[o].nodes() for r in model.trees]) for o in range(1 if model.k == 2 else model.k)]
        else:
            forests.append(((c if len(models) > 1 else 1) if model.hasParam("lossType") else None, trees_of(model)))
    found = None
    for label, trees in forests:
        part = tree_shap(df, key, features, leaf_table(df.sparkSession, trees), background)
        part = part if label is None else part.withColumn("class", F.lit(label))
        found = part if found is None else found.unionByName(part)
    return found.withColumn("error", F.lit(0.0))


def binary(column: str, d: int) -> Column:
    """The bits of a number, lowest first, as an array."""
    return F.array(*[F.shiftright(F.col(column), i).bitwiseAND(F.lit(1)) for i in range(d)])


def probability(model, column: str = "probability"):
    """A predict function for exact_shapley from a fitted classifier."""
    return lambda df: model.transform(df).withColumn("p", vector_to_array(column))


def telling_class(shap: DataFrame) -> DataFrame:
    """(class, mean): the class with the greatest mean absolute value, the first of equal ones."""
    per = shap.groupBy("class").agg(F.avg(F.abs("shap")).alias("mean"))
    best = per.agg(F.max(F.struct(F.round("mean", 12).alias("r"), (-F.col("class")).alias("c"), "mean")).alias("x"))
    return best.select((-F.col("x.c")).alias("class"), F.col("x.mean").alias("mean"))


def importance(shap: DataFrame, top: int = TOP) -> DataFrame:
    """(feature, importance): mean absolute values over rows and classes, the `top` greatest, ties by name."""
    return shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("importance")).orderBy(F.round("importance", 12).desc(), "feature").limit(top)


def class_importance(shap: DataFrame, top: int = TOP) -> DataFrame:
    """(feature, class, importance) of the features that are most important overall."""
    chosen = importance(shap, top).select("feature")
    return shap.join(chosen, "feature", "left_semi").groupBy("feature", "class").agg(F.avg(F.abs("shap")).alias("importance"))


def beeswarm(shap: DataFrame, top: int = TOP) -> DataFrame:
    """(id, feature, value, shap) of the most important features, and the sum of the rest under `(rest)`: data of a plot."""
    chosen = importance(shap, top).select("feature", F.lit(True).alias("_top"))
    marked = shap.join(chosen, "feature", "left")
    named = marked.filter("_top").select("id", "feature", "value", "shap")
    rest = marked.filter("_top is null").groupBy("id").agg(F.sum("shap").alias("shap"))
    return named.unionByName(rest.select("id", F.lit("(rest)").alias("feature"), F.lit(None).cast("double").alias("value"), "shap"))

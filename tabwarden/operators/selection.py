"""Feature selection and preprocessing: correlations, mutual information, importances, scaling, one-hot columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import named, quoted, ratio
from ..functions.store import stored
from .boosting import fit_boosted

#: Least importance of a selected feature, features that recursive elimination keeps, weight of the lasso, limit of correlation.
IMPORTANCE, KEEP, LASSO, LIMIT = 0.01, 5, 0.001, 0.7
#: Equal-width bins of a feature for its mutual information with the target; categories that one-hot columns may have.
BINS, MOST_CATEGORIES = 10, 1000
#: Shrinking sets of features, and rounds and depth of the boosted trees over each.
SHRINKS, SHRINK_ROUNDS, SHRINK_DEPTH = 5, 4, 3


def long_pairs(one: DataFrame, features: list[str], name: str) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), named(f"{a}|{b}").alias(name)) for i, a in enumerate(features) for b in features[i + 1 :]
    ])).alias("x")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(f1, f2, r) of each pair in the order of `features`, one pass; null where a feature is constant."""
    x = {f: named(f).cast("double") for f in features}
    one = df.agg(*[
        ratio(F.covar_pop(x[a], x[b]), F.stddev_pop(x[a]) * F.stddev_pop(x[b])).alias(f"{a}|{b}") for i, a in enumerate(features) for b in features[i + 1 :]
    ])
    return one.select(long_pairs(one, features, "r")).select("x.*")


def binned_information(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, mi): mutual information in nats of each feature's equal-width bin and the target. Two passes of aggregates."""
    ends = df.agg(*[f(named(c).cast("double")).alias(f"{n} {c}") for c in features for n, f in (("low", F.min), ("high", F.max))])
    spread = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), named(f"low {c}").alias("low"), named(f"high {c}").alias("high")) for c in features])).alias("e")
    bounds = ends.select(spread).select("e.*")
    rows = df.select(named(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), named(c).cast("double").alias("x")) for c in features])).alias("v"))
    place = F.least(F.floor(F.coalesce(ratio((F.col("v.x") - F.col("low")) * BINS, F.col("high") - F.col("low")), F.lit(0.0))), F.lit(BINS - 1))
    binned = rows.join(F.broadcast(bounds), F.col("v.feature") == F.col("feature")).select("feature", place.alias("b"), "y")  # one row per feature
    cells = binned.groupBy("feature", "b", "y").agg(F.count("*").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by)).cast("double")
    part = F.col("n") / total() * F.ln(F.col("n") * total() / (total("b") * total("y")))
    return cells.select("feature", part.alias("part")).groupBy("feature").agg(F.sum("part").alias("mi"))


def sulov(df: DataFrame, features: list[str], target: str, limit: float = LIMIT) -> DataFrame:
    """(feature, mi, kept): of two features correlated beyond the limit the one with less information goes; ties by name."""
    mi = binned_information(df, features, target)
    far = correlations(df, features).filter(F.abs("r") > limit)
    pairs = far.select(F.col("f1").alias("feature"), F.col("f2").alias("other")).union(far.select("f2", "f1"))
    other = mi.select(F.col("feature").alias("other"), F.round("mi", 9).alias("m2"))
    lost = pairs.join(mi, "feature").join(other, "other").filter(
        (F.round("mi", 9) < F.col("m2")) | ((F.round("mi", 9) == F.col("m2")) & (F.col("feature") > F.col("other")))
    ).select("feature").distinct().withColumn("_lost", F.lit(True))
    return mi.join(lost, "feature", "left").select("feature", "mi", F.col("_lost").isNull().alias("kept"))


def assembled(df: DataFrame, features: list[str], target: str) -> DataFrame:
    places = [f"_{i}" for i in range(len(features))]
    rows = df.select(named(target).cast("double").alias("label"), *[named(f).cast("double").alias(p) for f, p in zip(features, places)])
    return VectorAssembler(inputCols=places, outputCol="features").transform(rows)


def forest_importances(df: DataFrame, features: list[str], target: str) -> dict[str, float]:
    from pyspark.ml.classification import RandomForestClassifier

    model = RandomForestClassifier(seed=42).fit(assembled(df, features, target))
    return dict(zip(features, model.featureImportances.toArray().tolist()))


def boosted_importances(df: DataFrame, features: list[str], target: str) -> dict[str, float]:
    """Of gradient-boosted trees; for more than two classes the mean over classes against the rest."""
    from pyspark.ml.classification import GBTClassifier

    rows = assembled(df, features, target).cache()
    try:
        classes = sorted(r["label"] for r in rows.select("label").distinct().collect())
        sums = dict.fromkeys(features, 0.0)
        aims = classes[1:] if len(classes) == 2 else classes
        for c in aims:
            model = GBTClassifier(seed=42, maxIter=10).fit(rows.withColumn("label", (F.col("label") == c).cast("double")))
            for f, x in zip(features, model.featureImportances.toArray().tolist()):
                sums[f] += x / len(aims)
        return sums
    finally:
        rows.unpersist()


def forest_selection(df: DataFrame, features: list[str], target: str) -> list[str]:
    return [f for f, x in forest_importances(df, features, target).items() if x > IMPORTANCE]


def boosted_selection(df: DataFrame, features: list[str], target: str) -> list[str]:
    return [f for f, x in boosted_importances(df, features, target).items() if x > IMPORTANCE]


def lasso_selection(df: DataFrame, features: list[str], target: str) -> list[str]:
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False).fit(assembled(df, features, target))
    return [f for f, w in zip(features, model.coefficients.toArray()) if w != 0]


def recursive_selection(df: DataFrame, features: list[str], target: str, keep: int = KEEP) -> list[str]:
    """Logistic regression again and again, each time without the feature of the least absolute weight."""
    from pyspark.ml.classification import LogisticRegression

    left = list(features)
    while len(left) > keep:
        model = LogisticRegression(standardization=False, maxIter=50).fit(assembled(df, left, target))
        weight = abs(model.coefficientMatrix.toArray()).sum(axis=0)
        left.pop(int(weight.argmin()))
    return left


def shrinking_selection(df: DataFrame, features: list[str], target: str) -> list[str]:
    """Boosted trees over all features, then without the first fifth, the first two fifths and so on: whatever one of them gains by, in the order given.

    So a feature that a stronger one hides is found once that one is gone.
    """
    rows = df.select(named(target).alias("_t"), *map(named, features))
    classes = sorted(r[0] for r in rows.select("_t").distinct().collect())
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("_t")) - 1
    coded = stored(rows.withColumn("_t", place.cast("double")), "selection")
    found: set[str] = set()
    step = max(1, -(-len(features) // SHRINKS))
    for at in range(0, len(features), step):
        left = features[at:]
        gains = fit_boosted(assembled(coded, left, "_t"), max(2, len(classes)), len(left), rounds=SHRINK_ROUNDS, depth=SHRINK_DEPTH, step=0.3).gains
        total = sum(gains.values())
        found |= {left[i] for i, gain in gains.items() if gain > IMPORTANCE * total}
    return [f for f in features if f in found]


def correlation_selection(df: DataFrame, features: list[str], target: str, limit: float = LIMIT) -> list[str]:
    """SULOV, then of what it keeps, the most telling first, all that boosted trees over shrinking sets gain by."""
    told = {r["feature"]: r["mi"] for r in sulov(df, features, target, limit).filter("kept").select("feature", "mi").collect()}
    order = sorted((f for f in features if f in told), key=lambda f: (-round(told[f], 9), f))
    chosen = set(shrinking_selection(df, order, target)) or set(order)
    return [f for f in features if f in chosen]


SELECTORS: dict[str, Callable[..., list[str]]] = {
    "featurewiz": correlation_selection, "rfe": recursive_selection, "lasso": lasso_selection, "rf": forest_selection, "xgboost": boosted_selection,
}


def select_features(df: DataFrame, features: list[str], target: str, method: str = "featurewiz", **options) -> list[str]:
    """Names of the selected features, by one of SELECTORS; ValueError where none is left."""
    if method not in SELECTORS:
        raise ValueError(f"no selector {method}: one of {', '.join(SELECTORS)}")
    found = SELECTORS[method](df, features, target, **options)
    if not found:
        raise ValueError(f"{method} leaves no feature")
    return found


def z_scores(df: DataFrame, features: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """df with its features as z-scores by the population's standard deviation over `fitted_on` (df itself); constants become 0."""
    base = df if fitted_on is None else fitted_on
    stats = base.agg(*[f(named(c).cast("double")).alias(f"_{n} {c}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    wide = df.join(F.broadcast(stats))  # a single row
    mean, std = (lambda c: named(f"_mean {c}")), (lambda c: named(f"_std {c}"))
    scaled = {c: F.when(std(c) > 0, (named(c) - mean(c)) / std(c)).otherwise(F.when(named(c).isNotNull(), 0.0)) for c in features}
    return wide.select(*[scaled[c].alias(c) if c in scaled else named(c) for c in df.columns])


def categories(df: DataFrame, column: str, most: int = MOST_CATEGORIES) -> list[str]:
    """Sorted distinct values; ValueError beyond `most`, so what the driver holds is bounded."""
    found = [r[0] for r in df.select(named(column).cast("string").alias("v")).filter("v is not null").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"column {column} has more than {most} categories")
    return sorted(found)


def one_hot(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """df with a 0/1 column `column=value` per known value instead of the column; a value that is not known fails the query."""
    return df.select(*[named(c) for c in df.columns if c != column], *[F.expr(flag(column, v, known)).cast("int").alias(f"{column}={v}") for v in known])


def said(text: str) -> str:
    """A SQL string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def flag(column: str, v: str, known: list[str]) -> str:
    """SQL: 1 where the column has this value, 0 for another known one; any other value fails the query."""
    c = quoted(column)
    others = ", ".join(map(said, known))
    return f"CASE WHEN {c} = {said(v)} THEN 1 WHEN {c} IN ({others}) THEN 0 ELSE CAST(raise_error(concat({said(f'unknown category in {column}: ')}, coalesce({c}, 'null'))) AS INT) END"


def routed(df: DataFrame, skip: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, text) columns; what is neither is left out."""
    fields = [f for f in df.schema.fields if f.name not in skip]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return numeric, [f.name for f in fields if isinstance(f.dataType, T.StringType)]


def preparation(train: DataFrame, skip: list[str]) -> dict[str, str]:
    """Feature -> the SQL that makes it from a raw row, as a double: z-scores and 0/1 columns by the train table. One pass for all numbers."""
    numeric, text = routed(train, skip)
    out: dict[str, str] = {}
    stats = train.agg(F.count("*"), *[f(named(c).cast("double")) for c in numeric for f in (F.avg, F.stddev_pop)]).first()[1:]
    for i, c in enumerate(numeric):
        mean, std = stats[2 * i], stats[2 * i + 1]
        plain = std is None or not std > 0
        out[c] = f"CASE WHEN {quoted(c)} IS NOT NULL THEN 0.0D END" if plain else f"(CAST({quoted(c)} AS DOUBLE) - ({mean!r}D)) / {std!r}D"
    for c in text:
        known = categories(train, c)
        out |= {f"{c}={v}": f"CAST({flag(c, v, known)} AS DOUBLE)" for v in known}
    return out


def preprocess(train: DataFrame, other: DataFrame, skip: list[str]) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Both tables scaled and one-hot encoded by the train table, and the features with the SQL of each."""
    made = preparation(train, skip)
    ready = [df.select(*[named(c) for c in train.columns if c in skip and c in df.columns], *[F.expr(e).alias(n) for n, e in made.items()]) for df in (train, other)]
    return ready[0], ready[1], made


def positive_weight(df: DataFrame, target: str) -> DataFrame:
    """(weight): rows of class 0 over rows of class 1; 1 if there are not just two classes."""
    one = df.agg(F.count_if(F.col(target) == 0).alias("n0"), F.count_if(F.col(target) == 1).alias("n1"), F.count_distinct(target).alias("k"))
    return one.select(F.when(F.col("k") == 2, ratio(F.col("n0"), F.col("n1"))).otherwise(1.0).alias("weight"))

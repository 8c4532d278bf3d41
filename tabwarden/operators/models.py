"""Classifiers, their search spaces, cross-validation and the hold-out run, on pyspark.ml.

Fitting leaves the query plan; its product, scored rows (model, fold, id, y, p), is where everything else begins. K, the number
of classes, is told once, from the training table.
"""

from __future__ import annotations

import itertools
import logging
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import Normalizer, SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import named
from ..functions.store import stored
from . import side_by_side
from .boosting import InSql, fit_boosted
from .margins import Lift, fit_by_batches, folds_of_rows
from .prep import stratified_folds
from .scoring import auc, best_threshold, bundle, class_bundle, long_metrics, mean_threshold, one_against_rest
from .selection import LIMIT, preprocess, select_features

log = logging.getLogger(__name__)

#: Candidates of the random search, the most that an exhaustive one may have, candidates fitted side by side, and seeds.
DRAWS, MOST_CANDIDATES, AT_ONCE, SEED = 40, 500, 4, 42
#: Folds whose held-out margins a logistic curve is fitted on.
CURVE_FOLDS = 3


@dataclass(frozen=True)
class Spec:
    """A model of the registry: its kind, its search space, and parameters it has without a search."""

    kind: str
    grid: dict[str, list] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)


REGISTRY: dict[str, Spec] = {
    "Logistic Regression": Spec("logistic", {"regParam": [0.0, 0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0], "maxIter": [50, 100]}),
    # A margin, linear or over random features of a radial kernel, with a logistic curve over it.
    "SVC": Spec("svc", {"kernel": ["linear", "rbf"], "regParam": [0.001, 0.01, 0.1, 1.0], "maxIter": [50, 100]}, {"kernel": "rbf", "regParam": 0.001, "maxIter": 30}),
    "Random Forest": Spec("forest", {"numTrees": [20, 50, 100], "maxDepth": [5, 10], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2"]}),
    # Modified Huber loss with an elastic net, by mini-batches.
    "SGD": Spec("sgd", {"regParam": [0.0001, 0.001, 0.01], "elasticNetParam": [0.0, 0.15, 0.5, 1.0], "rate": [0.5, 1.0]}, {"regParam": 0.0001, "elasticNetParam": 0.15}),
    "MLP": Spec("mlp", {"hidden": [[16], [32], [16, 16]], "stepSize": [0.01, 0.03], "maxIter": [50, 100]}, {"hidden": [16], "maxIter": 50}),
    "Decision Tree": Spec("tree", {"maxDepth": [3, 5, 10], "impurity": ["gini", "entropy"], "minInstancesPerNode": [1, 2, 4]}),
    # Second order, all classes at once.
    "XGBoost": Spec("boosted", {
        "maxIter": [10, 20, 50], "maxDepth": [3, 5], "stepSize": [0.05, 0.1, 0.3], "subsamplingRate": [0.8, 1.0], "columnRate": [0.7, 1.0], "regLambda": [1.0, 5.0], "gamma": [0.0, 0.1],
        "positiveWeight": [1.0, 2.0],
    }, {"maxIter": 10}),
}
#: Parameters that mean something for two classes only, and those of boosted trees by their names in fit_boosted().
TWO_CLASSES_ONLY = {"positiveWeight"}
BOOSTED = {
    "maxIter": "rounds", "maxDepth": "depth", "stepSize": "step", "subsamplingRate": "share", "columnRate": "columns", "regLambda": "reg_lambda", "gamma": "gamma", "positiveWeight": "positive",
}


def adjusted(spec: Spec, k: int) -> Spec:
    """The spec for K classes: what holds for two classes only leaves the space and the parameters. Binary-only kinds run one class against the rest."""
    if k == 2:
        return spec
    return Spec(spec.kind, *({n: v for n, v in x.items() if n not in TWO_CLASSES_ONLY} for x in (spec.grid, spec.params)))


def estimator(kind: str, params: dict, k: int, width: int) -> Estimator:
    p = dict(params)
    if kind == "logistic":
        return LogisticRegression(family="binomial" if k == 2 else "multinomial", **p)
    if kind == "svc":
        return LinearSVC(**p)
    if kind == "forest":
        return RandomForestClassifier(seed=SEED, **p)
    if kind == "tree":
        return DecisionTreeClassifier(seed=SEED, **p)
    if kind == "mlp":
        return MultilayerPerceptronClassifier(seed=SEED, layers=[width, *p.pop("hidden", [16]), k], **p)
    raise ValueError(f"no kind of model {kind}")


@dataclass
class Fitted:
    """Fitted models: one that knows all classes, or one per class against the rest, each with a curve over its margin if it has no probability."""

    models: list[Transformer | InSql]
    curves: list[Transformer | None]
    k: int
    lift: Lift | None = None

    def scores(self, df: DataFrame) -> DataFrame:
        """df, which has a vector column `features`, with p: the scores of classes 0 to K - 1, which sum to 1."""
        scored, p = self.scored(df, "features", "")
        return scored.select(*df.columns, p.alias("p"))

    def scored(self, df: DataFrame, features: str, tag: str) -> tuple[DataFrame, Column]:
        """df with hidden columns whose names begin with _ and have `tag` in them, and the scores over them, from the vector column `features`."""
        if isinstance(self.models[0], InSql):
            return self.models[0].scored(df, features, tag)
        if self.lift is not None:
            df, features = self.lift.lifted(df, features, f"_lift{tag}"), f"_lift{tag}"
        for i, (model, curve) in enumerate(zip(self.models, self.curves)):
            raw, prob, label = f"_raw{tag}{i}", f"_prob{tag}{i}", f"_label{tag}{i}"
            names = {model.featuresCol: features, model.rawPredictionCol: raw, model.predictionCol: label} | ({model.probabilityCol: prob} if hasattr(model, "probabilityCol") else {})
            df = model.transform(df, names)
            if curve is not None:
                df = VectorAssembler(inputCols=[f"_margin{tag}{i}"], outputCol=f"_margins{tag}{i}").transform(df.withColumn(f"_margin{tag}{i}", vector_to_array(raw)[1]))
                df = curve.transform(df, {curve.featuresCol: f"_margins{tag}{i}", curve.rawPredictionCol: f"_r{tag}{i}", curve.probabilityCol: prob, curve.predictionCol: f"_l{tag}{i}"})
        if len(self.models) == 1:
            return df, vector_to_array(f"_prob{tag}0")
        each = F.array(*[vector_to_array(f"_prob{tag}{i}")[1] for i in range(self.k)])
        total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        return df, F.transform(each, lambda x: F.when(total > 0, x / total).otherwise(1.0 / self.k))


def fit(rows: DataFrame, kind: str, params: dict, k: int, width: int) -> Fitted:
    """rows: label and features. A linear margin gets a logistic curve; kinds for two classes are fitted for each class if K > 2."""
    if kind == "boosted":
        return Fitted([fit_boosted(rows, k, width, seed=SEED, **{BOOSTED[n]: v for n, v in params.items()})], [None], k)
    if kind == "sgd":
        return Fitted([fit_by_batches(rows, k, width, **params)], [None], k)
    params, lift = dict(params), None
    if kind == "svc" and params.pop("kernel", "linear") == "rbf":
        lift = Lift.of(rows, width, params.pop("gamma", None))
        rows = lift.lifted(rows, "features", "_lift").withColumn("features", F.col("_lift")).drop("_lift")
    models, curves = [], []
    for c in [None] if k == 2 or kind != "svc" else range(k):
        own = rows if c is None else rows.withColumn("label", (F.col("label") == c).cast("double"))
        models.append(estimator(kind, params, 2 if kind == "svc" else k, width).fit(own))
        curves.append(held_out_curve(own, params) if kind == "svc" else None)
    return Fitted(models, curves, k, lift)


def held_out_curve(rows: DataFrame, params: dict) -> Transformer:
    """A logistic curve over the margins that rows get from a model that has not seen them: of training rows margins are further from 0 than of others."""
    folded, parts = rows.withColumn("_fold", folds_of_rows(CURVE_FOLDS)), []
    for f in range(CURVE_FOLDS):
        mine, others = folded.filter(F.col("_fold") == f), folded.filter(F.col("_fold") != f)
        if others.select("label").distinct().count() == 2:
            parts.append(LinearSVC(**params).fit(others).transform(mine).select("label", vector_to_array("rawPrediction")[1].alias("m")))
    if not parts:  # a class of so few equal rows has no fold without them
        parts.append(LinearSVC(**params).fit(rows).transform(rows).select("label", vector_to_array("rawPrediction")[1].alias("m")))
    margins = reduce(DataFrame.unionByName, parts)
    return LogisticRegression().fit(VectorAssembler(inputCols=["m"], outputCol="features").transform(margins))


def vectors(df: DataFrame, features: list[str], target: str, keep: list[str] = ()) -> DataFrame:
    places = [f"_{i}" for i in range(len(features))]
    rows = df.select(named(target).cast("double").alias("label"), *keep, *[named(f).cast("double").alias(p) for f, p in zip(features, places)])
    return VectorAssembler(inputCols=places, outputCol="features").transform(rows).select("label", *keep, "features")


def candidates(spec: Spec, search: str) -> list[dict]:
    """All combinations (`exhaustive`, ValueError beyond MOST_CANDIDATES) or DRAWS of them by a seeded draw (`randomized`)."""
    names = list(spec.grid)
    total = 1
    for n in names:
        total *= len(spec.grid[n])
    if search == "exhaustive":
        if total > MOST_CANDIDATES:
            raise ValueError(f"{total} candidates are more than {MOST_CANDIDATES}")
        return [dict(zip(names, c)) for c in itertools.product(*spec.grid.values())]
    draw = random.Random(SEED)
    chosen = draw.sample(range(total), min(DRAWS, total))
    out = []
    for number in chosen:
        one = {}
        for n in names:
            number, at = divmod(number, len(spec.grid[n]))
            one[n] = spec.grid[n][at]
        out.append(one)
    return out


def scored_auc(scored: DataFrame, k: int) -> DataFrame:
    """(model, auc) over all folds: the binary one, or the mean over classes."""
    if k == 2:
        return auc(scored.select("model", "y", F.col("p")[1].alias("p")), ["model"])
    return auc(one_against_rest(scored, k, ["model"]), ["model", "class"], empty=0.5).groupBy("model").agg(F.avg("auc").alias("auc"))


def search(rows: DataFrame, key: str, spec: Spec, k: int, width: int, how: str = "randomized", folds: int = 3, most: int | None = None) -> dict:
    """The candidate of the greatest AUC under stratified folds, the first of equal ones; a candidate that fails scores 0.

    Logistic candidates are fitted all together, a pass over the rows for each step of all of them (side_by_side.py), and scored in one
    pass. Of the other kinds AT_ONCE candidates are fitted at a time, so that small jobs fill the cluster.
    """
    folded = stratified_folds(rows, "label", key, folds)
    tried = candidates(spec, how)[:most]
    found = together(folded, k, width, folds, tried) if spec.kind == "logistic" else one_by_one(folded, spec, k, width, folds, tried)
    return tried[found.index(max(found))] if tried else dict(spec.params)


def together(folded: DataFrame, k: int, width: int, folds: int, tried: list[dict]) -> list[float]:
    """The AUC of each logistic candidate, to nine places: equal models are equal whatever the order of sums."""
    data = side_by_side.packed(folded.select("fold", "label", "features"), ["fold", "label"])
    numbers = folds * ((1 if k == 2 else k) * (width + 1) + 1)
    share, out = max(1, side_by_side.MOST_NUMBERS // numbers), []
    for at in range(0, len(tried), share):
        part = tried[at : at + share]
        weights, intercepts = side_by_side.fit_logistic(data, k, width, folds, part)
        scored = side_by_side.scores(data, k, weights, intercepts)
        worth = {r["model"]: r["auc"] or 0.0 for r in scored_auc(scored, k).collect()}  # a row for each candidate
        out += [round(worth.get(str(i), 0.0), 9) for i in range(len(part))]
    return out


def one_by_one(folded: DataFrame, spec: Spec, k: int, width: int, folds: int, tried: list[dict]) -> list[float]:
    """The AUC of each candidate, AT_ONCE of them at a time."""
    folded = folded.cache()

    def worth(params: dict) -> float:
        try:
            fitted = {f: fit(folded.filter(F.col("fold") != f), spec.kind, params, k, width) for f in range(folds)}
            scored = in_one_pass(folded, {"m": fitted}, {f: F.col("features") for f in range(folds)}, dict.fromkeys(range(folds), width))
            return scored_auc(scored.select("model", F.col("label").alias("y"), "p"), k).first()["auc"] or 0.0
        except Exception as error:  # what a library refuses must not end the search
            log.warning("candidate %s failed: %s", params, error)
            return 0.0

    try:
        folded.count()  # cached once, before all ask for it
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return list(pool.map(worth, tried))
    finally:
        folded.unpersist()


def in_one_pass(df: DataFrame, fitted: dict[str, dict[int, Fitted]], features: dict[int, Column], widths: dict[int, int]) -> DataFrame:
    """df (with `fold`) as (model, its columns, p): every row scored by each model that was fitted for its fold, in one pass over df.

    features: the vector of a row, by fold. A model only ever sees vectors of its own fold: to it the rows of others are zeros, and what it says of
    them is not looked at. Rows whose fold has no model of a name are left out for that name.
    """
    names, own = list(df.columns), {}
    rows = df.filter(F.col("fold").isin(sorted(features)))
    for f, vector in features.items():
        zeros = array_to_vector(F.array(*[F.lit(0.0)] * widths[f]))
        rows = rows.withColumn(f"_x{f}", F.when(F.col("fold") == f, vector).otherwise(zeros))
    for i, (m, by_fold) in enumerate(fitted.items()):
        p = F.lit(None).cast("array<double>")
        for f, model in by_fold.items():
            rows, said = model.scored(rows, f"_x{f}", f"{i}_{f}_")
            p = F.when(F.col("fold") == f, said).otherwise(p)
        own[m] = p
    told = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in own.items()])).alias("_told")
    return rows.select(*map(named, names), told).filter("_told.p is not null").select("_told.model", *map(named, names), "_told.p")


def evaluate(scored: DataFrame, k: int, metric: str, thresholds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics long, thresholds): thresholds tuned on the scored rows unless given; 0.5 for more than two classes."""
    if k > 2:
        return long_metrics(class_bundle(scored, k)), scored.select("model", "fold").distinct().withColumn("threshold", F.lit(0.5))
    binary = scored.select("model", "fold", "y", F.col("p")[1].alias("p"))
    found = best_threshold(binary, metric) if thresholds is None else thresholds
    joined = binary.join(F.broadcast(found.select("model", "fold", "threshold")), ["model", "fold"])  # one row per model and fold
    return long_metrics(bundle(joined, F.col("threshold"))), found


Errors = list[tuple[str, str, int, str]]


def chosen(ready: DataFrame, names: list[str], target: str, method: str | None, limit: float) -> list[str]:
    """The features that a selector keeps; `limit` of correlation is for the one that looks at it."""
    if not method:
        return names
    return select_features(ready, names, target, method, **({"limit": limit} if method == "featurewiz" else {}))


def scored_rows(df: DataFrame, target: str, key: str, fitted: dict[str, dict[int, Fitted]], made: dict[int, dict[str, str]]) -> DataFrame:
    """(model, fold, id, y, p) of the rows of df, which has `fold`: each fold's features by their SQL, then every model of the fold, in one pass."""
    fitted = {m: by for m, by in fitted.items() if by}
    if not fitted:
        return df.sparkSession.createDataFrame([], f"model string, fold int, id {dict(df.dtypes)[key]}, y int, p array<double>")
    vector = {f: array_to_vector(F.array(*[F.expr(sql).cast("double") for sql in features.values()])) for f, features in made.items()}
    scored = in_one_pass(df, fitted, vector, {f: len(features) for f, features in made.items()})
    return scored.select("model", F.col("fold").cast("int").alias("fold"), named(key).alias("id"), named(target).cast("int").alias("y"), "p")


def fit_all(
    train: DataFrame, target: str, key: str, k: int, models: list[str], method: str | None, params: dict[str, dict] | None, limit: float, failed,
) -> tuple[dict[str, str], dict[str, Fitted]]:
    """The features that the train table selects, with the SQL of each, and the models fitted on it; failed(model, error) hears of each that is not."""
    ready, _, made = preprocess(train, train, [target, key])
    names = chosen(ready, list(made), target, method, limit)
    own, fitted = vectors(ready, names, target, [key]).cache(), {}
    try:
        for m in models:
            spec = adjusted(REGISTRY[m], k)
            try:
                fitted[m] = fit(own, spec.kind, (params or {}).get(m, spec.params), k, len(names))
            except Exception as error:
                failed(m, error)
    finally:
        own.unpersist()
    return {n: made[n] for n in names}, fitted


def cross_validate(
    df: DataFrame, target: str, key: str, k: int, models: list[str], folds: int = 5, method: str | None = None, params: dict[str, dict] | None = None,
    limit: float = LIMIT, errors: Errors | None = None,
) -> DataFrame:
    """(model, fold, id, y, p): every row scored by a model that was selected, scaled and fitted without its fold; one pass scores all folds and models.

    A fold whose preparation or fit fails is left out, with a warning and a row of `errors` (stage, model, fold, error), never
    scored by another model.
    """
    folded, errors = stored(stratified_folds(df, target, key, folds), "folded"), [] if errors is None else errors
    fitted: dict[str, dict[int, Fitted]] = {m: {} for m in models}
    made: dict[int, dict[str, str]] = {}

    def failed(model: str, fold: int, error: Exception) -> None:
        log.warning("%s, fold %d failed: %s", model, fold, error)
        errors.append(("cross-validation", model, fold, str(error)[:500]))

    for f in range(folds):
        try:
            features, own = fit_all(folded.filter(F.col("fold") != f).drop("fold"), target, key, k, models, method, params, limit, lambda m, error, f=f: failed(m, f, error))
        except Exception as error:
            failed("", f, error)
            continue
        made[f] = features
        for m, model in own.items():
            fitted[m][f] = model
    return scored_rows(folded, target, key, fitted, made)


def hold_out(
    train: DataFrame, test: DataFrame, target: str, key: str, k: int, models: list[str], method: str | None = None, params: dict[str, dict] | None = None,
    limit: float = LIMIT, errors: Errors | None = None,
) -> tuple[DataFrame, dict[str, Fitted], dict[str, str]]:
    """Scored rows of the test table (fold -1) by models fitted on the whole train table, the models, and the features with the SQL of each.

    A model that fails is left out, with a warning and a row of `errors`. One pass over the test table scores all models.
    """
    errors = [] if errors is None else errors

    def failed(model: str, error: Exception) -> None:
        log.warning("%s failed: %s", model, error)
        errors.append(("hold-out", model, -1, str(error)[:500]))

    features, fitted = fit_all(train, target, key, k, models, method, params, limit, failed)
    rows = test.withColumn("fold", F.lit(-1))
    return scored_rows(rows, target, key, {m: {-1: model} for m, model in fitted.items()}, {-1: features}), fitted, features


def hold_out_metrics(scored: DataFrame, k: int, thresholds: DataFrame) -> DataFrame:
    """Metrics of hold-out scores at the mean of each model's fold thresholds."""
    means = mean_threshold(thresholds).withColumn("fold", F.lit(-1))
    return evaluate(scored, k, "balanced_accuracy", means)[0]


def pipeline(model: Fitted, features: dict[str, str]) -> PipelineModel:
    """One model from raw columns to `p`, a vector of the scores of classes 0 to K - 1: preparation, selection, fitted models, curves over margins."""
    places = [f"_f{i}" for i in range(len(features))]
    made = ", ".join(f"{sql} AS {p}" for p, sql in zip(places, features.values()))
    if isinstance(model.models[0], InSql):
        return sql_pipeline(model.models[0], places, made)
    stages: list[Transformer] = [SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__"), VectorAssembler(inputCols=places, outputCol="_features")]
    if model.lift is not None:
        lifted = [f"_r{i}" for i in range(len(model.lift.shifts))]
        stages = [
            stages[0], SQLTransformer(statement=f"SELECT *, array({', '.join(places)}) AS _x FROM __THIS__"), SQLTransformer(statement=f"SELECT *, {model.lift.sql('_x')} AS _z FROM __THIS__"),
            SQLTransformer(statement=f"SELECT *, {', '.join(f'get(_z, {i}) AS {n}' for i, n in enumerate(lifted))} FROM __THIS__"), VectorAssembler(inputCols=lifted, outputCol="_features"),
        ]
    for i, (one, curve) in enumerate(zip(model.models, model.curves)):
        raw, chance = f"_raw{i}", f"_chance{i}"
        given = {one.featuresCol: "_features", one.rawPredictionCol: raw, one.predictionCol: f"_label{i}"} | ({one.probabilityCol: chance} if hasattr(one, "probabilityCol") else {})
        stages.append(one.copy(given))
        if curve is not None:
            stages.append(VectorSlicer(inputCol=raw, outputCol=f"_margin{i}", indices=[1]))
            stages.append(curve.copy({curve.featuresCol: f"_margin{i}", curve.rawPredictionCol: f"_c{i}", curve.probabilityCol: chance, curve.predictionCol: f"_l{i}"}))
        if len(model.models) > 1:
            stages.append(VectorSlicer(inputCol=chance, outputCol=f"_one{i}", indices=[1]))
    if len(model.models) > 1:
        stages += [VectorAssembler(inputCols=[f"_one{i}" for i in range(model.k)], outputCol="_all"), Normalizer(inputCol="_all", outputCol="p", p=1.0)]
    else:
        stages.append(SQLTransformer(statement="SELECT *, _chance0 AS p FROM __THIS__"))
    return PipelineModel(stages)


def sql_pipeline(model: InSql, places: list[str], made: str) -> PipelineModel:
    """A model that is SQL over the features."""
    margins, chances = [f"_m{i}" for i in range(1 if model.k == 2 else model.k)], [f"_p{i}" for i in range(model.k)]
    said = lambda names, sql: ", ".join(f"{x} AS {n}" for n, x in zip(names, sql))
    return PipelineModel([
        SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__"), SQLTransformer(statement=f"SELECT *, array({', '.join(places)}) AS _x FROM __THIS__"),
        SQLTransformer(statement=f"SELECT *, {said(margins, model.margins('_x'))} FROM __THIS__"), SQLTransformer(statement=f"SELECT *, {said(chances, model.chances(margins))} FROM __THIS__"),
        VectorAssembler(inputCols=chances, outputCol="p"),
    ])


def save(fitted: dict[str, Fitted], features: dict[str, str], path: str) -> None:
    """Each model, from raw columns to scores, as a pipeline model under path/<name>."""
    for name, f in fitted.items():
        pipeline(f, features).write().overwrite().save(f"{path}/{name.replace(' ', '_')}")

"""The whole run: check, audit, cross-validate, hold out, explain, write."""

from __future__ import annotations

import logging
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import stored
from ..operators import bias, curves, explain, models, prep, scoring
from ..sources.tables import Config, read_config, read_pair, write_errors, write_table

log = logging.getLogger(__name__)


def audit_table(df: DataFrame, feature: str, target: str = prep.TARGET, subgroup: str | None = None, label: int = 1) -> DataFrame:
    """The audit of one raw table: text as integer codes, then ages in groups, then the metrics."""
    coded = prep.bin_age(prep.code_integers(df, [c for c in {feature, subgroup} - {None} if prep.is_text(df, c)]), "age")
    return bias.audit(coded, feature, target, label, subgroup, None, feature != "age")


def run(spark: SparkSession, folder: str, config: Config, out: str) -> None:
    """Reads Train and Test of a folder and writes the results' tables under `out`; what fails in a stage is a row of Errors, and ends the run where nothing can follow."""
    errors: models.Errors = []
    try:
        steps(spark, folder, config, out, errors)
    except Exception as error:
        log.warning("the run ended early: %s", error)
        errors.append(("run", "", -1, str(error)[:500]))
    write_errors(spark, errors, f"{out}/Errors")


def steps(spark: SparkSession, folder: str, config: Config, out: str, errors: models.Errors) -> None:
    """The stages of run(), one after the other; errors hears of what failed in one that others do without."""

    def tried(stage: str, model: str, work) -> None:
        try:
            work()
        except Exception as error:
            log.warning("%s of %s failed: %s", stage, model or "the run", error)
            errors.append((stage, model, -1, str(error)[:500]))

    train, test = read_pair(spark, folder)
    target = config.target
    if config.bias_assessment and config.feature:
        for name, df in (("Train", train), ("Test", test)):
            tried(f"audit {name}", "", lambda name=name, df=df: write_table(audit_table(df, config.feature, target, config.subgroup, config.label), f"{out}/BiasAssessment/{name}"))
    train, test, key = prep.prepared(train, test, target, config.key)
    k = train.select(F.col(f"`{target}`")).distinct().count()
    tried("class profile", "", lambda: write_table(prep.class_profile(train, target), f"{out}/ClassProfile"))
    params = {}
    if config.search:
        ready, _, made = models.preprocess(train, test, [target, key])
        rows = models.vectors(ready, list(made), target, [key])
        for m in config.models:
            tried("search", m, lambda m=m: params.update({m: models.search(rows, key, models.adjusted(models.REGISTRY[m], k), k, len(made), config.search)}))
    chosen = list(config.models)
    write_table(models.cross_validate(train, target, key, k, chosen, config.folds, config.selector, params, config.correlation_limit, errors), f"{out}/FoldScores")
    folded = spark.read.parquet(f"{out}/FoldScores")
    metrics, thresholds = models.evaluate(folded, k, config.metric)
    write_table(metrics, f"{out}/FoldMetrics")
    write_table(thresholds, f"{out}/Thresholds")
    write_table(scoring.fold_summary(metrics), f"{out}/{config.folds}_fold_results")
    scored, fitted, features = models.hold_out(train, test, target, key, k, chosen, config.selector, params, config.correlation_limit, errors)
    write_table(scored, f"{out}/TestScores")
    scored = spark.read.parquet(f"{out}/TestScores")
    write_table(scoring.wide_report(models.hold_out_metrics(scored, k, thresholds)), f"{out}/test_results")
    for name, rows in (("Folds", folded), ("Test", scored)):
        tried(f"confusion {name}", "", lambda name=name, rows=rows: write_table(confusion_cells(rows, k, thresholds), f"{out}/Confusion/{name}"))
        tried(f"curves {name}", "", lambda name=name, rows=rows: write_curves(rows, k, f"{out}/Curves/{name}"))
    tried("saving", "", lambda: models.save(fitted, features, f"{out}/Models"))
    for m, model in fitted.items():
        tried("explanation", m, lambda m=m, model=model: explain_model(model, m, features, test, target, key, k, f"{out}/Explanation/{m.replace(' ', '_')}"))


def confusion_cells(scored: DataFrame, k: int, thresholds: DataFrame) -> DataFrame:
    """(model, fold, actual, predicted, n): two classes at each model's mean threshold, more by their greatest score."""
    if k > 2:
        return scoring.class_confusion(scored, k)
    means = scoring.mean_threshold(thresholds).select("model", "threshold")
    rows = scored.select("model", "fold", "y", F.col("p")[1].alias("p")).join(F.broadcast(means), "model")  # one row per model
    return scoring.binary_cells(scoring.confusion(rows, F.col("threshold")))


def write_curves(scored: DataFrame, k: int, path: str) -> None:
    """Points of the ROC and precision-recall curves by model and class, and the areas under them."""
    by = ["model", "class"]
    each = scored.select("model", F.lit(1).alias("class"), "y", F.col("p")[1].alias("p")) if k == 2 else scoring.one_against_rest(scored, k, ["model"])
    write_table(curves.roc(each, by), f"{path}/Roc")
    write_table(curves.precision_recall(each, by), f"{path}/PrecisionRecall")
    write_table(curves.curve_report(scored, k, ["model"]) if k > 2 else curves.areas(curves.cumulative(each, by), by), f"{path}/Areas")


def explain_model(model: models.Fitted, name: str, features: dict[str, str], test: DataFrame, target: str, key: str, k: int, path: str) -> None:
    """Attributions of a sample of the test rows by the explainer that suits the model, and what reports and plots show of them."""
    kind, names = explain.explainer(name), list(features)
    sample = prep.stratified_sample(test, target, key, explain.KERNEL_ROWS if kind == "kernel" else explain.TREE_ROWS, binary=k == 2)
    ready = stored(sample.select(F.col(key), *[F.expr(sql).alias(n) for n, sql in features.items()]), "explained")
    if kind == "linear" and k == 2:
        weights = dict(zip(names, (float(w) for w in model.models[0].coefficients)))
        shap = explain.linear_shap(ready, key, weights).withColumn("class", F.lit(1)).withColumn("error", F.lit(0.0))
    elif kind == "tree":
        shap = explain.of_trees(model.models, ready, key, names)
    else:
        shap = explain.explained(ready, key, names, model.scores)
    write_table(shap, f"{path}/Values")
    shap = test.sparkSession.read.parquet(f"{path}/Values")
    write_table(explain.importance(shap), f"{path}/Importance")
    write_table(explain.class_importance(shap), f"{path}/ClassImportance")
    told = explain.telling_class(shap)
    write_table(told, f"{path}/TellingClass")
    write_table(explain.beeswarm(shap.join(F.broadcast(told.select("class")), "class", "left_semi")), f"{path}/Beeswarm")  # a single row


def main(args: list[str] | None = None) -> None:
    import argparse

    parse = argparse.ArgumentParser(description="Audit and evaluate classifiers over a train and a test table.")
    parse.add_argument("folder", help="holds Train.csv and Test.csv")
    parse.add_argument("out")
    parse.add_argument("-c", "--config", help="YAML file of the run")
    parse.add_argument("-f", "--feature", help="feature to audit")
    parse.add_argument("-t", "--target", help="column of the classes")
    parse.add_argument("-l", "--label", type=int, help="class whose shares the audit compares")
    parse.add_argument("-s", "--subgroup", help="column of subgroups for the audit")
    parse.add_argument("-i", "--index", help="column that tells rows apart")
    said = parse.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    config = read_config(spark, said.config) if said.config else Config()
    given = {"feature": said.feature, "target": said.target, "label": said.label, "subgroup": said.subgroup, "key": said.index}
    config = replace(config, **{n: v for n, v in given.items() if v is not None})
    run(spark, said.folder, replace(config, bias_assessment=True) if said.feature else config, said.out)


if __name__ == "__main__":
    main()

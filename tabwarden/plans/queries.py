"""The registered queries of tabular audit and evaluation, by the operator's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.store import written
from ..operators import bias, boosting, clusters, curves, explain, models, prep, scoring, selection, trees
from ..sources import tables
from . import frames
from .frames import CLASSES, FEATURES

M, G = ["model"], ["model", "fold"]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, counts as long: what the SQL says too."""
    kinds = dict(df.dtypes)
    return df.select(*[rounded(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("bigint").alias(c) if kinds[c] in ("int", "bigint") else F.col(c) for c in df.columns])


def metric(of, scope: str | None = None, facet: str = "a", outcome: str = "y", subgroup: str | None = "s"):
    """A query that gives one metric over the orders."""

    def query(spark, d):
        ct = bias.contingency(frames.orders(spark, d), facet, outcome, subgroup, None if scope is None else F.col(scope))
        return tidy(of(ct))

    return query


def scanned(kind: str):
    """The events written in a format and read back by its scan: JSON has one record on a line."""

    def query(spark, d):
        events = frames.read(spark, d, "events").select("event_id", "event_type", "props", "value")
        found = tables.read_table(spark, written(events, "scan", kind))
        return tidy(found.select("event_type", F.get_json_object("props", "$.k").alias("prop"), "value").groupBy("event_type").agg(
            F.count("*").alias("n"), F.count("prop").alias("n_prop"), F.sum("value").alias("total"),
        ))

    return query


def p2_index(spark, d):
    df, key = prep.assign_key(frames.read(spark, d, "nation").select("n_name", "n_regionkey"))
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"))


def gaps(spark, d):
    """Labelled events with nulls in them."""
    e = frames.read(spark, d, "events")
    return e.select("event_id", F.when(F.col("value") > 20, F.col("value")).alias("value"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"))


def p3_drop_nulls(spark, d):
    return tidy(prep.drop_null_rows(gaps(spark, d), "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")))


def halves(spark, d):
    rows = frames.orders(spark, d).select("k", "seg", "s", F.when(F.col("k") % 97 == 0, F.lit("odd")).otherwise(F.col("seg")).alias("seg2"))
    return rows.filter("k % 2 = 0"), rows.filter("k % 2 = 1 and seg <> 'BUILDING'")


def p4_domains(spark, d):
    train, test = halves(spark, d)
    return prep.domain_report(train, test)


def p5_prepare(spark, d):
    rows = gaps(spark, d).join(frames.read(spark, d, "events").select("event_id", "user_id"), "event_id").withColumn("Target", F.col("user_id") % 2).withColumnRenamed("event_id", "ID")
    train, test = prep.prepare(rows.filter("ID % 4 <> 0"), rows.filter("ID % 4 = 0"))
    side = lambda df, n: df.groupBy(F.lit(n).alias("side"), F.col("Target").alias("target")).agg(F.count("*").alias("n"))
    return side(train, "train").unionByName(side(test, "test"))


def p6_split(spark, d):
    x, y = prep.split_label(frames.documents(spark, d), "y")
    return x.select("doc_id", "lang", "t")


def p7_codes(spark, d):
    return prep.code_integers(frames.documents(spark, d).select("doc_id", F.when(F.col("lang") != "es", F.col("lang")).alias("lang"), "source"))


def p8_age(spark, d):
    rows = frames.read(spark, d, "part").select(F.when(F.col("p_size") % 11 != 0, F.col("p_size") * 2 - 3).alias("age"))
    return tidy(prep.bin_age(rows).groupBy("age").agg(F.count("*").alias("n")))


def p9_filter(spark, d):
    return tidy(prep.rows_where(frames.orders(spark, d), s="1-URGENT", a=1).groupBy("y3").agg(F.count("*").alias("n"), F.sum("price").alias("total")))


def folds_of(df: DataFrame) -> DataFrame:
    return tidy(df.groupBy("fold", "y3").agg(F.count("*").alias("n"), F.sum("k").alias("keys")))


def p10_folds(spark, d):
    return folds_of(prep.stratified_folds(frames.orders(spark, d), "y3", "k"))


def sampled(df: DataFrame, y: str, k: str) -> DataFrame:
    return tidy(df.groupBy(F.col(y).alias("y")).agg(F.count("*").alias("n"), F.sum(k).alias("keys")))


def p11_sample(spark, d):
    return sampled(prep.stratified_sample(frames.orders(spark, d), "y", "k", 100), "y", "k")


def p12_sample(spark, d):
    return sampled(prep.stratified_sample(frames.embeddings(spark, d), "y", "id", 100, binary=False), "y", "id")


def p13_split(spark, d):
    train, test = prep.train_test_split(frames.embeddings(spark, d), "y", "id")
    side = lambda df, n: df.groupBy(F.lit(n).alias("side"), "y").agg(F.count("*").alias("n"), F.sum("id").alias("keys"))
    return tidy(side(train, "train").unionByName(side(test, "test")))


def b17_v(spark, d):
    ct = bias.contingency(frames.orders(spark, d), "seg", "y3")
    two = bias.contingency(frames.orders(spark, d), "a", "y").withColumn("scope", F.lit("two"))
    return tidy(bias.cramers_v(ct).unionByName(bias.cramers_v(two)))


def b18_logistic(spark, d):
    w, b = bias.logistic_coefficient(frames.orders(spark, d), "a", "y")
    found = spark.createDataFrame([("LR", w), ("LR_intercept", b)], "metric string, value double")
    return found.select("metric", rounded(F.col("value"), 4).alias("value"))


def b19_audit(spark, d):
    return tidy(bias.audit(frames.orders(spark, d), "a", "y", 1, "s").select("scope", "metric", "value", "threshold", "biased"))


def b20_bands(spark, d):
    found = bias.report(bias.binary_means(bias.contingency(frames.orders(spark, d), "a", "y")).unionByName(bias.class_imbalance(bias.contingency(frames.orders(spark, d), "a", "y"))))
    return tidy(found.select("metric", "value", "low", "high", ((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).alias("fair")))


def c1_cluster(spark, d):
    return clusters.cluster(frames.embeddings(spark, d), FEATURES, 5).groupBy("cluster").agg(F.count("*").alias("n"))


def c2_davies_bouldin(spark, d):
    return tidy(clusters.davies_bouldin(frames.embeddings(spark, d), "y", FEATURES))


def chosen_by(how: str):
    def query(spark, d):
        n, placed = clusters.choose_clusters(frames.embeddings(spark, d), FEATURES, by=how)
        return placed.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("clusters", F.lit(n))

    return query


def c5_cluster_audit(spark, d):
    return tidy(clusters.audit_clusters(frames.orders(spark, d), F.col("s"), "a", "y").select("scope", "metric", "value", "biased"))


def f1_sulov(spark, d):
    e = frames.embeddings(spark, d).select("*", (F.col("f0") * 2 + F.col("f1") * 0.1).alias("g0"), (F.col("f2") - F.col("f3") * 0.2).alias("g1"))
    return tidy(selection.sulov(e, [*FEATURES, "g0", "g1"], "y"))


def f1_correlations(spark, d):
    return tidy(selection.correlations(frames.embeddings(spark, d), FEATURES))


def selected(method: str):
    def query(spark, d):
        rows = frames.embeddings(spark, d).withColumn("t", (F.col("y") < 5).cast("int"))
        return spark.createDataFrame([(f,) for f in selection.select_features(rows, FEATURES, "t", method)], "feature string")

    return query


def f8_z_scores(spark, d):
    rows = frames.embeddings(spark, d).withColumn("one", F.lit(1.0))
    return tidy(selection.z_scores(rows, ["f0", "f1", "one"]).select("id", "f0", "f1", "one"))


def f9_one_hot(spark, d):
    rows = frames.orders(spark, d).select("k", "seg")
    hot = selection.one_hot(rows, "seg", selection.categories(rows, "seg"))
    return tidy(hot.select("k", *[F.col(f"`{c}`").alias(c.replace("=", "_").lower()) for c in hot.columns if c != "k"]))


def f10_routing(spark, d):
    numeric, text = selection.routed(frames.orders(spark, d).withColumn("flag", F.col("a") == 1), ["k", "y"])
    return spark.createDataFrame([(c, "numeric") for c in numeric] + [(c, "text") for c in text], "feature string, kind string")


def f12_weight(spark, d):
    return tidy(selection.positive_weight(frames.orders(spark, d), "y"))


def m1_predictions(spark, d):
    b = frames.binary_scores(spark, d).select("model", "fold", "y", scoring.hard_binary(0.5).alias("predicted"))
    c = frames.class_scores(spark, d).select("model", "fold", "y", scoring.hard_class().alias("predicted"))
    return tidy(b.unionByName(c).groupBy("model", "fold", "y", "predicted").agg(F.count("*").alias("n")))


def m2_confusion(spark, d):
    return scoring.confusion(frames.binary_scores(spark, d))


def m2_classes(spark, d):
    return tidy(scoring.class_confusion(frames.class_scores(spark, d), CLASSES))


def m2_class_counts(spark, d):
    return tidy(scoring.class_counts(scoring.class_confusion(frames.class_scores(spark, d), CLASSES)))


def rate(name: str):
    def query(spark, d):
        b = scoring.rates(scoring.confusion(frames.binary_scores(spark, d)), G).select(*G, name)
        return tidy(b.unionByName(scoring.class_bundle(frames.class_scores(spark, d), CLASSES).select(*G, name)))

    return query


def m5_auc(spark, d):
    return tidy(scoring.auc(frames.binary_scores(spark, d)).unionByName(scoring.class_bundle(frames.class_scores(spark, d), CLASSES).select(*G, "auc")))


def m9_bundle(spark, d):
    return tidy(scoring.bundle(frames.binary_scores(spark, d)))


def m10_sweep(spark, d):
    return tidy(scoring.threshold_sweep(frames.binary_scores(spark, d)))


def m11_thresholds(spark, d):
    s = frames.binary_scores(spark, d)
    return tidy(scoring.best_threshold(s).withColumn("by", F.lit("balanced_accuracy")).unionByName(scoring.best_threshold(s, "auc").withColumn("by", F.lit("auc"))))


def m12_roc(spark, d):
    return tidy(curves.roc(frames.binary_scores(spark, d), M))


def m12_class_auc(spark, d):
    own = ["model", "class"]
    return tidy(curves.roc_area(scoring.one_against_rest(frames.class_scores(spark, d), CLASSES, M), own))


def m13_micro(spark, d):
    return tidy(curves.roc_area(curves.micro(frames.class_scores(spark, d), CLASSES, M), M))


def m14_macro(spark, d):
    return tidy(curves.macro_area(curves.cumulative(scoring.one_against_rest(frames.class_scores(spark, d), CLASSES, M), [*M, "class"]), M))


def m15_pr(spark, d):
    return tidy(curves.precision_recall(frames.binary_scores(spark, d), M))


def m15_ap(spark, d):
    b = curves.average_precision(frames.binary_scores(spark, d), M)
    return tidy(b.unionByName(curves.average_precision(curves.micro(frames.class_scores(spark, d), CLASSES, M), M)))


def m16_curves(spark, d):
    return tidy(curves.curve_report(frames.class_scores(spark, d), CLASSES, M))


def fold_metrics(spark, d):
    return scoring.long_metrics(scoring.bundle(frames.binary_scores(spark, d)))


def r1_folds(spark, d):
    return tidy(scoring.fold_summary(fold_metrics(spark, d)).drop("summary"))


def r2_confusion(spark, d):
    b = scoring.mean_confusion(scoring.binary_cells(scoring.confusion(frames.binary_scores(spark, d))))
    return tidy(b.unionByName(scoring.mean_confusion(scoring.class_confusion(frames.class_scores(spark, d), CLASSES))))


def r3_wide(spark, d):
    return tidy(scoring.wide_report(scoring.fold_summary(fold_metrics(spark, d)), "mean"))


def r4_hold_out(spark, d):
    s = frames.binary_scores(spark, d).filter("fold = 0")
    return tidy(scoring.wide_report(scoring.long_metrics(scoring.bundle(s, 0.5, M), M)))


def r5_layout(spark, d):
    return tidy(scoring.binary_cells(scoring.confusion(frames.binary_scores(spark, d), 0.5, M), M))


def r6_threshold(spark, d):
    return tidy(scoring.mean_threshold(scoring.best_threshold(frames.binary_scores(spark, d))))


def t4_score(spark, d):
    b = scoring.auc(frames.binary_scores(spark, d), M)
    return tidy(b.unionByName(models.scored_auc(frames.class_scores(spark, d), CLASSES)))


def small(spark, d):
    return frames.embeddings(spark, d).select("id", (F.col("y") < 5).cast("int").alias("t"), *FEATURES[:4])


def t7_cross_validation(spark, d):
    scored = models.cross_validate(small(spark, d), "t", "id", 2, ["Logistic Regression", "Decision Tree"], 3)
    return scoring.fold_summary(models.evaluate(scored, 2, "balanced_accuracy")[0])


def t8_hold_out(spark, d):
    train, test = prep.train_test_split(small(spark, d), "t", "id")
    scored, _, _ = models.hold_out(train, test, "t", "id", 2, ["Logistic Regression"])
    return models.evaluate(scored, 2, "balanced_accuracy")[0]


def fitted(name: str):
    """A model of the registry fitted and asked for its scores of the same rows, by class."""

    def query(spark, d):
        binary = name == "SVC"
        rows = small(spark, d).withColumn("y", F.col("t") if binary else F.col("id") % 3)
        k = 2 if binary else 3
        ready = models.vectors(rows, FEATURES[:4], "y", ["id"])
        spec = models.adjusted(models.REGISTRY[name], k)
        model = models.fit(ready, spec.kind, spec.params, k, 4)
        return model.scores(ready).select("id", "label", F.posexplode("p").alias("class", "p")).groupBy("label", "class").agg(F.avg("p").alias("mean_p"), F.count("*").alias("n"))

    return query


def l7_split(spark, d):
    """The first tree of boosting, of depth 1: its feature, threshold, gain and leaves. Features are rounded, so that their values are the bins."""
    rows = small(spark, d).select("id", "t", *[F.round(f, 1).alias(f) for f in FEATURES[:4]])
    model = boosting.fit_boosted(models.vectors(rows, FEATURES[:4], "t"), 2, 4, rounds=1, depth=1, step=1.0, reg_lambda=1.0)
    tree = model.trees[0][0]
    found = spark.createDataFrame([(FEATURES[tree.feature[0]], tree.threshold[0], model.gains[tree.feature[0]], tree.value[1], tree.value[2])], "feature string, threshold double, gain double, below double, above double")
    return tidy(found)


def l1_logistic(spark, d):
    """Where the likelihood is greatest, a class's scores weigh every feature as the class's rows do: (class, feature, mean of score x feature)."""
    rows = small(spark, d).withColumn("y", F.col("id") % 3)
    ready = models.vectors(rows, FEATURES[:4], "y", ["id"])
    model = models.fit(ready, "logistic", {"tol": 1e-12, "maxIter": 500}, 3, 4)
    scored = model.scores(ready).select("id", F.posexplode("p").alias("class", "p")).join(rows, "id")
    told = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), c.alias("x")) for f, c in [("(one)", F.lit(1.0)), *((f, F.col(f)) for f in FEATURES[:4])]])).alias("e")
    means = scored.select("class", "p", told).groupBy("class", "e.feature").agg(F.avg(F.col("p") * F.col("e.x")).alias("mean"))
    return means.select(F.col("class").cast("bigint").alias("class"), "feature", rounded(F.col("mean"), 4).alias("mean"))


def t3_search(spark, d):
    ready = models.vectors(small(spark, d), FEATURES[:4], "t", ["id"])
    best = models.search(ready, "id", models.REGISTRY["Logistic Regression"], 2, 4)
    return spark.createDataFrame([(n, str(v)) for n, v in sorted(best.items())], "parameter string, value string")


def x2_sample(spark, d):
    return sampled(prep.stratified_sample(frames.embeddings(spark, d), "y", "id", explain.KERNEL_ROWS, binary=False), "y", "id")


def x4_linear(spark, d):
    weights = {f: (i - 4.5) / 10 for i, f in enumerate(FEATURES)}
    return tidy(explain.linear_shap(frames.embeddings(spark, d), "id", weights).select("id", "feature", "shap"))


def x5_trees(spark, d):
    rows = frames.embeddings(spark, d)
    few = prep.stratified_sample(rows, "y", "id", explain.TREE_ROWS, binary=False)
    shap = trees.tree_shap(rows, "id", FEATURES[:4], trees.leaf_table(spark, frames.TREES), few)
    return tidy(shap.select("id", "class", "feature", "shap"))


def x6_kernel(spark, d):
    """The same values as by leaves, of the trees taken as a model like any other."""
    from pyspark.ml.functions import vector_to_array

    rows = frames.embeddings(spark, d)
    few = prep.stratified_sample(rows, "y", "id", explain.TREE_ROWS, binary=False)

    def value(node, c):
        x = F.get("_x", F.lit(node[0])) if isinstance(node, tuple) else None
        return F.lit(node[c]) if x is None else F.when(x <= node[1], value(node[2], c)).otherwise(value(node[3], c))

    predict = lambda df: df.withColumn("_x", vector_to_array("features")).withColumn("p", F.array(*[sum((value(t, c) for t in frames.TREES), F.lit(0.0)) for c in (0, 1)])).drop("_x")
    shap = explain.kernel_shapley(rows, "id", FEATURES[:4], predict, few)
    return tidy(shap.select("id", "class", "feature", "shap"))


def x5_shapley(spark, d):
    from pyspark.ml.classification import RandomForestClassifier

    rows = small(spark, d)
    model = RandomForestClassifier(seed=1, numTrees=5).fit(models.vectors(rows, FEATURES[:4], "t"))
    few = prep.stratified_sample(rows, "t", "id", explain.TREE_ROWS)
    return explain.exact_shapley(few, "id", FEATURES[:4], explain.probability(model))


def x7_class(spark, d):
    return tidy(explain.telling_class(frames.fixed_shap(spark, d)))


def x8_importance(spark, d):
    return tidy(explain.importance(frames.fixed_shap(spark, d), 5))


def x9_class_importance(spark, d):
    return tidy(explain.class_importance(frames.fixed_shap(spark, d), 5))


def x10_beeswarm(spark, d):
    return tidy(explain.beeswarm(frames.fixed_shap(spark, d).filter("class = 0"), 5))


def s11_profile(spark, d):
    return tidy(prep.class_profile(frames.orders(spark, d), "y3"))


def p1_target(spark, d):
    return tidy(prep.check_target(frames.documents(spark, d), "y"))


QUERIES = {
    "s2_json_scan": scanned("json"), "s2_orc_scan": scanned("orc"), "s11_class_profile": s11_profile, "p1_target_check": p1_target, "p2_index": p2_index, "p3_drop_nulls": p3_drop_nulls,
    "p4_domain_match": p4_domains, "p5_prepare": p5_prepare, "p6_split_label": p6_split, "p7_integer_codes": p7_codes, "p8_age_bins": p8_age,
    "p9_filter": p9_filter, "p10_folds": p10_folds, "p11_sample_binary": p11_sample, "p12_sample_multiclass": p12_sample, "p13_train_test": p13_split,
    "b1_class_imbalance": metric(bias.class_imbalance, facet="seg"), "b2_label_difference": metric(bias.label_difference),
    "b2_label_difference_by_rank": metric(bias.label_difference_by_rank), "b3_disparity": metric(bias.demographic_disparity, facet="seg", outcome="y3"),
    "b3_disparity_table": metric(bias.disparity_table, facet="seg", outcome="y3"), "b4_conditional_disparity": metric(bias.conditional_disparity),
    "b4_conditional_table": metric(bias.conditional_table), "b5_pmf": metric(bias.conditional_pmf, facet="seg", outcome="y3"),
    "b6_kl": metric(bias.kl_divergence, outcome="y3"), "b7_b8_b10_distances": metric(bias.pmf_distances, outcome="y3"),
    "b9_total_variation": metric(bias.total_variation, facet="seg", outcome="y3"), "b11_nmi": metric(bias.normalised_information, facet="seg", outcome="y3"),
    "b12_ncmi": metric(bias.conditional_information, facet="seg", outcome="y3"), "b13_b14_binary_means": metric(bias.binary_means),
    "b15_conditional_difference": metric(bias.conditional_difference), "b16_correlation": metric(bias.correlation, outcome="y3"), "b17_cramers_v": b17_v,
    "b18_logistic": b18_logistic, "b19_audit": b19_audit, "b20_bands": b20_bands, "c1_clusters": c1_cluster, "c2_davies_bouldin": c2_davies_bouldin,
    "c3_choose_clusters": chosen_by("davies_bouldin"), "c4_choose_silhouette": chosen_by("silhouette"), "c5_cluster_audit": c5_cluster_audit,
    "f1_sulov": f1_sulov, "f1_correlations": f1_correlations, "f1_featurewiz": selected("featurewiz"), "f2_rfe": selected("rfe"), "f3_lasso": selected("lasso"),
    "f4_forest": selected("rf"), "f5_boosted": selected("xgboost"), "f8_z_scores": f8_z_scores, "f9_one_hot": f9_one_hot, "f10_routing": f10_routing,
    "f12_class_weight": f12_weight, "m1_predictions": m1_predictions, "m2_confusion": m2_confusion, "m2_class_confusion": m2_classes,
    "m2_class_counts": m2_class_counts, "m3_sensitivity": rate("sensitivity"), "m4_specificity": rate("specificity"), "m5_auc": m5_auc, "m6_f1": rate("f1"),
    "m7_accuracy": rate("accuracy"), "m8_balanced_accuracy": rate("balanced_accuracy"), "m9_bundle": m9_bundle, "m10_sweep": m10_sweep,
    "m11_thresholds": m11_thresholds, "m12_roc": m12_roc, "m12_class_auc": m12_class_auc, "m13_micro_roc": m13_micro, "m14_macro_roc": m14_macro,
    "m15_pr_curve": m15_pr, "m15_average_precision": m15_ap, "m16_curves": m16_curves, "r1_fold_summary": r1_folds, "r2_mean_confusion": r2_confusion,
    "r3_wide_report": r3_wide, "r4_hold_out_summary": r4_hold_out, "r5_confusion_layout": r5_layout, "r6_mean_threshold": r6_threshold,
    "t3_random_search": t3_search, "t4_search_score": t4_score, "t7_cross_validation": t7_cross_validation, "t8_hold_out": t8_hold_out,
    **{f"l{i}_{n.lower().replace(' ', '_')}": fitted(n) for i, n in enumerate(("Logistic Regression", "SVC", "Random Forest", "SGD", "MLP", "Decision Tree", "XGBoost"), 1)},
    "l1_logistic_optimum": l1_logistic, "l7_best_split": l7_split,
    "x2_explained_rows": x2_sample, "x4_linear_shap": x4_linear, "x5_tree_shap": x5_trees, "x6_kernel_shap": x6_kernel, "x5_x6_exact_shapley": x5_shapley, "x7_telling_class": x7_class, "x8_importance": x8_importance,
    "x9_class_importance": x9_class_importance, "x10_beeswarm": x10_beeswarm,
}

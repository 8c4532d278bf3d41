import os

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import clusters, explain, models, prep, selection
from tabwarden.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    """Two features that tell the classes, one that does not, one that repeats the first."""
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0
    df = spark.range(240).select("id", (F.col("id") % 3).alias("c"), *[u(i).alias(f"u{i}") for i in range(3)])
    return df.select(
        F.col("id").alias("ID"), (F.col("c") > 0).cast("long").alias("Target"), F.col("c").alias("c"), (F.col("c") + F.col("u0")).alias("x"),
        (F.col("c") * 0.5 + F.col("u1")).alias("z"), F.col("u2").alias("noise"), (F.col("c") * 2 + F.col("u0") * 2).alias("twin"),
    ).cache()


def test_z_scores(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (3.0, 5)], "x double, k int")
    got = sorted(r["x"] for r in selection.z_scores(df, ["x"]).collect())
    assert got == pytest.approx([-(1.5**0.5), 0, 1.5**0.5])
    assert {r["k"] for r in selection.z_scores(df, ["k"]).collect()} == {0.0}


def test_one_hot(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "s string")
    known = selection.categories(df, "s")
    assert known == ["a", "b"] and selection.one_hot(df, "s", known).columns == ["s=a", "s=b"]
    with pytest.raises(Exception, match="unknown category"):
        selection.one_hot(spark.createDataFrame([("c",)], "s string"), "s", known).collect()


def test_sulov_drops_one_of_two_twins(rows):
    got = {r["feature"]: r["kept"] for r in selection.sulov(rows, ["x", "z", "noise", "twin"], "Target").collect()}
    assert got["x"] != got["twin"] and got["noise"]


def test_a_feature_behind_a_stronger_one_is_found(spark):
    """Where one feature tells the target alone, trees over all features use no other; without it they find the next."""
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10_000)) / 10_000.0
    df = spark.range(800).select("id", F.round(u(1)).alias("strong"), u(2).alias("noise")).withColumn("weak", F.col("strong") * 0.6 + u(3) * 1.2).withColumn("y", F.col("strong").cast("int"))
    alone = selection.boosted_importances(df, ["strong", "weak", "noise"], "y")
    assert alone["weak"] < 1e-9
    got = selection.correlation_selection(df, ["noise", "weak", "strong"], "y")
    assert {"strong", "weak"} <= set(got) and got == [f for f in ["noise", "weak", "strong"] if f in got]


@pytest.mark.parametrize("method", sorted(selection.SELECTORS))
def test_selectors(rows, method):
    got = selection.select_features(rows, ["x", "z", "noise"], "Target", method)
    assert "x" in got or "z" in got
    assert set(got) <= {"x", "z", "noise"}


def test_unknown_selector(rows):
    with pytest.raises(ValueError):
        selection.select_features(rows, ["x"], "Target", "none")


@pytest.mark.parametrize("name", sorted(models.REGISTRY))
@pytest.mark.parametrize("k", [2, 3])
def test_models_score_better_than_chance(rows, name, k):
    ready = models.vectors(rows, ["x", "z", "noise"], "Target" if k == 2 else "c", ["ID"])
    spec = models.adjusted(models.REGISTRY[name], k)
    model = models.fit(ready, spec.kind, spec.params, k, 3)
    scored = model.scores(ready).select(F.lit("m").alias("model"), F.col("label").alias("y"), "p").cache()
    assert scored.filter(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-6).count() == 0
    assert models.scored_auc(scored, k).first()["auc"] > 0.8


def test_search(rows):
    ready = models.vectors(rows, ["x", "z"], "Target", ["ID"])
    best = models.search(ready, "ID", models.REGISTRY["Decision Tree"], 2, 2, folds=2, most=2)
    assert set(best) == set(models.REGISTRY["Decision Tree"].grid)
    with pytest.raises(ValueError):
        models.candidates(models.Spec("logistic", {"a": list(range(100)), "b": list(range(100))}), "exhaustive")
    assert len(models.candidates(models.REGISTRY["Logistic Regression"], "exhaustive")) == 30


def test_cross_validation_and_hold_out(rows):
    df = rows.drop("c")
    scored = models.cross_validate(df, "Target", "ID", 2, ["Logistic Regression"], 3).cache()
    assert scored.count() == 240 and scored.select("id").distinct().count() == 240
    metrics, thresholds = models.evaluate(scored, 2, "balanced_accuracy")
    assert metrics.count() == 18 and thresholds.count() == 3
    train, test = prep.train_test_split(df, "Target", "ID")
    held, fitted, _ = models.hold_out(train, test, "Target", "ID", 2, ["Logistic Regression"])
    assert held.count() == test.count()
    got = {r["metric"]: r["value"] for r in models.hold_out_metrics(held, 2, thresholds).collect()}
    assert got["auc"] > 0.8


def scans(df):
    """Scans of files in the plan as executed."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan") + plan.count("Scan ExistingRDD") + plan.count("InMemoryTableScan")


def test_all_folds_and_models_are_scored_in_one_pass(rows):
    """One scan of the folded table, and the scores that each fold's model gives by itself; models of other widths in the folds."""
    df, kinds = rows.drop("c"), ["Logistic Regression", "Decision Tree", "SVC"]
    scored = models.cross_validate(df, "Target", "ID", 2, kinds, 3, "featurewiz")
    assert scans(scored) == 1 and scored.count() == 240 * len(kinds)
    got = {(r["model"], r["id"]): r["p"] for r in scored.collect()}
    folded = prep.stratified_folds(df, "Target", "ID", 3).cache()
    for f in range(3):
        ready, other, made = selection.preprocess(folded.filter(F.col("fold") != f).drop("fold"), folded.filter(F.col("fold") == f).drop("fold"), ["Target", "ID"])
        names = models.chosen(ready, list(made), "Target", "featurewiz", models.LIMIT)
        for m in kinds:
            spec = models.REGISTRY[m]
            model = models.fit(models.vectors(ready, names, "Target", ["ID"]), spec.kind, spec.params, 2, len(names))
            for r in model.scores(models.vectors(other, names, "Target", ["ID"])).collect():
                assert got[m, r["ID"]] == pytest.approx(r["p"], abs=1e-6)


@pytest.mark.parametrize("k", [2, 3])
def test_side_by_side_fits_have_the_library_optimum(rows, k):
    """Weights of all candidates and folds, with ridge, lasso and both, equal those that the library fits one at a time; a constant feature has none."""
    from pyspark.ml.classification import LogisticRegression

    from tabwarden.operators import side_by_side

    names = ["x", "z", "noise", "one"]
    df = rows.withColumn("one", F.lit(3.0)).withColumn("x", F.col("x") * 50 + 1000)
    folded = prep.stratified_folds(models.vectors(df, names, "Target" if k == 2 else "c", ["ID"]), "label", "ID", 2)
    tried = [{"regParam": r, "elasticNetParam": e, "maxIter": 200} for r, e in ((0.01, 0.0), (0.02, 1.0), (0.05, 0.5), (0.5, 1.0))]
    data = side_by_side.packed(folded.select("fold", "label", "features"), ["fold", "label"])
    weights, intercepts = side_by_side.fit_logistic(data, k, 4, 2, tried)
    for c, params in enumerate(tried):
        for f in range(2):
            model = LogisticRegression(family="binomial" if k == 2 else "multinomial", tol=1e-12, **{**params, "maxIter": 1000}).fit(folded.filter(F.col("fold") != f))
            want, level = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
            assert abs(weights[c, f] - want).max() < 2e-3 * max(1, abs(want).max())
            assert abs((intercepts[c, f] - intercepts[c, f].mean() if k > 2 else intercepts[c, f]) - (level - level.mean() if k > 2 else level)).max() < 2e-3 * max(1, abs(level).max())


def test_search_side_by_side_chooses_as_one_by_one(rows):
    ready = models.vectors(rows, ["x", "z", "noise"], "Target", ["ID"])
    folded = prep.stratified_folds(ready, "label", "ID", 3)
    spec = models.REGISTRY["Logistic Regression"]
    tried = [c for c in models.candidates(spec, "exhaustive") if c["maxIter"] == 100 and c["regParam"] > 0][::4]  # without a penalty the library stops earlier
    both = models.together(folded, 2, 3, 3, tried), models.one_by_one(folded, spec, 2, 3, 3, tried)
    assert both[0] == pytest.approx(both[1], abs=2e-4)
    assert models.search(ready, "ID", spec, 2, 3) in models.candidates(spec, "randomized")


def rings(spark):
    """Two rings, one around the other, with some noise: no line tells them apart."""
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100_000)) / 100_000.0
    df = spark.range(600).select(F.col("id").alias("ID"), (F.col("id") % 2).alias("Target"), (u(1) * 6.28318).alias("a"), (1 + F.col("id") % 2 + 0.6 * (u(2) - 0.5)).alias("r"))
    return df.select("ID", "Target", (F.col("r") * F.cos("a")).alias("x"), (F.col("r") * F.sin("a")).alias("z")).cache()


def test_kernel_margin_tells_rings_apart(spark, rows, tmp_path):
    """A radial kernel does what no line does, its curve is calibrated on rows that it has not seen, and the saved pipeline says the same."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    df, names = rings(spark), ["x", "z"]
    train, test = prep.train_test_split(df, "Target", "ID")
    own, held = models.vectors(train, names, "Target", ["ID"]), models.vectors(test, names, "Target", ["ID"])
    auc = lambda m: models.scored_auc(m.scores(held).select(F.lit("m").alias("model"), F.col("label").alias("y"), "p"), 2).first()["auc"]
    kernel, line = models.fit(own, "svc", {"kernel": "rbf", "regParam": 0.001}, 2, 2), models.fit(own, "svc", {"kernel": "linear", "regParam": 0.001}, 2, 2)
    assert auc(kernel) > 0.95 and 0.3 < auc(line) < 0.7
    models.save({"SVC": kernel}, {n: f"CAST({n} AS DOUBLE)" for n in names}, str(tmp_path))
    both = PipelineModel.load(str(tmp_path / "SVC")).transform(test).select("ID", vector_to_array("p").alias("q")).join(kernel.scores(held), "ID")
    assert both.count() == test.count() and both.filter(F.abs(F.col("p")[1] - F.col("q")[1]) > 1e-9).count() == 0
    # Labels that a third of the time say nothing: scores of unseen rows are no surer than that.
    coin = df.withColumn("Target", F.when(F.col("ID") % 3 == 0, F.pmod(F.xxhash64("ID"), F.lit(2))).otherwise(F.col("Target")))
    train, test = prep.train_test_split(coin, "Target", "ID")
    model = models.fit(models.vectors(train, names, "Target", ["ID"]), "svc", {"kernel": "rbf", "regParam": 0.001}, 2, 2)
    said = model.scores(models.vectors(test, names, "Target", ["ID"])).groupBy((F.col("p")[1] > 0.5).alias("high")).agg(F.avg(F.col("p")[1]).alias("p"), F.avg("label").alias("y")).collect()
    assert len(said) == 2 and all(abs(r["p"] - r["y"]) < 0.12 for r in said)


@pytest.mark.parametrize("k", [2, 3])
def test_steps_by_batches_come_to_the_optimum(spark, rows, tmp_path, k):
    """The loss's slope is that of differences; the averaged weights' objective is near the least one; a strong L1 part leaves no weight; the saved pipeline agrees."""
    import numpy as np
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from tabwarden.operators import margins

    at, side = np.linspace(-3, 3, 61) + 0.013, np.where(np.arange(61) % 2, 1.0, -1.0)
    slope = (margins.huber_loss(at + 1e-6, side) - margins.huber_loss(at - 1e-6, side)) / 2e-6
    assert abs(margins.huber_slope(at, side) - slope).max() < 1e-4
    names, target = ["x", "z", "noise"], "Target" if k == 2 else "c"
    noisy = rows.withColumn(target, F.when(F.col("ID") % 5 == 0, F.pmod(F.xxhash64("ID"), F.lit(k))).otherwise(F.col(target))).cache()
    ready = models.vectors(noisy, names, target, ["ID"])
    model = margins.fit_by_batches(ready, k, 3, 0.01, 0.0)
    data = noisy.select(*names, target).toPandas().to_numpy()
    x, y = data[:, :3].astype(float), data[:, 3].astype(int)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for o in range(1 if k == 2 else 3):
        side = np.where(y == (1 if k == 2 else o), 1.0, -1.0)
        worth = lambda w, b, side=side: margins.huber_loss(z @ w + b, side).mean() + 0.005 * (w**2).sum()
        w, b = np.zeros(3), 0.0
        for _ in range(5000):  # plain descent to the optimum
            r = margins.huber_slope(z @ w + b, side)
            w, b = w - 0.05 * (z.T @ r / len(z) + 0.01 * w), b - 0.05 * r.mean()
        got = model.weights[o] * x.std(axis=0), model.intercepts[o] + model.weights[o] @ x.mean(axis=0)
        assert worth(w, b) - 1e-9 <= worth(*got) <= worth(w, b) * 1.01 + 0.002
    assert not margins.fit_by_batches(ready, k, 3, 50.0, 1.0, epochs=2).weights.any()
    fitted = models.Fitted([model], [None], k)
    models.save({"SGD": fitted}, {n: f"CAST({n} AS DOUBLE)" for n in names}, str(tmp_path))
    both = PipelineModel.load(str(tmp_path / "SGD")).transform(noisy).select("ID", vector_to_array("p").alias("q")).join(fitted.scores(ready), "ID")
    assert both.count() == 240 and both.filter(F.exists(F.arrays_zip("p", "q"), lambda v: F.abs(v["p"] - v["q"]) > 1e-12)).count() == 0


@pytest.mark.parametrize("k", [2, 3])
def test_boosting_is_as_good_as_the_library_and_its_margins_are_explained(spark, rows, tmp_path, k):
    """Held-out log loss is not above that of first-order trees of the same size; trees as SQL, as leaves and as a saved pipeline say the same."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    from tabwarden.operators import boosting

    names, target = ["x", "z", "noise"], "Target" if k == 2 else "c"
    u = lambda i: F.pmod(F.xxhash64("ID", F.lit(i)), F.lit(1000)) / 1000.0
    many = spark.range(4000).select(F.col("id").alias("ID")).withColumn("c", F.pmod(F.xxhash64("ID", F.lit(9)), F.lit(3)))
    many = many.select("ID", "c", (F.col("c") > 0).cast("long").alias("Target"), (F.col("c") + 1.5 * u(0)).alias("x"), (F.col("c") * 0.5 + u(1)).alias("z"), u(2).alias("noise"))
    noisy = many.withColumn(target, F.when(F.col("ID") % 7 == 0, F.pmod(F.xxhash64("ID"), F.lit(k))).otherwise(F.col(target))).cache()
    ready = models.vectors(noisy, names, target, ["ID"]).withColumn("part", F.pmod(F.xxhash64("ID", F.lit(5)), F.lit(4)))
    own, held = ready.filter("part > 0"), ready.filter("part = 0")
    model = models.fit(own, "boosted", {"maxIter": 12, "maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 0.9, "columnRate": 0.9}, k, 3)
    assert len(model.models) == 1 and len(model.models[0].trees) == 12 and len(model.models[0].trees[0]) == (1 if k == 2 else 3)
    loss = lambda p: p.select((-F.ln(F.get("p", F.col("label").cast("int")))).alias("l")).agg(F.avg("l")).first()[0]
    each = []
    for c in [1] if k == 2 else range(k):
        one = own.withColumn("label", (F.col("label") == c).cast("double"))
        each.append(GBTClassifier(seed=3, maxIter=12, maxDepth=3, stepSize=0.3).fit(one))
    if k == 2:
        library = each[0].transform(held).select("label", vector_to_array("probability").alias("p"))
    else:
        library = held
        for c, m in enumerate(each):
            library = m.transform(library, {m.probabilityCol: f"q{c}", m.rawPredictionCol: f"r{c}", m.predictionCol: f"l{c}"})
        total = sum((vector_to_array(f"q{c}")[1] for c in range(k)), F.lit(0.0))
        library = library.select("label", F.array(*[vector_to_array(f"q{c}")[1] / total for c in range(k)]).alias("p"))
    assert loss(model.scores(held)) <= loss(library) + 0.005
    # Values by leaves add up to the margins.
    few = noisy.filter("ID < 20")
    scored, _ = model.scored(models.vectors(few, names, target, ["ID"]), "features", "t")
    said = {r["ID"]: [r[f"_mt{c}"] for c in range(1 if k == 2 else k)] for r in scored.collect()}
    sums = {(r["id"], r["class"]): r["s"] for r in explain.of_trees(model.models, few, "ID", names).groupBy("id", "class").agg(F.sum("shap").alias("s")).collect()}
    for o in range(1 if k == 2 else k):
        mean = sum(m[o] for m in said.values()) / len(said)
        assert all(sums[i, 1 if k == 2 else o] == pytest.approx(m[o] - mean, abs=1e-9) for i, m in said.items())
    models.save({"XGBoost": model}, {n: f"CAST({n} AS DOUBLE)" for n in names}, str(tmp_path))
    from pyspark.ml import PipelineModel

    both = PipelineModel.load(str(tmp_path / "XGBoost")).transform(few).select("ID", vector_to_array("p").alias("q")).join(model.scores(models.vectors(few, names, target, ["ID"])), "ID")
    assert both.count() == 20 and both.filter(F.exists(F.arrays_zip("p", "q"), lambda z: F.abs(z["p"] - z["q"]) > 1e-12)).count() == 0
    with pytest.raises(ValueError):
        boosting.fit_boosted(own, k, 3, depth=30)


def test_boosting_stores_margins_anew_without_changing_the_model(rows, monkeypatch):
    """Whenever margins are stored anew, the trees are the same; a class weight moves scores up."""
    from tabwarden.operators import boosting

    ready = models.vectors(rows, ["x", "z", "noise"], "Target", ["ID"])
    one = boosting.fit_boosted(ready, 2, 3, rounds=5, depth=2)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    two = boosting.fit_boosted(ready, 2, 3, rounds=5, depth=2)
    assert [(t[0].feature, t[0].threshold) for t in one.trees] == [(t[0].feature, t[0].threshold) for t in two.trees]
    assert all(t[0].value == pytest.approx(u[0].value) for t, u in zip(one.trees, two.trees))
    heavy = boosting.fit_boosted(ready, 2, 3, rounds=1, depth=1, positive=5.0)
    assert max(heavy.trees[0][0].value) > max(one.trees[0][0].value)


def test_linear_shap_adds_up(rows):
    weights = {"x": 0.5, "z": -2.0}
    total = explain.linear_shap(rows, "ID", weights).groupBy("id").agg(F.sum("shap").alias("s"))
    means = rows.agg(F.avg("x"), F.avg("z")).first()
    both = total.join(rows, total["id"] == rows["ID"]).withColumn("e", 0.5 * (F.col("x") - means[0]) - 2.0 * (F.col("z") - means[1]))
    assert both.filter(F.abs(F.col("s") - F.col("e")) > 1e-9).count() == 0


def test_exact_shapley_adds_up(rows):
    ready = models.vectors(rows, ["x", "z", "noise"], "Target")
    from pyspark.ml.classification import DecisionTreeClassifier

    model = DecisionTreeClassifier(maxDepth=4).fit(ready)
    few = prep.stratified_sample(rows, "Target", "ID", 9)
    got = explain.exact_shapley(few, "ID", ["x", "z", "noise"], explain.probability(model)).groupBy("id", "class").agg(F.sum("shap").alias("s"))
    from pyspark.ml.functions import vector_to_array

    p = model.transform(models.vectors(few, ["x", "z", "noise"], "Target", ["ID"])).select("ID", F.posexplode(vector_to_array("probability")).alias("class", "p"))
    mean = {r["class"]: r["m"] for r in p.groupBy("class").agg(F.avg("p").alias("m")).collect()}
    want = {(r["ID"], r["class"]): r["p"] - mean[r["class"]] for r in p.collect()}
    for r in got.collect():
        assert r["s"] == pytest.approx(want[r["id"], r["class"]], abs=1e-9)
    with pytest.raises(ValueError):
        explain.exact_shapley(few, "ID", ["x"] * 13, explain.probability(model))


def test_kernel_regression_equals_all_coalitions_and_states_its_error(rows):
    """Exact with all coalitions; with drawn ones near the exact values by the stated error, and adding up in either case."""
    from pyspark.ml.classification import RandomForestClassifier

    names = ["x", "z", "noise", "twin"]
    model = RandomForestClassifier(seed=3, numTrees=5).fit(models.vectors(rows, names, "c"))
    few, base = rows.filter("ID % 60 = 7"), rows.filter("ID % 40 = 3")
    predict = explain.probability(model)
    exact = {(r["id"], r["class"], r["feature"]): r["shap"] for r in explain.exact_shapley(few, "ID", names, predict, base).collect()}
    got = explain.kernel_shapley(few, "ID", names, predict, base).collect()
    assert len(got) == len(exact) == 4 * 3 * 4
    assert all(r["error"] == 0 and r["shap"] == pytest.approx(exact[r["id"], r["class"], r["feature"]], abs=1e-9) for r in got)
    df, names = many_features(rows, 13)
    model = RandomForestClassifier(seed=3, numTrees=3, maxDepth=4).fit(models.vectors(df, names, "Target"))
    few, base = df.filter("ID % 120 = 7"), df.filter("ID % 80 = 3")
    exact = {(r["id"], r["class"], r["feature"]): r["shap"] for r in explain.of_trees([model], few, "ID", names, base).collect()}
    drawn = explain.kernel_shapley(few, "ID", names, explain.probability(model), base, 400).collect()
    assert len(drawn) == len(exact) and max(r["error"] for r in drawn) > 0
    for r in drawn:
        assert abs(r["shap"] - exact[r["id"], r["class"], r["feature"]]) <= 5 * r["error"] + 0.01
    for i, c in {(r["id"], r["class"]) for r in drawn}:
        assert sum(r["shap"] for r in drawn if (r["id"], r["class"]) == (i, c)) == pytest.approx(sum(v for k, v in exact.items() if k[:2] == (i, c)), abs=1e-9)


def many_features(rows, d):
    return rows.select("ID", "Target", "c", *[(F.col("x") * (i % 3) + F.pmod(F.xxhash64("ID", F.lit(i)), F.lit(100)) / 50.0).alias(f"g{i}") for i in range(d)]), [f"g{i}" for i in range(d)]


def test_tree_values_equal_all_coalitions(rows):
    """Of a forest over ten features, three classes; the values by leaves are those by enumeration."""
    from pyspark.ml.classification import RandomForestClassifier

    df, names = many_features(rows, 10)
    model = RandomForestClassifier(seed=3, numTrees=4, maxDepth=5).fit(models.vectors(df, names, "c"))
    few, base = df.filter("ID % 60 = 7"), df.filter("ID % 40 = 3")
    exact = {(r["id"], r["class"], r["feature"]): (r["value"], r["shap"]) for r in explain.exact_shapley(few, "ID", names, explain.probability(model), base).collect()}
    got = {(r["id"], r["class"], r["feature"]): (r["value"], r["shap"]) for r in explain.of_trees([model], few, "ID", names, base).collect()}
    assert got.keys() == exact.keys() and len(got) == 4 * 3 * 10
    for k, (value, shap) in got.items():
        assert value == exact[k][0] and shap == pytest.approx(exact[k][1], abs=1e-9)


def test_tree_values_of_many_features_add_up(rows):
    """Of boosted trees over sixty features, in the margin: each row's values add up to its margin less the background's mean. All rows are explained."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    df, names = many_features(rows, 60)
    model = GBTClassifier(seed=3, maxIter=4, maxDepth=4).fit(models.vectors(df, names, "Target"))
    base = df.filter("ID % 3 = 1")
    margin = lambda d: model.transform(models.vectors(d, names, "Target", ["ID"])).select("ID", vector_to_array("rawPrediction")[1].alias("m"))
    mean = margin(base).agg(F.avg("m")).first()[0]
    sums = explain.of_trees([model], df, "ID", names, base).groupBy(F.col("id").alias("ID")).agg(F.sum("shap").alias("s"), F.count("*").alias("n")).join(margin(df), "ID").collect()
    assert len(sums) == 240 and all(r["n"] == 60 and r["s"] == pytest.approx(r["m"] - mean, abs=1e-9) for r in sums)
    with pytest.raises(ValueError):
        explain.of_trees([model], df, "ID", names, df)


def test_leaves_have_an_interval_for_each_feature(spark):
    from tabwarden.operators import trees

    leaves = trees.leaves_of([(1, 5.0, (1, 2.0, [1.0], (0, 0.0, [2.0], [3.0])), (1, 4.0, [4.0], [5.0]))])
    assert [x[1] for x in leaves] == [[(1, None, 2.0)], [(0, None, 0.0), (1, 2.0, 5.0)], [(0, 0.0, None), (1, 2.0, 5.0)], [(1, 5.0, 4.0)], [(1, 5.0, None)]]
    df = spark.createDataFrame([(1, float("nan"), 1.0), (2, None, 9.0)], "k long, a double, b double")
    got = trees.tree_shap(df, "k", ["a", "b"], trees.leaf_table(spark, [(0, 0.0, [1.0], [2.0])]), df.filter("k = 1")).collect()
    assert {(r["id"], r["feature"], r["shap"]) for r in got} == {(1, "a", 0.0), (1, "b", 0.0), (2, "a", -2.0), (2, "b", 0.0)}  # a null is in no interval


def test_maps_side_by_side(rows):
    """Rows get closer to their units as the maps' bell curves narrow, but for a fiftieth between two epochs; a map's indices are those of C2 and of the library over its labels; all sizes cost the passes of one."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    names, ks = ["x", "z", "noise"], [2, 3, 7]
    data, scale = clusters.blocks_of(rows, names)
    maps, errors = clusters.batch_maps(data, scale, ks)
    assert (errors[1:] <= errors[:-1] * 1.02).all() and (errors[-1] < 0.8 * errors[0]).all(), errors
    alone, _ = clusters.batch_maps(data, scale, [3])
    assert abs(alone[0].units - maps[1].units).max() < 1e-12
    db, silhouette = (clusters.judged(data, scale, maps, by) for by in ("davies_bouldin", "silhouette"))
    for i, m in enumerate(maps):
        labelled = clusters.placed(rows, names, m, scale).cache()
        assert labelled.filter("cluster >= " + str(len(m.units))).count() == 0
        assert db[i] == pytest.approx(clusters.davies_bouldin(labelled, "cluster", names).first()["index"])
        vectors = models.vectors(labelled, names, "Target", ["cluster"])
        assert silhouette[i] == pytest.approx(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(vectors.withColumn("cluster", F.col("cluster").cast("double"))))
    n, chosen = clusters.choose_clusters(rows, names, range(2, 8), "silhouette")
    assert n == chosen.select("cluster").distinct().count() and chosen.columns == [*rows.columns, "cluster"]
    dotted = rows.withColumnRenamed("x", "x.y")
    assert clusters.davies_bouldin(dotted, "Target", ["x.y"]).first()["index"] > 0
    with pytest.raises(ValueError):
        clusters.choose_clusters(rows.withColumn("one", F.lit(1.0)), ["one"], range(2, 4))


def test_clusters(rows):
    n, placed = clusters.choose_clusters(rows, ["x", "z"], range(2, 4))
    assert n in (2, 3) and placed.count() == 240
    assert clusters.davies_bouldin(rows.withColumn("one", F.lit(1)), "one", ["x"]).first()["index"] is None


def test_csv(spark, tmp_path):
    (tmp_path / "Train.csv").write_text("ID,a,b,d,Target\n1,1,x,2020-01-01,0\n2,NA,NA,2020-01-02,1\n3,2.5,z,,1\n")
    df = tables.read_table(spark, str(tmp_path / "Train.csv"))
    assert dict(df.dtypes) == {"ID": "bigint", "a": "double", "b": "string", "d": "string", "Target": "bigint"}
    assert df.filter("a is null and b is null").count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_pair(spark, str(tmp_path))
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.doc")


def test_config(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(
        "BiasAssessment: true\nFeature: sex\nnumber_of_k_folds: 3\napply_grid_search:\n  enabled: true\n  type:\n    Randomized: true\n    Exhaustive: false\n"
        "Correlation Limit: 0.6\nMetric For Threshold Optimization: F1-Score\nMachine Learning Models:\n  SVC: true\n  MLP: false\n"
    )
    c = tables.read_config(spark, str(tmp_path / "c.yaml"))
    assert c == tables.Config(True, "sex", 3, "randomized", 0.6, "f1", ("SVC",))
    (tmp_path / "d.yaml").write_text("Target: sick\nLabel: 2\nSubgroup: ward\nKey: who\nSelector: RFE\nFeature: None\n")
    assert tables.read_config(spark, str(tmp_path / "d.yaml")) == tables.Config(target="sick", label=2, subgroup="ward", key="who", selector="rfe")
    (tmp_path / "e.yaml").write_text("Selector: None\n")
    assert tables.read_config(spark, str(tmp_path / "e.yaml")) == tables.Config(selector=None)
    (tmp_path / "f.yaml").write_text("Selector: guess\n")
    with pytest.raises(ValueError):
        tables.read_config(spark, str(tmp_path / "f.yaml"))


def test_a_run_that_cannot_go_on_says_so(spark, rows, tmp_path):
    """A missing target, or no files at all, is a row of the error table."""
    from tabwarden.plans.run import run

    os.makedirs(tmp_path / "in")
    for name in ("Train", "Test"):
        rows.select("ID", "x").limit(5).toPandas().to_csv(tmp_path / "in" / f"{name}.csv", index=False)
    for folder in ("in", "nowhere"):
        run(spark, str(tmp_path / folder), tables.Config(selector=None), str(tmp_path / "out"))
        found = spark.read.parquet(f"{tmp_path}/out/Errors").collect()
        assert len(found) == 1 and found[0]["stage"] == "run" and found[0]["error"]


@pytest.mark.parametrize("k", [2, 3])
def test_whole_run(spark, rows, tmp_path, monkeypatch, k):
    from pyspark.ml import PipelineModel

    from tabwarden.plans.run import run

    os.makedirs(tmp_path / "in")
    df = rows.withColumn("Target", F.col("Target") if k == 2 else F.col("c")).drop("c").withColumn("kind.of", F.when(F.col("ID") % 2 == 0, "it's").otherwise("b")).withColumnRenamed("noise", "no.ise")
    train, test = prep.train_test_split(df, "Target", "ID")
    for name, part in (("Train", train), ("Test", test)):
        part.toPandas().to_csv(tmp_path / "in" / f"{name}.csv", index=False)
    out = str(tmp_path / "out")
    monkeypatch.setattr(explain, "TREE_ROWS", 10)
    monkeypatch.setattr(explain, "KERNEL_ROWS", 6)
    chosen, selector = (("Logistic Regression", "Decision Tree"), "featurewiz") if k == 2 else (("SVC",), None)
    run(spark, str(tmp_path / "in"), tables.Config(bias_assessment=True, feature="Target", folds=2, selector=selector, correlation_limit=0.6, models=chosen), out)
    said = lambda name: spark.read.parquet(f"{out}/{name}")
    for name in ("BiasAssessment/Train", "BiasAssessment/Test", "ClassProfile", "FoldScores", "FoldMetrics", "Thresholds", "2_fold_results"):
        assert said(name).count() > 0, name
    assert said("Errors").count() == 0
    assert all(r["auc"] > 0.8 for r in said("test_results").collect()) and said("test_results").count() == len(chosen)
    for part, n in (("Folds", train.count()), ("Test", test.count())):
        assert {r["n"] for r in said(f"Confusion/{part}").groupBy("model").agg(F.sum("n").alias("n")).collect()} == {n}
        assert said(f"Curves/{part}/Areas").count() > 0 and {0.0, 1.0} <= {r["fpr"] for r in said(f"Curves/{part}/Roc").collect()}
        assert said(f"Curves/{part}/PrecisionRecall").filter("recall = 1").count() > 0
    for m in chosen:
        place = f"Explanation/{m.replace(' ', '_')}"
        values, scored = said(f"{place}/Values"), said("TestScores").filter(F.col("model") == m).select(F.col("id").alias("key"), "p")
        assert values.filter("error > 0").count() == 0 and said(f"{place}/Importance").count() == values.select("feature").distinct().count()
        assert said(f"{place}/TellingClass").count() == 1 and said(f"{place}/Beeswarm").count() > 0 and said(f"{place}/ClassImportance").count() > 0
        model = PipelineModel.load(f"{out}/Models/{m.replace(' ', '_')}")
        from pyspark.ml.functions import vector_to_array

        raw = test.select("ID", "x", "z", "twin", "`no.ise`", "`kind.of`")
        both = model.transform(raw).select("ID", vector_to_array("p").alias("q")).join(scored, F.col("ID") == F.col("key"))
        assert both.count() == test.count() and both.filter(F.abs(F.col("p")[1] - F.col("q")[1]) > 1e-9).count() == 0


@pytest.mark.parametrize("case", ["no key", "text key", "key of its own"])
def test_run_over_any_key(spark, rows, tmp_path, case):
    """Tables without a key, with a text key, and with a configured text key beside a numeric ID: the run ends, and no key is a feature."""
    from tabwarden.plans.run import run

    os.makedirs(tmp_path / "in")
    train, test = prep.train_test_split(rows.select("ID", "Target", "x", "z"), "Target", "ID")
    for name, part in (("Train", train), ("Test", test)):
        told = {"no key": part.drop("ID"), "text key": part.withColumn("ID", F.concat(F.lit("P"), "ID")), "key of its own": part.withColumn("who", F.concat(F.lit("W"), "ID"))}[case]
        told.toPandas().to_csv(tmp_path / "in" / f"{name}.csv", index=False)
    out = str(tmp_path / "out")
    run(spark, str(tmp_path / "in"), tables.Config(folds=2, selector=None, key="who" if case == "key of its own" else None), out)
    said = lambda name: spark.read.parquet(f"{out}/{name}")
    assert said("Errors").count() == 0 and said("TestScores").count() == test.count() and said("FoldScores").count() == train.count()
    assert said("FoldScores").select("id").distinct().count() == train.count()
    assert {r["feature"] for r in said("Explanation/Logistic_Regression/Importance").collect()} == {"x", "z"}


def test_failures_are_rows_of_the_error_table(spark, rows, tmp_path, monkeypatch):
    from tabwarden.plans.run import run

    os.makedirs(tmp_path / "in")
    train, test = prep.train_test_split(rows.drop("c"), "Target", "ID")
    for name, part in (("Train", train), ("Test", test)):
        part.toPandas().to_csv(tmp_path / "in" / f"{name}.csv", index=False)

    def broken(*a, **b):
        raise RuntimeError("no fit today")

    monkeypatch.setattr(models, "fit", broken)
    out = str(tmp_path / "out")
    run(spark, str(tmp_path / "in"), tables.Config(folds=2, selector=None), out)
    found = {(r["stage"], r["model"], r["fold"]) for r in spark.read.parquet(f"{out}/Errors").collect()}
    assert {("cross-validation", "Logistic Regression", 0), ("cross-validation", "Logistic Regression", 1), ("hold-out", "Logistic Regression", -1)} <= found
    assert spark.read.parquet(f"{out}/FoldScores").count() == 0


def test_sampled_values_are_near_the_exact_ones_and_add_up(spark, rows):
    from pyspark.ml.classification import RandomForestClassifier

    names = ["x", "z", "noise", "twin"]
    model = RandomForestClassifier(seed=3, numTrees=5).fit(models.vectors(rows, names, "Target"))
    few = prep.stratified_sample(rows, "Target", "ID", 8)
    predict = explain.probability(model)
    exact = {(r["id"], r["class"], r["feature"]): r["shap"] for r in explain.exact_shapley(few, "ID", names, predict).collect()}
    got = explain.sampled_shapley(few, "ID", names, predict, orders=256).collect()
    assert len(got) == len(exact)
    for r in got:
        assert abs(r["shap"] - exact[r["id"], r["class"], r["feature"]]) <= 5 * r["error"] + 0.02
    with pytest.raises(ValueError):
        explain.exact_shapley(rows.limit(5), "ID", names, predict, rows)  # a background beyond the bound is refused, never cut


def test_json_by_line_and_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1, "s": "NA"}\n{"x": 2, "s": "b"}\n')
    (tmp_path / "b.json").write_text('[\n {"x": 1, "s": "NA"},\n {"x": 2, "s": "b"}\n]\n')
    for name in ("a", "b"):
        assert sorted((r["x"], r["s"]) for r in tables.read_table(spark, str(tmp_path / f"{name}.json")).collect()) == [(1, None), (2, "b")]


def test_registered_queries_keep_the_operators_sizes(spark, monkeypatch):
    """The queries choose, search and explain over all that the operators do by themselves."""
    import inspect

    from tabwarden.plans import frames, queries

    class Asked(Exception):
        pass

    def asked(module, name, query):
        own = getattr(module, name)

        def told(*a, **b):
            said = inspect.signature(own).bind(*a, **b)
            said.apply_defaults()
            raise Asked(said.arguments)

        with monkeypatch.context() as m:
            m.setattr(module, name, told)
            with pytest.raises(Asked) as found:
                queries.QUERIES[query](spark, "/root/testdata/sf0.001")
        return found.value.args[0]

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    for query, by in (("c3_choose_clusters", "davies_bouldin"), ("c4_choose_silhouette", "silhouette")):
        said = asked(clusters, "choose_clusters", query)
        assert said["ks"] == range(2, 31) and said["features"] == frames.FEATURES and said["by"] == by
    said = asked(models, "search", "t3_random_search")
    assert said["most"] is None and said["folds"] == 3 and said["how"] == "randomized"
    assert explain.TREE_ROWS in asked(prep, "stratified_sample", "x5_x6_exact_shapley").values()

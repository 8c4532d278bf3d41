"""Bias audit of an outcome over the values of a facet.

Everything but two regressions is computed from one contingency table (scope, subgroup, facet, outcome, n), long and small; its
partial counts are the only thing that is shuffled from the rows. An audit stores it first, so the rows are read once for all metrics. A scope is the whole table, or a cluster. Where a
metric is not defined it is null by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import count_where, named, ratio
from ..functions.store import stored

#: Fair bands of the metrics for display, and the bounds beyond which a metric is called biased (fixed values).
BANDS = {"BR": (0.8, 1.25), "LR": (-2.0, 2.0), "LR_intercept": (-2.0, 2.0)}
DEFAULT_BAND = (-0.1, 0.1)
BOUNDS = {"CI": 0.9, "DPL": 0.1, "DD": 0.1, "CDD": 0.1, "JS": 0.1, "L2": 0.1, "TVD": 0.1, "KS": 0.1}
#: What a probability of zero counts as below a fraction.
TINY = 1e-10
#: Cells of a contingency table that one task may hold.
FEW_CELLS = 100_000
METRICS = ("CI", "DPL", "DD", "CDD", "JS", "L2", "TVD", "KS", "NMI", "NCMI", "BR", "BD", "CBD", "CORR", "V")


def contingency(df: DataFrame, facet: str, outcome: str, subgroup: str | None = None, scope: Column | None = None) -> DataFrame:
    """(scope, s, a, y, n) without rows in which facet, outcome or subgroup is null."""
    chosen = df.select(
        (F.lit("Overall") if scope is None else scope.cast("string")).alias("scope"),
        (F.lit(None).cast("string") if subgroup is None else named(subgroup).cast("string")).alias("s"),
        named(facet).alias("a"), named(outcome).alias("y"),
    ).filter("a is not null and y is not null" + ("" if subgroup is None else " and s is not null"))
    return chosen.groupBy("scope", "s", "a", "y").agg(F.count("*").alias("n"))


def by_cell(ct: DataFrame) -> DataFrame:
    """The table without subgroups."""
    return ct.groupBy("scope", "a", "y").agg(F.sum("n").alias("n"))


def over(*by: str) -> Window:
    return Window.partitionBy("scope", *by)


def densified(ct: DataFrame, by: list[str]) -> DataFrame:
    """Each combination of `by` with each outcome of its scope; cells without rows have n = 0."""
    cells = ct.groupBy("scope", *by, "y").agg(F.sum("n").alias("n"))
    outcomes = cells.select("scope", "y").distinct().groupBy("scope").agg(F.collect_set("y").alias("_ys"))  # as many values as classes
    grid = cells.select("scope", *by).distinct().join(outcomes, "scope").select("scope", *by, F.explode("_ys").alias("y"))
    return grid.join(cells, ["scope", *by, "y"], "left").select("scope", *by, "y", F.coalesce("n", F.lit(0)).alias("n"))


def value(df: DataFrame, name: str, of: Column) -> DataFrame:
    return df.select("scope", F.lit(name).alias("metric"), of.cast("double").alias("value"))


def class_imbalance(ct: DataFrame) -> DataFrame:
    """Greatest less least share of a facet value."""
    a = ct.groupBy("scope", "a").agg(F.sum("n").alias("n")).groupBy("scope")
    return value(a.agg(ratio(F.max("n") - F.min("n"), F.sum("n")).alias("v")), "CI", F.col("v"))


def rates(ct: DataFrame, label) -> DataFrame:
    """Rows and rows with outcome `label` of facets 1 and 0."""
    hit = F.col("y") == F.lit(label)
    one, zero = F.col("a") == 1, F.col("a") == 0
    return ct.groupBy("scope").agg(
        count_where(one, F.col("n")).alias("n1"), count_where(zero, F.col("n")).alias("n0"),
        count_where(one & hit, F.col("n")).alias("p1"), count_where(zero & hit, F.col("n")).alias("p0"),
    )


def label_difference(ct: DataFrame, label=1) -> DataFrame:
    """Share of outcome `label` in facet 1 less that in facet 0."""
    return value(rates(ct, label), "DPL", ratio(F.col("p1"), F.col("n1")) - ratio(F.col("p0"), F.col("n0")))


def label_difference_by_rank(ct: DataFrame, label=1) -> DataFrame:
    """A compatibility value: facets ranked by their rows and, separately, by their rows with the label; second less first.

    Null unless facets 1 and 0 occur and two facets have the label. Ties go to the smaller facet value.
    """
    a = ct.groupBy("scope", "a").agg(F.sum("n").alias("n"), count_where(F.col("y") == F.lit(label), F.col("n")).alias("p"))
    place = lambda c: F.row_number().over(over().orderBy(F.col(c).desc(), "a"))
    at = lambda r, c: F.max(F.when(F.col(f"r{c}") == r, F.col(c)))
    wide = a.select("*", place("n").alias("rn"), place("p").alias("rp")).groupBy("scope").agg(
        at(1, "n").alias("n1"), at(2, "n").alias("n2"), at(1, "p").alias("p1"), at(2, "p").alias("p2"),
        count_where(F.col("a").isin(0, 1)).alias("both"),
    )
    found = ratio(F.col("p2"), F.col("n2")) - ratio(F.col("p1"), F.col("n1"))
    return value(wide, "DPL_rank", F.when((F.col("both") == 2) & (F.col("p2") > 0), found))


def disparity_table(ct: DataFrame) -> DataFrame:
    """(scope, a, y, d): p(y | a) - p(y)."""
    n = F.col("n")
    return densified(ct, ["a"]).select(
        "scope", "a", "y",
        (ratio(n, F.sum(n).over(over("a"))) - ratio(F.sum(n).over(over("y")), F.sum(n).over(over()))).alias("d"),
    )


def mean_of_cells(table: DataFrame, name: str, keep: Column | None = None) -> DataFrame:
    """Mean over outcomes of the means over rows, which is 0 but for rounding, and the greatest absolute cell."""
    means = table.groupBy("scope", "y").agg(F.avg("d").alias("m"), F.max(F.abs("d")).alias("x"), F.max("groups").alias("groups"))
    one = means.groupBy("scope").agg(F.avg("m").alias("m"), F.max("x").alias("x"), F.count("*").alias("outcomes"), F.max("groups").alias("groups"))
    ok = F.lit(True) if keep is None else keep
    return value(one, name, F.when(ok, F.col("m"))).unionByName(value(one, f"{name}_max", F.when(ok, F.col("x"))))


def demographic_disparity(ct: DataFrame) -> DataFrame:
    return mean_of_cells(disparity_table(ct).withColumn("groups", F.lit(1)), "DD")


def conditional_table(ct: DataFrame) -> DataFrame:
    """(scope, s, a, y, d): (p(y | s, a) - p(y)) n(s) / N."""
    n = F.col("n")
    grid = densified(ct, ["s", "a"])
    d = (ratio(n, F.sum(n).over(over("s", "a"))) - ratio(F.sum(n).over(over("y")), F.sum(n).over(over()))) * ratio(F.sum(n).over(over("s")), F.sum(n).over(over()))
    return grid.select("scope", "s", "a", "y", d.alias("d"))


def conditional_disparity(ct: DataFrame) -> DataFrame:
    """Null unless there are two subgroups or more and just two outcomes."""
    groups = ct.groupBy("scope").agg(F.count_distinct("s").alias("groups"))
    return mean_of_cells(conditional_table(ct).join(groups, "scope"), "CDD", (F.col("groups") >= 2) & (F.col("outcomes") == 2))


def conditional_pmf(ct: DataFrame) -> DataFrame:
    """(scope, a, y, p): p(y | a), zero where a cell has no rows."""
    return densified(ct, ["a"]).select("scope", "a", "y", ratio(F.col("n"), F.sum("n").over(over("a"))).alias("p"))


def two_pmfs(ct: DataFrame) -> DataFrame:
    """(scope, y, p1, p0): p(y | a = 1) and p(y | a = 0); scopes in which both facets occur."""
    n = by_cell(ct).groupBy("scope", "y").agg(count_where(F.col("a") == 1, F.col("n")).alias("n1"), count_where(F.col("a") == 0, F.col("n")).alias("n0"))
    share = lambda c: ratio(F.col(c), F.sum(c).over(over()))
    return n.select("scope", "y", share("n1").alias("p1"), share("n0").alias("p0")).filter("p1 is not null and p0 is not null")


def kl_term(p: Column, q: Column) -> Column:
    """p ln(p / q), 0 where p is, with q of zero as TINY."""
    return F.when(p > 0, p * F.ln(p / F.when(q > 0, q).otherwise(TINY))).otherwise(0.0)


def kl_divergence(ct: DataFrame) -> DataFrame:
    """Of facet 1's outcomes from facet 0's, in nats."""
    return value(two_pmfs(ct).groupBy("scope").agg(F.sum(kl_term(F.col("p1"), F.col("p0"))).alias("v")), "KL", F.col("v"))


def pmf_distances(ct: DataFrame) -> DataFrame:
    """JS (the divergence in nats), L2 and KS (the greatest difference of the two distributions), one pass."""
    p, q = F.col("p1"), F.col("p0")
    m = (p + q) / 2
    one = two_pmfs(ct).groupBy("scope").agg(
        F.sum((kl_term(p, m) + kl_term(q, m)) / 2).alias("js"), F.sqrt(F.sum((p - q) * (p - q))).alias("l2"), F.max(F.abs(p - q)).alias("ks"),
    )
    return reduce(DataFrame.unionByName, [value(one, "JS", F.col("js")), value(one, "L2", F.col("l2")), value(one, "KS", F.col("ks"))])


def total_variation(ct: DataFrame) -> DataFrame:
    """Mean over unordered pairs of facet values of half the summed absolute differences; null for a single value.

    The pairs of facet values are what the metric is over: as many as values of a categorical column allow.
    """
    x = conditional_pmf(ct)
    y = x.select("scope", F.col("a").alias("b"), "y", F.col("p").alias("q"))
    pairs = x.join(y, ["scope", "y"]).filter("a < b").groupBy("scope", "a", "b").agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("d"))
    return value(pairs.groupBy("scope").agg(F.avg("d").alias("v")), "TVD", F.col("v"))


def information(n: Column, row: Column, column: Column, total: Column) -> Column:
    """A cell's part of the mutual information of rows and columns, in nats."""
    return ratio(n, total) * F.ln(n.cast("double") * total / (row.cast("double") * column))


def normalised_information(ct: DataFrame) -> DataFrame:
    """Mutual information over the mean of the entropies; 1 where both are constant, 0 where there is no information."""
    n = F.col("n")
    cells = by_cell(ct).select(
        "scope", "a", "y", "n", F.sum(n).over(over("a")).alias("na"), F.sum(n).over(over("y")).alias("ny"), F.sum(n).over(over()).alias("t"),
    )
    part = lambda c: -ratio(n, F.col("t")) * F.ln(ratio(F.col(c), F.col("t")))  # noqa: E731  each cell's part of an entropy
    one = cells.groupBy("scope").agg(F.sum(information(n, F.col("na"), F.col("ny"), F.col("t"))).alias("mi"), F.sum(part("na")).alias("ha"), F.sum(part("ny")).alias("hy"))
    h = (F.col("ha") + F.col("hy")) / 2
    return value(one, "NMI", F.when(h <= 1e-15, 1.0).when(F.col("mi") <= 1e-15, 0.0).otherwise(ratio(F.col("mi"), h)))


def conditional_information(ct: DataFrame) -> DataFrame:
    """Sum over subgroups of n(s) / N MI(a, y | s), over ln of the number of subgroups; null for one subgroup."""
    n = F.col("n")
    cells = ct.filter("s is not null").select(
        "scope", "s", "n", F.sum(n).over(over("s", "a")).alias("na"), F.sum(n).over(over("s", "y")).alias("ny"),
        F.sum(n).over(over("s")).alias("ns"), F.sum(n).over(over()).alias("t"),
    )
    mi = information(n, F.col("na"), F.col("ny"), F.col("ns"))
    one = cells.groupBy("scope").agg(F.sum(mi * ratio(F.col("ns"), F.col("t"))).alias("mi"), F.count_distinct("s").alias("k"))
    return value(one, "NCMI", F.when(F.col("k") > 1, ratio(F.col("mi"), F.ln(F.col("k").cast("double")))))


def means(ct: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the outcome's values in facets 1 and 0."""
    of = lambda a: ratio(
        F.sum(F.when(F.col("a") == a, F.col("y").cast("double") * F.col("n"))), F.sum(F.when(F.col("a") == a, F.col("n")))
    )
    return ct.groupBy("scope", *by).agg(
        of(1).alias("m1"), of(0).alias("m0"), F.sum("n").alias("n"), F.count_distinct("a").alias("na"), F.count_distinct("y").alias("ny"),
    )


def binary_means(ct: DataFrame) -> DataFrame:
    """BR and BD, the ratio and the difference of the facets' mean outcomes; null unless facet and outcome have two values."""
    one, two = means(ct, []), (F.col("na") == 2) & (F.col("ny") == 2)
    return value(one, "BR", F.when(two, ratio(F.col("m1"), F.col("m0")))).unionByName(value(one, "BD", F.when(two, F.col("m1") - F.col("m0"))))


def conditional_difference(ct: DataFrame) -> DataFrame:
    """Sum over subgroups of n(s) / N times their difference; a subgroup without both facets has none and adds none."""
    per = means(ct.filter("s is not null"), ["s"]).select("scope", "n", (F.col("m1") - F.col("m0")).alias("d"))
    two = ct.groupBy("scope").agg(F.count_distinct("a").alias("na"), F.count_distinct("y").alias("ny"))
    one = per.groupBy("scope").agg(F.sum(F.col("d") * F.col("n")).alias("d"), F.sum("n").alias("n")).join(two, "scope")
    return value(one, "CBD", F.when((F.col("na") == 2) & (F.col("ny") == 2), ratio(F.col("d"), F.col("n"))))


def correlation(ct: DataFrame) -> DataFrame:
    """Pearson's, from the cells' moments; null where facet or outcome is constant."""
    a, y, n = F.col("a").cast("double"), F.col("y").cast("double"), F.col("n")
    one = ct.groupBy("scope").agg(*[F.sum(x * n).alias(k) for k, x in {"t": F.lit(1.0), "sa": a, "sy": y, "saa": a * a, "syy": y * y, "say": a * y}.items()])
    va, vy = F.expr("t * saa - sa * sa"), F.expr("t * syy - sy * sy")
    return value(one, "CORR", F.when((va > 0) & (vy > 0), F.expr("t * say - sa * sy") / F.sqrt(va * vy)))


def cramers_v(ct: DataFrame) -> DataFrame:
    """From chi-squared over the whole grid, with Yates' correction for two by two; null for a single row or column."""
    n = F.col("n").cast("double")
    grid = densified(ct, ["a"]).select("scope", n.alias("n"), *[F.sum("n").over(over(*b)).cast("double").alias(k) for k, b in {"na": ["a"], "ny": ["y"], "t": []}.items()], "a", "y")
    size = grid.groupBy("scope").agg(F.count_distinct("a").alias("r"), F.count_distinct("y").alias("c"))
    e, d = F.col("na") * F.col("ny") / F.col("t"), F.abs(F.col("n") - F.col("na") * F.col("ny") / F.col("t"))
    corrected = F.when((F.col("r") == 2) & (F.col("c") == 2), d - F.least(F.lit(0.5), d)).otherwise(d)
    one = grid.join(size, "scope").groupBy("scope").agg(F.sum(corrected * corrected / e).alias("x"), F.max("t").alias("t"), F.max(F.least("r", "c")).alias("m"))
    return value(one, "V", F.when(F.col("m") > 1, F.sqrt(F.col("x") / (F.col("t") * (F.col("m") - 1)))))


def report(values: DataFrame) -> DataFrame:
    """(scope, metric, value, threshold, biased, low, high, reason): bounds and fair bands beside the values."""
    pick = lambda table, default: reduce(lambda c, x: c.when(F.col("metric") == x[0], F.lit(x[1])), table.items(), F.when(F.lit(False), None)).otherwise(F.lit(default))
    bound = pick(BOUNDS, None).cast("double")
    beyond = F.when(F.col("metric") == "CI", F.abs(F.round("value", 2)) >= bound).when(F.col("metric") == "CDD", F.col("value") > bound).otherwise(F.abs("value") > bound)
    low, high = (pick({m: b[i] for m, b in BANDS.items()}, DEFAULT_BAND[i]) for i in (0, 1))
    return values.select(
        "scope", "metric", "value", bound.alias("threshold"), beyond.alias("biased"), low.alias("low"), high.alias("high"),
        F.when(F.col("value").isNull(), F.lit("not defined for these values")).alias("reason"),
    )


def audit(df: DataFrame, facet: str, outcome: str, label=1, subgroup: str | None = None, scope: Column | None = None, numeric: bool = True) -> DataFrame:
    """The report over all metrics that the columns allow: those with a subgroup only if one is given, Cramer's V in place of Pearson's for text."""
    ct = stored(contingency(df, facet, outcome, subgroup, scope), "contingency")
    # A few cells need no further shuffle; more of them are dealt by scope once for each metric.
    ct = ct.coalesce(1) if ct.count() <= FEW_CELLS else ct.repartition("scope")
    parts = [
        class_imbalance(ct), label_difference(ct, label), demographic_disparity(ct), pmf_distances(ct), total_variation(ct),
        normalised_information(ct), binary_means(ct), correlation(ct) if numeric else cramers_v(ct),
    ]
    if subgroup is not None:
        parts += [conditional_disparity(ct), conditional_information(ct), conditional_difference(ct)]
    # Scopes in which a distance between distributions is not defined have no row of it yet: a row without value stands in.
    names = F.explode(F.array(*map(F.lit, ("JS", "L2", "KS", "TVD"))))
    empty = ct.select("scope").distinct().select("scope", names.alias("metric"), F.lit(None).cast("double").alias("value"))
    found = reduce(DataFrame.unionByName, [*parts, empty]).groupBy("scope", "metric").agg(F.max("value").alias("value"))
    return report(found)


def logistic_coefficient(df: DataFrame, facet: str, outcome: str) -> tuple[float | None, float | None]:
    """Coefficient and intercept of the outcome on a two-valued facet, with a ridge penalty of 1 / (2 C), C = 1, on the sum of losses."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(named(facet).cast("double").alias("x"), named(outcome).cast("double").alias("label")).dropna()
    # Equal rows are one weighted row, so the fit sees a handful of rows at any size.
    cells = rows.groupBy("x", "label").agg(F.count("*").cast("double").alias("w"))
    size = cells.agg(F.sum("w").alias("n"), F.count_distinct("x").alias("a"), F.count_distinct("label").alias("y")).first()
    if size["a"] != 2 or size["y"] < 2:
        return None, None
    model = LogisticRegression(regParam=1 / size["n"], elasticNetParam=0.0, standardization=False, weightCol="w", maxIter=200, tol=1e-12).fit(
        VectorAssembler(inputCols=["x"], outputCol="features").transform(cells)
    )
    return float(model.coefficientMatrix[0, 0]), float(model.interceptVector[0])

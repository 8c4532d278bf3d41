import math

import pytest
from pyspark.sql import functions as F

from tabwarden.operators import bias


def values(df):
    return {(r["scope"], r["metric"]): r["value"] for r in df.collect()}


def people(spark, *cells):
    """Rows (a, y, s) from (a, y, n) or (a, y, s, n)."""
    out = []
    for c in cells:
        a, y, s, n = c if len(c) == 4 else (c[0], c[1], "all", c[2])
        out += [(a, y, s)] * n
    return spark.createDataFrame(out, "a long, y long, s string")


@pytest.fixture
def known(spark):
    return people(spark, (0, 0, 30), (0, 1, 10), (1, 0, 30), (1, 1, 30))


def test_known_values(spark, known):
    got = {m: v for (_, m), v in values(bias.audit(known, "a", "y")).items()}
    want = {"CI": 0.2, "DPL": 0.25, "BR": 2.0, "BD": 0.25, "L2": 0.25 * math.sqrt(2), "TVD": 0.25, "KS": 0.25, "DD": 0.0}
    for m, v in want.items():
        assert got[m] == pytest.approx(v, abs=1e-12), m
    assert 0 <= got["JS"] <= math.log(2)
    assert values(bias.label_difference_by_rank(bias.contingency(known, "a", "y")))["Overall", "DPL_rank"] == pytest.approx(-0.25)
    biased = {r["metric"]: r["biased"] for r in bias.audit(known, "a", "y").collect()}
    assert biased["DPL"] and not biased["CI"] and biased["BR"] is None


def test_undefined_values_are_null(spark):
    other = people(spark, (1, 0, 5), (1, 1, 5), (2, 0, 5), (2, 1, 6))
    got = {r["metric"]: (r["value"], r["reason"]) for r in bias.audit(other, "a", "y").collect()}
    for m in ("DPL", "JS", "L2", "KS", "BR", "BD"):
        assert got[m][0] is None and got[m][1], m
    assert got["TVD"][0] is not None and got["CI"][0] is not None
    single = {r["metric"]: r["value"] for r in bias.audit(people(spark, (1, 0, 5), (1, 1, 5)), "a", "y").collect()}
    assert single["TVD"] is None and single["CORR"] is None and single["NMI"] == 0.0
    same = {r["metric"]: r["value"] for r in bias.audit(people(spark, (1, 1, 5)), "a", "y").collect()}
    assert same["NMI"] == 1.0


def test_rank_value_needs_two_facets_with_the_label(spark):
    ct = bias.contingency(people(spark, (0, 0, 5), (1, 0, 5), (1, 1, 5)), "a", "y")
    assert values(bias.label_difference_by_rank(ct))["Overall", "DPL_rank"] is None


def test_empty_cells(spark):
    ct = bias.contingency(people(spark, (0, 0, 4), (0, 1, 4), (1, 1, 2), (1, 2, 2), (2, 0, 3), (2, 2, 1)), "a", "y")
    pmf = {(r["a"], r["y"]): r["p"] for r in bias.conditional_pmf(ct).collect()}
    assert len(pmf) == 9 and pmf[0, 2] == 0.0
    assert all(sum(pmf[a, y] for y in range(3)) == pytest.approx(1) for a in range(3))
    tvd = sum(sum(abs(pmf[a, y] - pmf[b, y]) for y in range(3)) / 2 for a, b in ((0, 1), (0, 2), (1, 2))) / 3
    assert values(bias.total_variation(ct))["Overall", "TVD"] == pytest.approx(tvd)
    assert values(bias.kl_divergence(ct))["Overall", "KL"] > 1  # where facet 0 has none counts as very unlikely


def test_subgroups(spark):
    df = people(spark, (0, 0, "u", 4), (0, 1, "u", 4), (1, 0, "u", 2), (1, 1, "u", 6), (0, 0, "v", 5), (0, 1, "v", 5))
    ct = bias.contingency(df, "a", "y", "s")
    # v lacks facet 1: it adds nothing, its 10 rows still count in the 26 of the weights
    assert values(bias.conditional_difference(ct))["Overall", "CBD"] == pytest.approx(0.25 * 16 / 26)
    one = bias.contingency(df.filter("s = 'u'"), "a", "y", "s")
    assert values(bias.conditional_information(one))["Overall", "NCMI"] is None
    assert values(bias.conditional_disparity(one))["Overall", "CDD"] is None


def test_nulls_are_left_out(spark, known):
    more = known.union(spark.createDataFrame([(None, 1, "all"), (1, None, "all")], known.schema))
    assert values(bias.audit(more, "a", "y")) == values(bias.audit(known, "a", "y"))


def test_scopes(spark, known):
    df = known.withColumn("c", F.lit("x")).union(known.filter("a = 1").withColumn("c", F.lit("y")))
    got = values(bias.audit(df, "a", "y", scope=F.col("c")))
    assert got["x", "DPL"] == pytest.approx(0.25) and got["y", "DPL"] is None and got["y", "JS"] is None


def test_logistic_against_newton(spark, known):
    w, b = bias.logistic_coefficient(known, "a", "y")
    x, y, n = [0, 0, 1, 1], [0, 1, 0, 1], [30, 10, 30, 30]
    u = v = 0.0
    for _ in range(50):  # Newton's method for the same objective
        p = [1 / (1 + math.exp(-(u * i + v))) for i in x]
        g = [sum(k * (q - j) * i for k, q, j, i in zip(n, p, y, x)) + u, sum(k * (q - j) for k, q, j in zip(n, p, y))]
        h = [k * q * (1 - q) for k, q in zip(n, p)]
        a11, a12, a22 = sum(i * z for i, z in zip(x, h)) + 1, sum(i * z for i, z in zip(x, h)), sum(h)
        d = a11 * a22 - a12 * a12
        u, v = u - (a22 * g[0] - a12 * g[1]) / d, v - (a11 * g[1] - a12 * g[0]) / d
    assert w == pytest.approx(u, abs=1e-4) and b == pytest.approx(v, abs=1e-4)
    assert bias.logistic_coefficient(known.filter("a = 1"), "a", "y") == (None, None)


def test_empty_table(spark, known):
    assert bias.audit(known.filter("a = 9"), "a", "y").count() == 0


def test_audit_of_many_cells_is_the_same(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 2).alias("a"), (F.col("id") % 3 == 0).cast("long").alias("y"), (F.col("id") % 5).alias("s"))
    said = lambda: sorted((r["scope"], r["metric"], r["value"], r["biased"]) for r in bias.audit(df, "a", "y", 1, "s").collect())
    few = said()
    monkeypatch.setattr(bias, "FEW_CELLS", 0)
    many = said()
    assert [x[:2] for x in few] == [x[:2] for x in many]
    assert [x[2] for x in few] == pytest.approx([x[2] for x in many], nan_ok=True)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tabwarden.functions import store

    session = lambda master, path=None: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: path), sparkContext=SimpleNamespace(master=master))
    assert store.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            store.shared_dir(session(master))
    assert store.shared_dir(session("local[4]")) == store.shared_dir(session("local"))


def test_names_with_dots(spark):
    """Columns are named as they are, dots and all."""
    df = spark.createDataFrame([(i % 2, (i // 2) % 2, i % 3) for i in range(24)], "`f.a` int, `y.b` int, `s.c` int")
    plain = df.toDF("f", "y", "s")
    said = lambda d, f, y, s: sorted((r["scope"], r["metric"], r["value"]) for r in bias.audit(d, f, y, 1, s).collect() if r["value"] is not None)
    assert said(df, "f.a", "y.b", "s.c") == said(plain, "f", "y", "s")

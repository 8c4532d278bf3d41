import pytest
from pyspark.sql import functions as F

from tabwarden.operators import prep


@pytest.fixture
def pair(spark):
    """Loans: two columns that tell rows apart, a number and two texts. The test rows know a purpose that the training rows do not."""
    kinds = "loan_id long, ID long, {}rate double, purpose string, region string"
    train = spark.createDataFrame(
        [(71, 9, 2, 1.5, "car", "N"), (72, 8, 0, 2.5, "house", "S"), (73, 7, 0, 1.5, "car", "S"), (74, 6, 2, 4.0, "boat", "N"), (75, 5, 0, 3.5, "house", "N")],
        kinds.format("Target long, "),
    )
    test = spark.createDataFrame([(81, 4, 1.0, "house", "S"), (82, 3, 2.0, "bike", "S"), (83, 2, 3.0, "car", "N")], kinds.format(""))
    return train, test


def test_target(spark, pair):
    assert {(r["class"], r["n"], r["percent"]) for r in prep.check_target(pair[0]).collect()} == {(0, 3, 60.0), (2, 2, 40.0)}
    with pytest.raises(ValueError):
        prep.check_target(pair[1])
    with pytest.raises(ValueError):
        prep.check_target(pair[0].withColumn("Target", F.lit("x")))


def test_keys(spark, pair):
    assert prep.assign_key(pair[0])[1] == "ID"
    assert prep.assign_key(pair[0].drop("ID"))[1] == prep.MADE_KEY
    assert prep.assign_key(pair[0].drop("ID").withColumnRenamed("loan_id", "patient_id"))[1] == "patient_id"
    bare = pair[0].drop("ID", "loan_id")
    (made, key), (again, _) = prep.assign_key(bare.union(bare)), prep.assign_key(bare.union(bare))
    assert made.select(key).distinct().count() == 10
    assert sorted(r[0] for r in made.select(key).collect()) == sorted(r[0] for r in again.select(key).collect())


def test_keys_of_a_pair(spark, pair):
    """A key is told for both tables, compared with nothing, kept, and alone: other columns that tell rows apart are no features."""
    train, test, key = prep.prepared(*pair)
    assert key == "ID" and "ID" in train.columns and "ID" in test.columns
    texts = [df.withColumn("ID", F.concat(F.lit(f"{n}-"), "ID")) for n, df in zip("ab", pair)]
    train, test, key = prep.prepared(*texts)
    assert key == "ID" and {r["ID"] for r in test.select("ID").collect()} == {"b-2", "b-3", "b-4"} and train.count() == 5
    bare = [df.drop("ID").unionByName(df.drop("ID").limit(1)) for df in pair]
    train, test, key = prep.prepared(*bare)
    assert key == prep.MADE_KEY and train.select(key).distinct().count() == train.count() == 6 and test.count() == 4
    train, test, key = prep.prepared(*pair, key="loan_id")
    assert key == "loan_id" and "ID" not in train.columns and "ID" not in test.columns
    nulls = pair[0].withColumn("loan_id", F.when(F.col("loan_id") > 72, F.col("loan_id")))
    assert prep.prepared(nulls, pair[1], key="loan_id")[0].count() == 5  # a null in the key is no reason to go
    mixed = pair[1].withColumn("ID", F.col("ID").cast("string"))
    assert dict(prep.prepared(pair[0], mixed)[0].dtypes)["ID"] == "string"
    one_sided = prep.prepared(pair[0], pair[1].drop("ID"))
    assert one_sided[2] == prep.MADE_KEY and "ID" not in one_sided[0].columns
    with pytest.raises(ValueError):
        prep.prepared(*pair, key="no such")


def test_domains_and_prepare(spark, pair):
    train, test = prep.prepare(*pair)
    assert "purpose" not in train.columns and "purpose" not in test.columns and "region" in train.columns
    assert train.count() == 5 and test.count() == 3
    known = pair[1].withColumn("purpose", F.when(F.col("loan_id") == 82, "boat").otherwise(F.col("purpose")))
    same, _ = prep.match_domains(pair[0], known)
    assert "purpose" in same.columns


def test_null_rows(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (None, 2.0, "b"), (3, float("nan"), "c"), (4, None, "d"), (5, 5.0, None)], "k long, x double, s string")
    assert [r["k"] for r in prep.drop_null_rows(df, "k").orderBy("x").collect()] == [1, None]


def test_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("ab",), ("a",)], "v string")
    assert sorted(r["v"] for r in prep.code_integers(df).collect()) == [-1, 0, 0, 1, 2]
    assert prep.code_integers(df.filter("v = 'zz'")).count() == 0


def test_ages(spark):
    df = spark.createDataFrame([(-1,), (0,), (39,), (40,), (59,), (60,), (None,)], "age int")
    assert [r["age"] for r in prep.bin_age(df.coalesce(1)).collect()] == [None, None, 1, 2, 2, 3, None]
    assert prep.bin_age(df.withColumnRenamed("age", "years")).columns == ["years"]


def test_folds_are_even_and_complete(spark):
    df = spark.range(1003).withColumn("y", F.col("id") % 3)
    sizes = prep.stratified_folds(df, "y", "id", 5).groupBy("y", "fold").count().collect()
    assert sum(r["count"] for r in sizes) == 1003 and len(sizes) == 15
    for y in range(3):
        own = [r["count"] for r in sizes if r["y"] == y]
        assert max(own) - min(own) <= 1


def test_ranks_equal_a_plain_window(spark):
    from pyspark.sql import Window

    from tabwarden.functions.numbers import shuffled
    from tabwarden.functions.ranges import rank_in_order

    df = spark.range(500).withColumn("y", F.when(F.col("id") % 7 > 0, F.col("id") % 2)).withColumn("t", shuffled("id", 3))
    plain = F.row_number().over(Window.partitionBy("y").orderBy("t", "id"))
    both = rank_in_order(df, ["y"], [F.col("t"), F.col("id")], "r").withColumn("p", plain)
    assert both.count() == 500 and both.filter("r <> p").count() == 0


def test_samples(spark):
    df = spark.range(100).withColumn("y", (F.col("id") < 30).cast("int"))
    assert {r["y"]: r["count"] for r in prep.stratified_sample(df, "y", "id", 10).groupBy("y").count().collect()} == {0: 7, 1: 3}
    assert prep.stratified_sample(df, "y", "id", 1000).count() == 100
    train, test = prep.train_test_split(df, "y", "id")
    assert train.count() == 80 and test.count() == 20 and train.join(test, "id").count() == 0

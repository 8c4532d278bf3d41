"""Frames over the test tables on which the registered queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Classes of the embeddings' labels.
CLASSES = 10
FEATURES = [f"f{i}" for i in range(10)]
#: Made-up trees over the first four components, two classes: (feature, threshold, below or at it, above it), or a leaf's values.
TREES = [
    (0, 0.0, (1, 0.25, [1.013724193, -2.170839127], (0, -0.5, [0.271828183, 3.141592654], [4.669201609, 0.577215665])), (2, -0.125, [-1.324717957, 1.618033989], (0, 0.75, [2.236067977, 2.502907875], (3, 0.0, [-3.359885666, 0.0], [0.5671432904, -0.764223653])))),
    (3, 0.125, (2, 0.0, [0.0, 1.0986122887], [1.259921049, -1.0986122887]), (3, 0.5, (1, 0.0, [2.094551481, 0.0], [-0.5671432904, 1.1319882487]), [0.7475979202, 0.2614972128])),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, a (balance not negative), seg, y (status F), y3 (F, O, P), s (priority), price, bal; an order each."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    status = F.col("o_orderstatus")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("k"), (F.col("c_acctbal") >= 0).cast("bigint").alias("a"), F.col("c_mktsegment").alias("seg"),
        (status == "F").cast("bigint").alias("y"), F.when(status == "F", 0).when(status == "O", 1).otherwise(2).cast("bigint").alias("y3"),
        F.col("o_orderpriority").alias("s"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("bal"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, y (quality), t (toxic): labelled documents."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return d.join(read(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").cast("bigint").alias("y"), F.col("toxic").cast("bigint").alias("t")
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y (label), f0 to f9: the first components as doubles."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(10)]
    )


def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, fold, y, p: two made-up models over the orders, one without and one with knowledge of y; many tied scores."""
    k, y = F.col("k"), F.col("y")
    score = F.explode(F.array(
        F.struct(F.lit("blind").alias("model"), ((k * 7919 % 1000) / F.lit(1000.0)).alias("p")),
        F.struct(F.lit("keen").alias("model"), F.round((k * 7717 % 997 + y * 300) / F.lit(1297.0), 3).alias("p")),
    )).alias("x")
    return orders(spark, sf_dir).select((k % 5).cast("int").alias("fold"), "y", score).select("x.model", "fold", "y", "x.p")


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, fold, y, p: softmax of ten components as scores of ten classes, rounded."""
    e = F.transform(F.slice("embedding", 2, CLASSES), lambda x: F.exp(x.cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return read(spark, sf_dir, "embeddings").select(
        F.lit("softmax").alias("model"), (F.col("vec_id") % 3).cast("int").alias("fold"), F.col("label").cast("bigint").alias("y"),
        F.transform(e, lambda x: F.round(x / total, 6)).alias("p"),
    )


def fixed_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, class, feature, value, shap: a made-up attribution of three classes, linear in the components."""
    rows = embeddings(spark, sf_dir)
    part = F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), F.lit(f).alias("feature"), F.col(f).alias("value"), (F.col(f) * ((i + 1) * (c + 1) % 7 - 3)).alias("shap"))
        for c in range(3) for i, f in enumerate(FEATURES)
    ])).alias("x")
    return rows.select("id", part).select("id", "x.*")

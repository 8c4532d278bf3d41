"""The stages' decisions on a small table, and the SQL twins of the subpackage."""

import os

import pytest
from oracle_check import differs, views
from pyspark.sql import functions as F

import corpus_pipeline
from tabwarden.functions.store import shared_dir
from tabwarden.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    assert differs(spark, views(DATA), name, QUERIES[name], ORACLE_SQL[name], DATA) == ""


def test_stages(spark):
    words = "the house of many old trees stood near a quiet river where people came to rest in summer and winter".split()
    long = " ".join(f"{w}{i % 7}" for i, w in enumerate(words * 20))
    rows = [(i, f"{long} tail{i} " + "abc def " * 5 + f"n{i} m{i} o{i}", "en") for i in range(3)] + [(10, "mail me at a@b.org now " + " ".join(words), "en"), (11, "mail me at a@b.org now " + " ".join(words), "en")]
    rows += [(20, "1234 5678", "en"), (21, None, "en"), (22, "", None)] + [(30 + i, " ".join(words[j % 19] + words[(j * i) % 17] for j in range(30)), "en") for i in range(12)]
    docs = spark.createDataFrame([(i, t, l, "s", 0) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    said = corpus_pipeline.language(spark, docs, "")
    ids = {r["doc_id"] for r in said.collect()}
    assert not ids & {20, 21, 22} and {0, 1, 2, 10, 11} <= ids and said.columns == corpus_pipeline.COLUMNS
    once = corpus_pipeline.exact(spark, said, "")
    assert {r["doc_id"] for r in once.collect()} == ids - {10}
    fewer = corpus_pipeline.near(spark, once, "")
    left = {r["doc_id"] for r in fewer.collect()}
    assert len(left & {0, 1, 2}) == 1 and 11 in left
    clean = corpus_pipeline.personal(spark, fewer, "")
    r = clean.filter("doc_id = 11").first()
    assert "[EMAIL]" in r["text"] and "a@b.org" not in r["text"] and r["n_chars"] == len(r["text"]) and clean.columns == corpus_pipeline.COLUMNS
    assert clean.count() == fewer.count()
    done = corpus_pipeline.packed(spark, clean, "")
    assert {r["doc_id"] for r in done.collect()} == left
    assert corpus_pipeline.personal(spark, docs.filter(F.col("text").isNull()), "").first()["text"] is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]


def test_repeated_rows_and_null_ids_through_run(spark, tmp_path):
    words = "the house of many old trees stood near a quiet river where people came to rest in summer and winter".split()
    texts = [" ".join(words[j % 19] + words[(j * i) % 17] for j in range(30)) for i in range(15)]
    rows = [(None, texts[12])] * 3 + [(5, texts[12])] * 2 + [(7, texts[13])] * 2 + [(None, texts[14]), (None, "1234 5678")] + [(30 + i, texts[i]) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(ids, key=str) == sorted([5, 7, None, *range(30, 42)], key=str)


def test_kept_rows_by_bits_and_bands(spark, tmp_path):
    texts = [f"text {i % 90}" for i in range(400)]
    docs = spark.createDataFrame([(i % 50, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(7).write.parquet(f"{tmp_path}/t.parquet")
    rows = corpus_pipeline.numbered(spark.read.parquet(f"{tmp_path}/t.parquet"))
    assert rows.select(corpus_pipeline.NUMBER).distinct().count() == 400
    kept = rows.filter("n_chars = 6 or doc_id % 3 = 0")
    want = sorted(map(tuple, kept.select(*corpus_pipeline.COLUMNS).collect()))
    for most in (1 << 25, 5000):  # one band, and some seven
        got = corpus_pipeline.only(rows, kept, most)
        assert sorted(map(tuple, got.collect())) == want and got.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.only(rows, kept.limit(0)).count() == 0
    no_file = corpus_pipeline.numbered(docs)
    assert no_file.select(corpus_pipeline.NUMBER).distinct().count() == 400


def test_a_band_scans_its_own_files_only(spark, tmp_path):
    docs = spark.range(70).select("id", *(F.lit("x").alias(c) for c in ("text", "lang", "source")), F.lit(1).alias("n_chars")).withColumnRenamed("id", "doc_id")
    docs.repartition(7).write.parquet(f"{tmp_path}/t.parquet")
    rows = corpus_pipeline.numbered(spark.read.parquet(f"{tmp_path}/t.parquet"))
    part = rows.filter(F.pmod(F.col(f"{corpus_pipeline.NUMBER}.file"), F.lit(7)) == 0).select("doc_id")
    n = part.count()
    plan = part._jdf.queryExecution().executedPlan()
    part.collect()
    scan = plan.collectLeaves().head()
    assert scan.metrics().get("numFiles").get().value() * 10 <= n + 15 and n < 70


def test_tables_on_the_way_go_with_their_stage(spark, tmp_path):
    words = "the house of many old trees stood near a quiet river where people came to rest in summer and winter".split()
    rows = [(i, " ".join(words[j % 19] + words[(j * i) % 17] for j in range(30)), "en", "s", 9) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = set(os.listdir(shared_dir(spark)))
    done = corpus_pipeline.run(spark, str(tmp_path))
    left = {n.split("-")[0] + "-" + n.split("-")[1] for n in set(os.listdir(shared_dir(spark))) - before if n.startswith(("pipeline", "near", "dedup"))}
    assert left == {"pipeline-pii"} and done.count() == 12


def test_empty_table_through_run(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

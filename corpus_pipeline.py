"""Corpus pipeline: language ID, exact dedup, near dedup, personal data, packing.

Every stage but the last returns the columns of documents (doc_id, text, lang, source, n_chars) and works on all that the
one before it kept. The dedup stages decide by row, so rows that share a doc_id, or have none, are kept or go each by itself:
a row of a Parquet file is told by its file and its place there; other tables are stored as Parquet first. What a stage keeps
is a bit for each row, so texts are never shuffled to meet a decision. Each stage is written as Parquet and read again as the
next one's input; tables that it needed on the way go when it is written.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.functions.store import passing, removed, written
from tabwarden.llm.common import BROADCAST_BYTES, keep, see_package
from tabwarden.llm.exact_dedup import ROW_BITS, exact_dedup, is_set
from tabwarden.llm.langid import fit, held_out, identify
from tabwarden.llm.near_dedup import near_dedup
from tabwarden.llm.packing import pack_documents
from tabwarden.llm.pii import find_pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What tells rows apart: a file by its hash, and a place in it.
NUMBER = "row_number"
#: Bytes of a row of bits in a broadcast table, generously.
BITS_BYTES = ROW_BITS // 8 + 128
#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES = 2 << 20


def bounded(spark: SparkSession) -> None:
    """The session's workers see this package, and a batch for them ends at BATCH_BYTES as well as at its number of rows: the stages' workers and JVMs share memory."""
    see_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with what tells each row apart, the same whenever the row is read."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    try:
        return docs.select(*COLUMNS, place.alias(NUMBER))
    except AnalysisException:  # rows that come from no Parquet file have no place in one
        return keep(docs.select(*COLUMNS), "pipeline-rows").select(*COLUMNS, place.alias(NUMBER))


def only(rows: DataFrame, kept: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The numbered rows that `kept` names. Their bits, 4 KB for 32,768 places of a file, are broadcast to the texts.

    Where they take more than `most` bytes, files are dealt into bands, and each band is a stored pass over its own files.
    """
    file, chunk, bit = F.col(f"{NUMBER}.file"), F.floor(F.col(f"{NUMBER}.place") / ROW_BITS), F.col(f"{NUMBER}.place") % ROW_BITS
    places = kept.select(file.alias("_file"), chunk.alias("_chunk"), bit.alias("_bit"))
    # Places meet before they are bits: a bit map for each of few rows of a task would be larger than those.
    bits = keep(places.repartition("_file", "_chunk").groupBy("_file", "_chunk").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "pipeline-bits")
    bands = max(1, math.ceil(bits.count() * BITS_BYTES / most))

    def chosen(part: DataFrame, its: DataFrame) -> DataFrame:
        met = part.withColumn("_file", file).withColumn("_chunk", chunk).join(F.broadcast(its), ["_file", "_chunk"])
        return met.filter(is_set("_bits", bit.cast("int"))).select(*COLUMNS)

    if bands == 1:
        return chosen(rows, bits)
    of = [(F.pmod(file, F.lit(bands)) == n, F.pmod(F.col("_file"), F.lit(bands)) == n) for n in range(bands)]
    return reduce(DataFrame.unionByName, [keep(chosen(rows.filter(own), bits.filter(its)), "pipeline-band") for own, its in of])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told stay; those that the identifier rejects go. Learns from the same training rows as the query."""
    bounded(spark)
    found = identify(docs, fit(docs, ~held_out()), carry=COLUMNS[1:])
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    bounded(spark)
    rows = numbered(docs)
    return only(rows, exact_dedup(rows, digests={NUMBER: F.col(NUMBER)}).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    bounded(spark)
    rows = numbered(docs)
    return only(rows, near_dedup(rows, row_col=NUMBER).filter("kept"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows the text. Every document stays, a null text null."""
    bounded(spark)
    found = find_pii(docs.select("doc_id", "text", "lang", "source", "n_chars"), redact=True, carry=["lang", "source", "n_chars"], keep_null=True)
    text = F.col("redacted")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of every document: its place in the packed sequences.

    Workers that have served the stages before have less memory to spare, so they encode less text at once and remember fewer words.
    """
    bounded(spark)
    return pack_documents(docs, remember=30_000, together=500_000)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("pii", personal), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with passing(spark):
            found = stage(spark, docs, sf_dir)
            path = written(found, f"pipeline-{name}", lasting=True)
        docs = spark.read.schema(found.schema).parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

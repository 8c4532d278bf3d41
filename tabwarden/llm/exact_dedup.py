"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame functions. The first scan sees lengths and short prefixes; a full hash is taken only for rows whose
(length, prefix) another row shares. Which do is told by a bit map of fixed size that goes to the texts, so the method is the
same at every size: where keys are many, some bits stand for several of them and a few more rows are hashed than need be.
What is shuffled are fixed-size keys, never texts. Groups are counted by partial aggregation, and rows meet a stored table of
groups, so the rows of one text are never gathered: the table is broadcast up to a bound, and beyond it joined by
a sort-merge join, whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, small_broadcast

#: Characters of the prefix that the second step hashes.
PREFIX = 128
#: Bits of the map of shared keys, 16 MB in all, and bits of one of its rows (Spark's own size of a bitmap).
BITS, ROW_BITS = 1 << 27, 1 << 15
#: Bytes that a group takes in a broadcast table, generously.
GROUP_BYTES = 192


def bit_of(size: str, prefix: str) -> tuple[Column, Column]:
    """The row of the bit map, and the place in it, of a (length, prefix)."""
    h = F.pmod(F.xxhash64(size, prefix), F.lit(BITS))
    return F.floor(h / ROW_BITS).cast("int"), (h % ROW_BITS).cast("int")


def is_set(bits: str, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.col(bits).isNotNull() & (F.getbit(byte, place % 8) == 1)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and the columns `digests` computed at the scan; one row per input row.

    Of equal texts the row with the largest id stays. A null text counts as empty; a null id is smaller than any.
    Rows that repeat both id and text: exactly one stays. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, prefix = F.octet_length(text).cast("long"), F.xxhash64(F.substring(text, 1, PREFIX))

    first = keep(df.select(size.alias("_size"), prefix.alias("_prefix")), "dedup-prefix")
    lengths = first.groupBy("_size").count().filter("count > 1").select("_size")
    # Counted before they meet the lengths: a length or prefix of a third of all rows is then one row per task.
    prefixes = first.groupBy("_size", "_prefix").count().filter("count > 1")
    shared = prefixes.join(lengths, "_size", "left_semi")
    which, place = bit_of("_size", "_prefix")
    bits = shared.select(which.alias("_which"), place.cast("long").alias("_place")).groupBy("_which").agg(F.bitmap_construct_agg("_place").alias("_bits"))

    scan = df.select(
        F.col(id_col).cast("long").alias("doc_id"), size.alias("_size"), prefix.alias("_prefix"), text.alias("_text"),
        *[c.alias(k) for k, c in (digests or {}).items()],
    ).withColumn("_which", which)
    marked = scan.join(F.broadcast(keep(bits, "dedup-bits")), "_which", "left")  # at most BITS / ROW_BITS rows
    rows = keep(
        marked.select(
            "doc_id", F.monotonically_increasing_id().alias("_row"), F.when(is_set("_bits", place), F.sha2("_text", 256)).alias("_hash"), "_size",
            *(digests or {}),
        ),
        "dedup-rows",
    )
    hashed = rows.filter("_hash is not null")
    groups = hashed.groupBy("_size", "_hash").agg(F.max(F.struct("doc_id", "_row")).alias("_best"), F.count("*").alias("_n")).filter("_n > 1")
    joined = hashed.join(small_broadcast(keep(groups, "dedup-groups"), GROUP_BYTES), ["_size", "_hash"], "left")
    told = joined.withColumn("_alone", F.col("_n").isNull()).select(
        "doc_id", F.when(F.col("_alone"), F.col("doc_id")).otherwise(F.col("_best.doc_id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), (F.col("_alone") | (F.col("_row") == F.col("_best._row"))).alias("kept"), *(digests or {}),
    )
    alone = rows.filter("_hash is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *(digests or {})
    )
    return told.unionByName(alone)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, digests={"text_sha256": F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)})


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

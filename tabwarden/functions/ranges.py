"""Ranks and running sums over ranges that follow the data, so that no task holds a whole group.

A rank is a row's place in a table that lies sorted over range partitions, whose bounds Spark takes from a sample. Running sums are
taken within ranges bounded by a sketch of quantiles, and the ranges' own sums give what lies before each. Where a table is small by
its counted rows, one level does.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbers import named
from .store import stored

#: Rows up to which a running sum takes a single level, and about which a range has beyond; most ranges, and ranges a task at least.
SMALL, MOST_RANGES, RANGES_A_TASK = 1 << 17, 10_000, 16
#: Bits of the place of a row in its partition, as monotonically_increasing_id() has them.
PLACE_BITS = 33


def rank_in_order(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with the rank (from 1) of each row within `by` in the given order, nulls first; equal rows in any order.

    One shuffle by ranges of (by, order) and one sort; then a count for each partition, and the first place of each group.
    """
    keyed = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [*[named(b).asc_nulls_first() for b in by], *[F.col(f"_o{i}").asc_nulls_first() for i in range(len(order))]]
    lying = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*map(named, df.columns), F.monotonically_increasing_id().alias("_at"))
    rows = stored(lying, "ranked").withColumn("_part", F.shiftright("_at", PLACE_BITS))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    placed = rows.join(F.broadcast(begins), "_part").withColumn("_place", F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))  # a row for each partition
    if not by:
        return placed.select(*map(named, df.columns), (F.col("_place") + 1).cast("long").alias(name))
    firsts = placed.groupBy(*map(named, by)).agg(F.min("_place").alias("_first")).select(*[named(b).alias(f"_b{i}") for i, b in enumerate(by)], "_first")
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & named(b).eqNullSafe(F.col(f"_b{i}"))
    # Stored, so that its size is known when the join is planned: a few groups are broadcast, many are not.
    return placed.join(stored(firsts, "firsts"), same).select(*map(named, df.columns), (F.col("_place") - F.col("_first") + 1).cast("long").alias(name))


def cut_points(df: DataFrame, column: str, small: int | None = None) -> list[float]:
    """Bounds between ranges of a number that hold about as many rows each; none for a table of few rows. df is read for it, so it had better be stored.

    The bounds are quantiles of all rows by a sketch whose error is a quarter of a range.
    """
    small = SMALL if small is None else small
    n = df.count()
    if n <= small:
        return []
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(math.ceil(n / small), RANGES_A_TASK * tasks))
    numbers = df.select(named(column).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    found = numbers.approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    return sorted({x for x in found if math.isfinite(x)})


def cut_at(df: DataFrame, column: str, bounds: list[float], name: str) -> DataFrame:
    """df with the number of the range of each row: null first, then by value, NaN last."""
    if not bounds:
        return df.withColumn(name, F.lit(0))
    placed = df.withColumn("_x", named(column).cast("double"))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_x", outputCol="_bucket", handleInvalid="keep").transform(placed)
    return cut.withColumn(name, F.when(F.col("_x").isNull(), -1).otherwise(F.col("_bucket")).cast("int")).drop("_x", "_bucket")


def running(
    df: DataFrame, by: list[str], along: str, bounds: list[float], sums: dict[str, Column], totals: dict[str, str] | None = None, before: dict[str, Column] | None = None,
    down: bool = False,
) -> DataFrame:
    """df with running sums within `by` along a number, this row included; sums over the whole group; and greatest values before the row.

    sums: name -> what is summed; totals: name -> which of `sums`; before: name -> what the greatest is taken of, null in the first row.
    bounds: from cut_points(); rows are added up within ranges, and the ranges' own sums, one row for each, give what lies before. Without
    bounds the rows of a group are summed in one go. down: from the greatest number to the least.
    """
    totals, before = totals or {}, before or {}
    order = named(along).desc() if down else named(along).asc()
    if not bounds:
        group = Window.partitionBy(*by)
        up_to, until = (group.orderBy(order).rowsBetween(Window.unboundedPreceding, x) for x in (0, -1))
        return df.select(
            *map(named, df.columns), *[F.sum(c).over(up_to).alias(n) for n, c in sums.items()], *[F.sum(sums[of]).over(group).alias(n) for n, of in totals.items()],
            *[F.max(c).over(until).alias(n) for n, c in before.items()],
        )
    rows = cut_at(df, along, bounds, "_cut")
    rows = rows.withColumn("_cut", -F.col("_cut")) if down else rows
    ranges = rows.groupBy(*by, "_cut").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_m_{n}") for n, c in before.items()])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.select(
        *[named(b).alias(f"_b_{b}") for b in by], F.col("_cut").alias("_b_cut"), *[F.sum(f"_s_{n}").over(earlier).alias(f"_s_{n}") for n in sums],
        *[F.sum(f"_s_{of}").over(group).alias(n) for n, of in totals.items()], *[F.max(f"_m_{n}").over(earlier).alias(f"_m_{n}") for n in before],
    )
    same = F.col("_cut") == F.col("_b_cut")
    for b in by:
        same = same & named(b).eqNullSafe(named(f"_b_{b}"))
    inner = Window.partitionBy(*by, "_cut").orderBy(order)
    up_to, until = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(begins, same).select(
        *map(named, df.columns), *[(F.sum(c).over(up_to) + F.coalesce(f"_s_{n}", F.lit(0))).alias(n) for n, c in sums.items()],
        *totals, *[F.greatest(F.max(c).over(until), f"_m_{n}").alias(n) for n, c in before.items()],
    )

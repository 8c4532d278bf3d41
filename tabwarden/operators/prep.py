"""Checks and preparation of a train and a test table of tabular classification data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import named, ratio, shuffled
from ..functions.ranges import rank_in_order
from ..functions.store import stored

TARGET = "Target"
#: Names of a key column, in order of preference, and that of one made here.
KEYS, MADE_KEY = ("ID", "patient_id"), "row_key"
#: Upper ends of the age groups: up to 39, up to 59, above; ages of 0 and less have none.
AGE_ENDS = (39, 59)
#: Codes of a column that may be broadcast.
BROADCAST_CODES = 200_000


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def class_profile(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows per class and their percentage with two decimals; a null class is a class."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("class", "n", F.round(ratio(F.col("n"), total) * 100, 2).alias("percent"))


def check_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """The class profile; ValueError if the target is missing or no number. Its values are free."""
    if target not in df.columns:
        raise ValueError(f"no column {target}")
    if not isinstance(df.schema[target].dataType, T.NumericType):
        raise ValueError(f"column {target} is not numeric")
    return class_profile(df, target)


def key_of(df: DataFrame) -> str | None:
    return next((k for k in KEYS if k in df.columns), None)


def assign_key(df: DataFrame, key: str | None = None) -> tuple[DataFrame, str]:
    """df and the name of its key: the one given (ValueError if there is none), else ID, else patient_id, else a new one from the row's content, which a rerun gives again.

    Equal rows get keys of their own by number.
    """
    if key is not None and key not in df.columns:
        raise ValueError(f"no column {key}")
    key = key or key_of(df)
    return (df, key) if key else (made_key(df), MADE_KEY)


def made_key(df: DataFrame) -> DataFrame:
    """df with a key: the digest of the row, and a number that tells equal rows apart."""
    said = F.md5(F.to_json(F.struct(*map(named, df.columns)), {"ignoreNullFields": "false"}).cast("binary"))
    told = df.withColumn("_said", said).withColumn("_row", F.monotonically_increasing_id())
    numbered = rank_in_order(told, ["_said"], [F.col("_row")], "_copy")
    return numbered.withColumn(MADE_KEY, F.concat_ws("-", "_said", "_copy")).drop("_said", "_row", "_copy")


def assign_keys(train: DataFrame, test: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Both tables with a key of one name and kind, and its name: the one given, else ID or patient_id if both tables have it, else one made for both.

    Other columns that tell rows apart go from both, since they are no features. A key of two kinds becomes text.
    """
    for df in (train, test):
        if key is not None and key not in df.columns:
            raise ValueError(f"no column {key}")
    name = key or next((k for k in KEYS if k in train.columns and k in test.columns), None)
    train, test = (df.select(*[named(c) for c in df.columns if c == name or c not in KEYS]) for df in (train, test))
    if name is None:
        return made_key(train), made_key(test), MADE_KEY
    if train.schema[name].dataType != test.schema[name].dataType:
        train, test = (df.withColumn(name, named(name).cast("string")) for df in (train, test))
    return train, test, name


def drop_null_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows without a null or NaN in any column but the key."""
    whole = F.lit(True)
    for f in df.schema.fields:
        if f.name != key:
            whole = whole & named(f.name).isNotNull()
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                whole = whole & ~F.isnan(named(f.name))
    return df.filter(whole)


def domain_report(train: DataFrame, test: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """For each text column of both tables that is not to be skipped: distinct values of each and how many are in one only. One pass over each table."""
    both = [c for c in train.columns if c in test.columns and c not in skip and is_text(train, c)]
    if not both:
        return train.sparkSession.createDataFrame([], "feature string, n_train long, n_test long, n_unmatched long")
    side = lambda df, n: df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), named(c).cast("string").alias("value")) for c in both
    ])).alias("x")).select("x.feature", "x.value", F.lit(n).alias("side")).filter("value is not null")
    seen = side(train, 1).unionByName(side(test, 2)).groupBy("feature", "value").agg(F.max((F.col("side") == 1).cast("int")).alias("a"), F.max((F.col("side") == 2).cast("int")).alias("b"))
    found = seen.groupBy("feature").agg(
        F.sum("a").cast("long").alias("n_train"), F.sum("b").cast("long").alias("n_test"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("n_unmatched"),
    )
    names = train.sparkSession.createDataFrame([(c,) for c in both], "feature string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(found, "feature", "left").select("feature", zero("n_train"), zero("n_test"), zero("n_unmatched"))


def match_domains(train: DataFrame, test: DataFrame, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Both tables without the text columns whose sets of values differ, those to be skipped aside. Only the columns' names reach the driver."""
    bad = [r["feature"] for r in domain_report(train, test, skip).filter("n_unmatched > 0").select("feature").collect()]
    return tuple(df.select(*[named(c) for c in df.columns if c not in bad]) for df in (train, test))


def prepare(train: DataFrame, test: DataFrame, target: str = TARGET, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Target check, keys, rows with nulls, unmatched text columns, in this order. The key's values are compared with nothing; see prepared() for its name."""
    return prepared(train, test, target, key)[:2]


def prepared(train: DataFrame, test: DataFrame, target: str = TARGET, key: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Both tables as prepare() gives them, and the name of the key that both have."""
    check_target(train, target)
    train, test, name = assign_keys(train, test, key)
    return *match_domains(drop_null_rows(train, name), drop_null_rows(test, name), (name,)), name


def split_label(df: DataFrame, target: str = TARGET) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct non-null values in order, numbered from 0."""
    values = df.select(named(column).cast("string").alias("value")).filter("value is not null").distinct()
    return rank_in_order(values, [], [F.col("value")], "code").select("value", (F.col("code") - 1).alias("code"))


def code_integers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df with its text columns (or those named) as codes of their sorted distinct values; null is -1. A column of few values is coded without a shuffle of the rows."""
    for c in columns if columns is not None else [c for c in df.columns if is_text(df, c)]:
        known = stored(codes(df, c).select(F.col("value").alias("_value"), F.col("code").alias("_code")), "codes")
        known = F.broadcast(known) if known.count() <= BROADCAST_CODES else known
        joined = df.join(known, named(c).cast("string") == F.col("_value"), "left")
        df = joined.select(*[F.coalesce("_code", F.lit(-1)).cast("long").alias(c) if x == c else named(x) for x in df.columns])
    return df


def age_bin(age: Column) -> Column:
    """1 to 3 by the ends above, which belong to the lower group; null for null, 0 and less."""
    return F.when(age <= 0, None).when(age <= AGE_ENDS[0], 1).when(age <= AGE_ENDS[1], 2).when(age > AGE_ENDS[1], 3).cast("int")


def bin_age(df: DataFrame, column: str = "age") -> DataFrame:
    """df with the column `age`, if there is one, in groups."""
    return df.withColumn(column, age_bin(F.col(column))) if column in df.columns else df


def rows_where(df: DataFrame, **equal) -> DataFrame:
    """Rows in which each named column has the value given."""
    return reduce(lambda d, x: d.filter(named(x[0]) == F.lit(x[1])), equal.items(), df)


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 10) -> DataFrame:
    """df with a column fold, 0 to k - 1: class counts of any two folds differ by at most one, membership is by hash."""
    ranked = rank_in_order(df, [label], [shuffled(key, seed), named(key)], "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank")


def sizes_by_class(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(named(label).alias("_label")).agg(F.count("*").alias("_size"))


def stratified_sample(df: DataFrame, label: str, key: str, cap: int, seed: int = 42, binary: bool = True) -> DataFrame:
    """At most about `cap` rows, each class in proportion.

    binary: classes 0 and 1 only, floor(n * cap / total) rows of each where total exceeds cap, else all. Otherwise
    least(floor(cap * n / total), n) rows of each class over all classes.
    """
    rows = df.filter(named(label).isin(0, 1)) if binary else df
    sizes = sizes_by_class(rows, label)
    total = F.sum("_size").over(Window.partitionBy(F.lit(1)))
    if binary:
        quota = F.floor(F.col("_size") * F.least(F.lit(1.0), F.lit(float(cap)) / total))
    else:
        quota = F.least(F.floor(F.lit(float(cap)) * F.col("_size") / total), F.col("_size"))
    quotas = sizes.select("_label", quota.cast("long").alias("_quota"))
    ranked = rank_in_order(rows, [label], [shuffled(key, seed), named(key)], "_rank")
    kept = ranked.join(F.broadcast(quotas) if binary else quotas, named(label) == F.col("_label")).filter(F.col("_rank") <= F.col("_quota"))
    return kept.select(*map(named, df.columns))


def train_test_split(df: DataFrame, label: str, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """80 % and 20 % of the rows, class by class."""
    folds = stratified_folds(df, label, key, 5, seed)
    return folds.filter("fold > 0").drop("fold"), folds.filter("fold = 0").drop("fold")

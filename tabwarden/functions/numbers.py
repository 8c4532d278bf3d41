"""Small column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """The column of this very name, whatever marks it has."""
    return F.col(quoted(column))


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def or_zero(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(c.cast("double"), places) + F.lit(0.0)


def count_where(condition: Column, n: Column | None = None) -> Column:
    """Sum of n (1) over rows for which the condition holds, as long."""
    return F.sum(F.when(condition, F.lit(1) if n is None else n).otherwise(0)).cast("long")


def shuffled(key: str, seed: int) -> Column:
    """A reproducible random order: the hex md5 of key and seed."""
    return F.md5(F.concat(named(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))

"""Tables that are written once and read by what follows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, spark.checkpoint.dir. A session of one process without it has a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[.*)?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
    return own_folder()


@cache
def own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def new_path(spark: SparkSession, what: str, kind: str) -> str:
    """A path in the shared folder at which nothing is yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}.{kind}"


def until_the_end(spark: SparkSession, path: str) -> str:
    """The path, at which something lies now; it goes when the session's JVM ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """What lies at the path goes now; nothing may read it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Paths of tables that the innermost passing() around has to remove.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored within go when it ends, but for lasting ones. What is planned on them has to be written by then."""
    paths: list[str] = []
    token = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            removed(spark, path)


def written(df: DataFrame, what: str, kind: str = "parquet", lasting: bool = False) -> str:
    """The path of df, written into the shared folder. It goes when the session's JVM ends, or with a passing() around that it does not outlast."""
    path = new_path(df.sparkSession, what, kind)
    paths = _PASSING.get()
    if paths is not None and not lasting:
        paths.append(path)
    df.write.format(kind).save(path)
    return until_the_end(df.sparkSession, path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written into the shared folder and read back: lineage ends there, and lost executors cost no second run."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, what))

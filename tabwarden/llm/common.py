"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import stored

#: A table of at most this many bytes may be broadcast; beyond it each operator has another way.
BROADCAST_BYTES = 32 << 20


#: Rows of a batch that goes to a Python worker, where the session has Spark's own setting: whole texts are large rows.
BATCH_ROWS, BATCH_SETTING, USUAL_ROWS = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def see_package(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where the driver has it; batches of whole texts have BATCH_ROWS rows."""
    if spark.conf.get(BATCH_SETTING, USUAL_ROWS) == USUAL_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (here, env.get("PYTHONPATH", "")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    see_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, what: str) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends there, and lost executors cost no second run."""
    return stored(df, what)


def small_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows, of row_bytes each, stay within the bound; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(work); a worker gives memory it no longer needs back before and after each task, since others share its limit."""
    see_package(df.sparkSession)
    return df.mapInArrow(tidied(work), schema)


def tidied(work: Callable) -> Callable:
    """work, for whose batches a worker first gives up what it holds for another module, and after which it gives back free memory."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(work.__module__)
        yield from work(batches)
        give_back()

    return tidy


def give_back() -> None:
    """Free memory of this worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


_HELD: dict[tuple, object] = {}


def held(kind: type, *args):
    """kind(*args), which a worker keeps from task to task. It keeps one such object at a time: another one takes its place, with all it remembers."""
    key = (kind, *args)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = kind(*args)
    return _HELD[key]


def forget_others(module: str) -> None:
    """What a worker holds of a kind from another module goes, with all it remembers: the operator that it served has ended."""
    if any(kind.__module__ != module for kind, *_ in _HELD):
        _HELD.clear()
        gc.collect()
        give_back()


def slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `chars` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        n, start, size = batch.num_rows, 0, 0
        lengths = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_pylist()
        for i in range(n):
            if size and size + lengths[i] > chars:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += lengths[i]
        if start < n:
            yield batch.slice(start)


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))

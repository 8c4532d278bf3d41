"""What workers of the pipeline hold at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tabwarden.llm import common, langid
from tabwarden.llm.packing import Encoder


def test_workers_give_up_what_another_operator_held():
    common._HELD.clear()
    common._HELD[(Encoder, "some path")] = object()

    def work(batches):
        assert not common._HELD
        yield from batches

    work.__module__ = langid.__name__
    assert list(common.tidied(work)(iter([1, 2]))) == [1, 2]
    known = common.held(langid.letters)
    assert list(common.tidied(lambda batches: batches)(iter([]))) == [] and not common._HELD  # this module's lambda has no use for it
    common.held(langid.letters)
    assert list(common.tidied(work_of_langid())(iter([1]))) == [1] and len(known) == 0x110000
    common._HELD.clear()


def work_of_langid():
    def work(batches):
        assert common._HELD
        yield from batches

    work.__module__ = langid.__name__
    return work


def test_a_batch_of_the_pipeline_ends_at_its_bytes(spark):
    rows = spark.range(1500).coalesce(1).select(F.repeat(F.lit("x"), 4000).alias("t"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", common.BATCH_SETTING)}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    try:
        corpus_pipeline.bounded(spark)
        found = rows.mapInArrow(sizes, "n long, bytes long").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["n"] for r in found) == 1500 and max(r["bytes"] for r in found) <= corpus_pipeline.BATCH_BYTES + 5000


def test_language_takes_a_bounded_piece_of_text_at_once():
    draw = random.Random(5)
    texts = ["".join(draw.choice("abcdefghij klmnop") for _ in range(10_000)) for _ in range(100)]
    common.held(langid.letters)
    model = langid.Model(np.ones(langid.D, np.float32), np.eye(2, langid.D, dtype=np.float32), ("a", "b"), np.zeros(langid.LENGTHS))
    tracemalloc.start()
    n = sum(len(model.predict(p.column(0).to_pylist())[0]) for p in langid.small_batches(iter([pa.RecordBatch.from_pydict({"text": texts})]), "text"))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    common._HELD.clear()
    assert n == 100 and most < 60e6, most

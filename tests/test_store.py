"""Tables stored on the way go with the block they were stored in."""

import os

import pytest

from tabwarden.functions.store import passing, shared_dir, stored, written


def here(spark):
    return {n for n in os.listdir(shared_dir(spark)) if n.startswith("store-test")}


def test_passing(spark):
    with passing(spark):
        inner = stored(spark.range(5), "store-test-a")
        with passing(spark):
            stored(spark.range(3), "store-test-b")
            path = written(inner, "store-test-c", lasting=True)
        assert len(here(spark)) == 2 and inner.count() == 5  # b went with its own block
    assert here(spark) == {os.path.basename(path)} and spark.read.parquet(path).count() == 5
    outside = stored(spark.range(2), "store-test-d")
    with pytest.raises(ZeroDivisionError), passing(spark):
        stored(spark.range(3), "store-test-e")
        raise ZeroDivisionError
    assert len(here(spark)) == 2 and outside.count() == 2

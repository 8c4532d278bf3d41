"""Every registered query that SQL can express against DuckDB on the smallest tables."""

import os

import pytest
from oracle_check import differs, views

from tabwarden.plans.oracle import ORACLE_SQL
from tabwarden.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return views(DATA)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    assert differs(spark, con, name, QUERIES[name], ORACLE_SQL[name], DATA) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(DATA):
        assert e.entry(spark).columns == ["scope", "metric", "value", "threshold", "biased"]

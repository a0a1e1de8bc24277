"""Every registered query against its SQL; queries without SQL must give rows."""

import os

import pytest

import __spark_entry__ as entry
from harness import compare, duck

FOLDER = os.environ.get("LIKENESS_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_published_call_counts(spark):
    calls = QUERIES["activity_calls"](spark, "/root/testdata/sf0.01")
    counts = {r["source"]: r["count"] for r in calls.groupBy("source").count().collect()}
    assert counts == {"exact": 41342, "censored": 7260 - 1580}

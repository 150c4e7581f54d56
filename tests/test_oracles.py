"""Every registered query equals its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, SF, entry.queries()[name], entry.oracle_sql()[name], con) is None


def test_own_queries_have_sql():
    without = set(entry.queries()) - set(entry.oracle_sql())
    assert all(entry.queries()[name].__module__.startswith(("skysift.llm", "corpus_pipeline")) for name in without)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

"""Every registered query against the same result computed by DuckDB."""

import pytest

import __spark_entry__ as entry
from check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.LLM_QUERIES)))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, name) is None


def test_every_query_has_sql():
    assert set(entry.oracle_sql()) - set(entry.LLM_ORACLES) == set(entry.queries()) - set(entry.LLM_QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 20

"""Every registered query against its SQL check on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_check(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok is not False, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["path", "total_cost_usd", "tier", "turn_count", "primary_model"]
    assert df.count() > 0


def test_every_query_has_a_check():
    # Queries of the llm folder that SQL cannot express are tested there against plain versions.
    assert set(entry.queries()) - set(entry.oracle_sql()) <= set(entry.LLM_QUERIES)

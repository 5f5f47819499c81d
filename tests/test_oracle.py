"""Every query with an SQL form agrees with it, value by value."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    assert compare(spark, con, sf_dir, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_entry_returns_rows(spark):
    out = entry.entry(spark)
    assert out.columns == ["contract_id", "quota", "holder_id", "id_type", "node", "risk", "category", "stratum", "predicted_on"]
    assert out.count() > 0

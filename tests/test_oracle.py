"""Every registered query against its SQL twin; those without one must give rows and stable columns."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, con, name):
    problem, _ = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert problem is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and not df.isEmpty()


def test_entry(spark):
    assert entry.entry(spark).columns == ["day", "gb", "bin_count"]

"""Every registered query against its DuckDB oracle on the smallest test data."""

import pytest

import __spark_entry__ as entry
from checks import verify

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return verify.connect(SF)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert verify.compare(duck, df, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["kind", "n", "sum_end"] and df.count() > 0

"""Every registered query with SQL equals that SQL on the smallest tables."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    if name in SQL:
        ok, message = compare(name, QUERIES[name], SQL[name], spark, con, sf)
        assert ok, message
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_entry_is_stable(spark):
    df = contract.entry(spark)
    assert df.columns[:2] == ["l_suppkey", "l_partkey"]
    assert df.count() > 0

"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as driver
from relops.workload import ORACLES, QUERIES
from tests.oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF_DIR).toArrow()
    if name in ORACLES:
        assert differences(got, oracle.sql(ORACLES[name]).to_arrow_table()) == []
    else:
        assert got.num_rows > 0


def test_driver_contract(spark):
    assert driver.entry(spark).columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    assert set(driver.oracle_sql()) <= set(driver.queries())

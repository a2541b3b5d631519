"""Every registered query next to its SQL oracle, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from workload import catalog
from workload.compare import difference, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees(spark, con, name):
    problem, _, _ = difference(spark, con, driver.queries()[name], driver.oracle_sql().get(name), SF_DIR)
    assert problem is None, problem


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(driver.queries()) and set(catalog.ORACLES) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() == 5

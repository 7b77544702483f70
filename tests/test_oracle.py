import pytest
from compare import checking_engine, compare

import __spark_entry__ as driver
from workload import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return checking_engine(SF)


def test_every_query_has_a_check():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, engine, name):
    same, note = compare(spark, engine, name, driver.queries()[name], driver.oracle_sql()[name], SF)
    assert same, note


def test_entry(spark):
    assert driver.entry(spark).count() == 54

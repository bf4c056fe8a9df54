"""Every registered query against its SQL on whole tables."""

import pytest

import __spark_entry__ as driver
import compare

CHECKED = sorted(driver.oracle_sql())
OTHERS = sorted(set(driver.queries()) - set(driver.oracle_sql()))


@pytest.fixture(scope="module")
def connection(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, sf, connection, name):
    assert compare.differences(driver.queries()[name](spark, sf), connection, driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", OTHERS)
def test_has_rows(spark, sf, name):
    assert driver.queries()[name](spark, sf).limit(1).count() == 1


def test_entry_has_one_row(spark):
    assert driver.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())

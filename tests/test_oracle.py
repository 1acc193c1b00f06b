"""Every registered query with an SQL twin gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as driver
from listloom.plans import catalog
from tests.compare import differences

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert driver.entry(spark).limit(5).count() == 5


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_driver_lists_them_all():
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql())

"""Every registered query against its SQL, and the driver's entry point."""

import check
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
SQL = entry_point.ORACLES
QUERIES = entry_point.QUERIES


@pytest.fixture(scope="module")
def db():
    return check.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    assert check.compare(spark, db, SF, name) == ""


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10

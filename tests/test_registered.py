"""Registered queries against their SQL on the small tables."""

import pytest

import __spark_entry__ as entry_points
from checks.compare import database, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_its_counterpart():
    missing = set(entry_points.queries()) - set(entry_points.oracle_sql())
    assert not {n for n in missing if n != "pipeline" and not n.startswith("op")}
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 188


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query(spark, con, name):
    assert differences(spark, con, name, FOLDER) == ""

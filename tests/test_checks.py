"""Every registered query with a check statement gives the statement's rows."""

import pytest

import __spark_entry__ as entry_points
from nascent.plans import catalog, checking


@pytest.fixture(scope="module")
def con(data):
    return checking.connect(data)


@pytest.mark.parametrize("name", sorted(catalog.CHECKS))
def test_same_as_sql(spark, data, con, name):
    assert checking.differences(catalog.QUERIES[name](spark, data), con, catalog.CHECKS[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.CHECKS)))
def test_gives_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["window_id", "complaints", "share", "size_rank"]
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())

"""Every registered query against its SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry_points
from cairnframe.plans.catalog import QUERIES as CATALOG
from check import compare, connect

from .conftest import SF_DIR

QUERIES = {key: run for key, run in entry_points.queries().items() if key in CATALOG}
SQL = {key: text for key, text in entry_points.oracle_sql().items() if key in CATALOG}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_rows(spark, con, key):
    problem = compare(QUERIES[key](spark, SF_DIR), con, SQL[key])
    assert problem is None, problem


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, key):
    assert QUERIES[key](spark, SF_DIR).count() > 0


def test_entry_has_stable_columns(spark):
    assert entry_points.entry(spark).columns == ["query_id", "id", "score", "rank"]

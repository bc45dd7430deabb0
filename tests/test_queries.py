"""Every named query against its SQL on the small tables."""

import pytest

from __spark_entry__ import entry
from check_queries import compare
from tallypost.plans.catalog import QUERIES
from tallypost.plans.oracle import SQL


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, name):
    assert compare(spark, name, small) is None


def test_entry(spark):
    counts = {r["status"]: r["ids"] for r in entry(spark).collect()}
    assert counts == {"confirmed": 836, "late": 139, "orphan": 20, "pending": 25}

"""Every query against its SQL."""

from __future__ import annotations

import pytest
from loamworks.plans import queries as q

from .conftest import same_rows


def test_each_query_has_sql():
    assert set(q.QUERIES) == set(q.SQL)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, small, tables, name):
    same_rows(q.QUERIES[name](spark, small), tables.sql(q.SQL[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 34
    assert set(e.oracle_sql()) <= set(e.queries())

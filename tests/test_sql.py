"""Every query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from quarrylight.plans import catalog, core_problems
from tests.conftest import compare_with_sql

QUERIES = catalog.QUERIES | core_problems.QUERIES
SQL = catalog.SQL | core_problems.SQL
EMPTY = {"bm25_and_missing"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    n = compare_with_sql(spark, small, QUERIES[name], SQL[name])
    assert n or name in EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())

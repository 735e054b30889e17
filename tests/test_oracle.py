"""Every query with SQL gives the rows that DuckDB gives; the others run."""

from __future__ import annotations

import pytest
from helpers import SF_DIR, compare

import __spark_entry__ as entry
from tracequarry.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_rows_match_sql(spark, name):
    compare(catalog.QUERIES[name](spark, SF_DIR), catalog.ORACLE_SQL[name], SF_DIR)


def test_every_query_has_sql():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Numbered queries against their SQL, on the whole tables."""

import pytest
from helpers import compare

from tracequarry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_match_sql(spark, name):
    d = "/root/testdata/sf0.01"
    compare(queries.QUERIES[name](spark, d), queries.ORACLE_SQL[name], d)

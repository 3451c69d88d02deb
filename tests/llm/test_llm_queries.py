"""Queries that SQL can express, against their SQL."""

import pytest
from oracle import compare

from annals.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    compare(spark, "/root/testdata/sf0.001", queries.QUERIES[name], queries.SQL[name])

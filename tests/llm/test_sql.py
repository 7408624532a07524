"""Every query of the subpackage that has SQL against it."""

from __future__ import annotations

import pytest
from oracle import compare, views

from veridoc.llm import queries


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, data, name):
    assert compare(spark, con, name, queries.QUERIES[name], queries.SQL[name], data) is None

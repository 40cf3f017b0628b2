"""Queries with SQL counterparts, on the given tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import oracle  # noqa: E402

from fenestra.llm.oracles import oracle_sql  # noqa: E402
from fenestra.llm.queries import all_queries  # noqa: E402

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    assert oracle.compare(oracle.connect(sf), all_queries()[name](spark, sf), SQL[name]) == ""


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in all_queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(SQL) <= set(all_queries())

"""Queries with SQL give the same rows as DuckDB; all of them run over the small tables."""

import pytest
from conftest import SMALL, same

from galewatch.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, SMALL, QUERIES[name], ORACLES[name])


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}

"""Every query with SQL gives the same rows as DuckDB."""

import pytest
from conftest import SMALL, same

from galewatch.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, SMALL, QUERIES[name], ORACLES[name])


def test_flagship_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pytest
from compare import duck, same

from lumenframe import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, small, name):
    same(catalog.QUERIES[name](spark, small).toPandas(), duck(small).sql(catalog.SQL[name]).df())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

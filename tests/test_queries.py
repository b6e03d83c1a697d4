"""Every registered query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

import pytest
from conftest import DATA, same_rows

from flowfeat.plans import registry

SLOW = {"k19_fit_and_score"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas(), duck.sql(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - SLOW))
def test_query_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

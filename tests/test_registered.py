"""Every registered query equals its SQL on the smallest tables."""

import pytest
from compare import difference, sql_rows

import __spark_entry__ as entry_points
from vectide.plans.registered import REGISTERED

QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


def test_all_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    # Approximate search has no SQL; its recall and its exact limit are tested instead.
    assert set(REGISTERED) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    assert len(rows)
    assert difference(rows, sql_rows(ORACLE[name], sf_dir)) is None


def test_entry(spark):
    found = entry_points.entry(spark)
    assert found.columns == ["query_id", "rank", "id", "score", "filename", "chunk", "text"]
    assert found.count() == 200

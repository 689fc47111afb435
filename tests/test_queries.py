import pytest

from mediacat.plans.catalog_queries import QUERIES, SQL
from oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, "/root/testdata/sf0.001")) == sql_rows(SQL[name], "sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_snippets_hold_marks(spark):
    assert all(r["marks"] >= 1 for r in QUERIES["snippet_terms"](spark, "/root/testdata/sf0.001").collect())

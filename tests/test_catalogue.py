import pytest

from sightline import catalogue

from .oracle import DATA, same


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_duckdb(spark, name):
    same(catalogue.QUERIES[name](spark, DATA), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

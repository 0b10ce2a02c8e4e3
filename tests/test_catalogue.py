"""Every registered query against DuckDB on the same tables; those without SQL must run and keep their schema."""

import pytest
from conftest import DATA, same_as_duckdb

from lodestone.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same_as_duckdb(QUERIES[name](spark, f"{DATA}/sf0.001"), SQL[name], f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)

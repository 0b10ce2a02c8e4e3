"""Registered queries over the test tables, with the SQL that must give the same rows.

In these queries a row of ``documents`` is a passage (its source stands for the law), a row of ``benchmark`` a question, and the vector
of the same id its embedding. What the tables lack (headings, citations, attacks) is planted by the same CASE in both engines.
Whole numbers and booleans are returned as longs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import documents_queries, retrieval_queries, service_queries

MODULES = (retrieval_queries, documents_queries, service_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}

"""Registered queries answer for the whole table, not for a part of it."""

from conftest import DATA, same_as_duckdb

from lodestone.operators import evaluate
from lodestone.plans import service_queries


def test_every_vector_gets_a_relevance(spark):
    query, sql = service_queries.QUERIES["answer_relevance_all"]
    rows = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").count()
    assert same_as_duckdb(query(spark, f"{DATA}/sf0.01"), sql, f"{DATA}/sf0.01") == rows > 40


def test_relevance_of_zero_null_and_lone_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 3.0], "a"), (3, [2.0, 0.0], "a"), (4, [0.0, 0.0], "a"), (5, [1.0, 0.0], "b"), (6, None, "a"), (7, [1.0, 0.0], None)]
    got = evaluate.group_relevance(spark.createDataFrame(rows, "qid int, v array<float>, group string")).collect()
    assert dict(got) == {1: 0.333333, 2: 0.0, 3: 0.333333, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0}

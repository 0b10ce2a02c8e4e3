"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(df: DataFrame) -> DataFrame:
    """Ints and booleans as longs, floats as doubles, so that both engines return the same types."""
    kinds = {"int": "bigint", "smallint": "bigint", "boolean": "bigint", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast(kinds[t]).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in df.dtypes])


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("law_id"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).join(vectors(spark, sf_dir).withColumnRenamed("chunk_id", "qid"), "qid").select("qid", "embedding", "label")


def quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def text_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tokens_sql(column: str, stop: list[str] = fixed.INDEX_STOP_WORDS) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda t: NOT list_contains({quoted(stop)}, t))"


def keywords_sql(column: str) -> str:
    return f"list_distinct({tokens_sql(column, fixed.KEYWORD_STOP_WORDS)})"


SPARSE_SQL = f"""
tok AS (SELECT doc_id AS chunk_id, source AS law_id, {tokens_sql('text')} AS toks FROM documents),
dl AS (SELECT chunk_id, len(toks) AS dl FROM tok),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
posted AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM tok) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM freq, stats),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN (SELECT avg(raw) FROM raw) * 0.25 ELSE raw END AS idf FROM raw),
qterm AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({tokens_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
sparse_all AS (
  SELECT qid, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM qterm JOIN idf USING (term) JOIN posted USING (term) JOIN dl USING (chunk_id), stats GROUP BY qid, chunk_id HAVING score > 0),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sparse_all) WHERE rank <= 20)
"""

DENSE_SQL = """
qv AS (SELECT item_id AS qid, embedding::DOUBLE[] AS qe, label AS qlabel FROM benchmark JOIN embeddings ON vec_id = item_id),
dense_all AS (SELECT qid, vec_id AS chunk_id, label, qlabel, round(list_cosine_similarity(embedding::DOUBLE[], qe), 6) AS score FROM embeddings, qv),
dense AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM dense_all) WHERE rank <= 20)
"""

FUSED_SQL = """
fused_all AS (
  SELECT qid, chunk_id, d.rank AS dense_rank, d.score AS dense_score, s.rank AS sparse_rank, s.score AS sparse_score,
    CASE WHEN d.rank IS NOT NULL AND s.rank IS NOT NULL THEN 'both' WHEN d.rank IS NOT NULL THEN 'dense' ELSE 'sparse' END AS source,
    round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 6) AS rrf_score
  FROM dense d FULL JOIN sparse s USING (qid, chunk_id)),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, chunk_id) AS fused_rank FROM fused_all) WHERE fused_rank <= 20)
"""

RERANK_SQL = rf"""
pairs AS (
  SELECT f.*, b.text AS question, d.text AS passage, {keywords_sql('b.text')} AS kw,
    list_distinct(regexp_extract_all(array_to_string(list_slice(regexp_extract_all(lower(d.text), '[a-z0-9]+|[^\sa-z0-9]'), 1, 384), ' '), '[a-z0-9]+')) AS held
  FROM fused f JOIN benchmark b ON b.item_id = f.qid JOIN documents d ON d.doc_id = f.chunk_id),
scored AS (SELECT *, round(len(list_intersect(kw, held))::DOUBLE / greatest(len(kw), 1) * 12 - 6, 6) AS rerank_score FROM pairs),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, chunk_id) AS final_rank FROM scored) WHERE final_rank <= 5)
"""
RETRIEVAL_SQL = ",".join((SPARSE_SQL, DENSE_SQL, FUSED_SQL))

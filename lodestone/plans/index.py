"""The index build: articles or documents to chunk, posting, length and vector tables with their report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, EngineConfig
from lodestone.operators import chunking, dense, evaluate
from lodestone.plans.ask import Index
from lodestone.sources import scratch, tables


def build_index(articles: DataFrame, path: str, config: EngineConfig = DEFAULTS, embedder: dense.Embedder | None = None) -> DataFrame:
    """Write all tables of the index under ``path`` and return the report, one row per law.

    Chunks are content-addressed, so a rerun writes the same ids. A chunk over the encoder's window fails the build. Vectors are
    computed only if the stored ones are missing or stale.
    """
    spark = articles.sparkSession
    model = embedder or dense.HashingEmbedder(config.embedding_dim)
    tables.write_chunks(chunking.checked(chunking.chunk_articles(articles, config), config), f"{path}/chunks")
    chunks = tables.load_chunks(spark, f"{path}/chunks")
    tables.write_sparse_index(chunks, path, config)
    tables.vectors_by_law(tables.ensure_vectors(chunks, f"{path}/vectors", model), chunks, f"{path}/vectors_by_law")
    evaluate.law_counts(chunks).write.mode("overwrite").parquet(f"{path}/index_meta")
    return spark.read.parquet(f"{path}/index_meta")


def load_index(spark: SparkSession, path: str) -> Index:
    """What ``build_index`` wrote, ready to be searched."""
    return Index(tables.load_chunks(spark, f"{path}/chunks"), spark.read.schema(tables.VECTORS).parquet(f"{path}/vectors"), tables.load_sparse_index(spark, path))


def index_of(passages: DataFrame, source: str, embedder: dense.Embedder | None = None, config: EngineConfig = DEFAULTS) -> Index:
    """The stored index of (chunk_id, text, ...) passages read from the files at ``source``; built on first use.

    It lies in the shared folder under a digest of those files and settings, so it is built again when a file has changed. Vectors are embedded and stored
    only with an ``embedder``; else the index has none.
    """
    spark = passages.sparkSession
    model = "" if embedder is None else f"{type(embedder).__name__}-{embedder.dim}"
    base = f"{scratch.shared_dir(spark)}/index-{scratch.fingerprint(spark, source)}"
    if not scratch.exists(spark, f"{base}/weights/_SUCCESS"):
        tables.write_sparse_index(passages.select("chunk_id", "text"), base, config)
    vectors = None
    if model:
        path = f"{base}/{model}"
        if not scratch.exists(spark, f"{path}/_SUCCESS"):
            dense.embed(passages.select("chunk_id", "text"), F.col("text"), embedder).select("chunk_id", "embedding").write.mode("overwrite").parquet(path)
        vectors = spark.read.parquet(path)
    return Index(passages, vectors, tables.load_sparse_index(spark, base))

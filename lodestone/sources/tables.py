"""Index tables: writing, reading with fixed schemas, staleness, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, EngineConfig
from lodestone.operators import dense, sparse
from lodestone.sources.scratch import discard, stored

CHUNKS = "chunk_id string, law_id string, law_label string, law_title string, part_id string, part_title string, article_no int, article_title string, section string, seq int, seq_total int, page_start int, page_end int, text string, token_count int, unit_label string"
VECTORS = "chunk_id string, embedding array<float>"


def write_chunks(chunks: DataFrame, path: str, form: str = "parquet") -> None:
    chunks.select(*[c.split()[0] for c in CHUNKS.split(", ")]).write.mode("overwrite").format(form).save(path)


def load_chunks(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Chunks by their schema. A malformed JSON line fails; blank lines are skipped."""
    reader = spark.read.schema(CHUNKS)
    return reader.option("mode", "FAILFAST").json(path) if form == "json" else reader.format(form).load(path)


def write_vectors(vectors: DataFrame, path: str, dim: int) -> None:
    """float32 vectors; one of another length fails the write."""
    fits = F.when(F.size("embedding") == dim, True).otherwise(F.raise_error(F.concat(F.lit("a vector has a wrong length: "), F.col("chunk_id"))).cast("boolean"))
    vectors.select("chunk_id", "embedding").where(fits).write.mode("overwrite").parquet(path)


def vectors_are_stale(chunks: DataFrame, vectors: DataFrame, dim: int) -> bool:
    """True if the vectors don't cover the chunks one to one in the right length; then they are to be computed anew."""
    short = vectors.agg(F.count("*"), F.count_if(F.size("embedding") != dim)).first()
    return chunks.count() != short[0] or short[1] > 0 or not chunks.join(vectors, "chunk_id", "left_anti").isEmpty()


def load_vectors(spark: SparkSession, path: str, chunks: DataFrame, dim: int) -> DataFrame | None:
    """The stored vectors, or None if they are missing or stale."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema(VECTORS).parquet(path)
    except AnalysisException:
        return None
    return None if vectors_are_stale(chunks, found, dim) else found


def write_sparse_index(chunks: DataFrame, path: str, config: EngineConfig = DEFAULTS) -> None:
    """Postings, weights and statistics: the tokens, never a scorer. A corpus without passages is an error.

    Postings lie sorted by term in each file, as the counting dealt them by passage and term: a search skips the row groups of other terms, a hot
    term is spread over all files, and nothing is shuffled a second time.
    """
    sparse.corpus_stats(sparse.lengths(chunks)).write.mode("overwrite").parquet(f"{path}/stats")
    stats = chunks.sparkSession.read.parquet(f"{path}/stats")
    if not stats.first()["n"]:
        raise ValueError("there are no passages to index")
    posted = sparse.postings(chunks).sortWithinPartitions("term", "chunk_id")
    posted.write.mode("overwrite").parquet(f"{path}/postings")
    posted = chunks.sparkSession.read.parquet(f"{path}/postings")
    sparse.idf(sparse.document_frequencies(posted), stats, config).write.mode("overwrite").parquet(f"{path}/weights")


def load_sparse_index(spark: SparkSession, path: str) -> sparse.SparseIndex:
    n, avgdl = spark.read.parquet(f"{path}/stats").select("n", "avgdl").first()
    return sparse.SparseIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/weights"), n, avgdl)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Content-addressed rows: those of ``new`` replace equal ids, others stay."""
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def recreate(spark: SparkSession, path: str) -> None:
    """An empty collection of vectors in place of whatever is there."""
    spark.createDataFrame([], VECTORS).write.mode("overwrite").parquet(path)


def upsert(path: str, ids: DataFrame, vectors: DataFrame, dim: int) -> None:
    """Put vectors into the collection at ``path``; each id has one vector, else nothing is written."""
    if ids.count() != vectors.count() or not ids.join(vectors, "chunk_id", "left_anti").isEmpty():
        raise ValueError("ids and vectors differ in number")
    spark = ids.sparkSession
    merged = stored(upserted(spark.read.schema(VECTORS).parquet(path), vectors.select("chunk_id", "embedding")), "upsert")
    write_vectors(merged, path, dim)
    discard(merged)


def point_counts(chunks: DataFrame, points: DataFrame) -> tuple[int, int]:
    return chunks.count(), points.count()


def ensure_vectors(chunks: DataFrame, path: str, model: dense.Embedder) -> DataFrame:
    """The collection at ``path``, computed anew if it is missing or doesn't cover the chunks."""
    spark = chunks.sparkSession
    found = load_vectors(spark, path, chunks, model.dim)
    if found is None:
        write_vectors(dense.embed(chunks, F.col("text"), model).select("chunk_id", "embedding"), path, model.dim)
        found = spark.read.schema(VECTORS).parquet(path)
    return found


def vectors_by_law(vectors: DataFrame, chunks: DataFrame, path: str) -> None:
    """The payload index: vectors in a folder per law, so a search with a law filter reads that law's files only."""
    vectors.join(chunks.select("chunk_id", "law_id"), "chunk_id").write.mode("overwrite").partitionBy("law_id").parquet(path)

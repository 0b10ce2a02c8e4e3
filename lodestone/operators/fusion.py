"""Reciprocal rank fusion and hybrid retrieval with the whole score trail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, EngineConfig
from lodestone.operators.sparse import ranked


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = DEFAULTS.rrf_k) -> DataFrame:
    """(qid, chunk_id, rrf_score): the sum of 1 / (k + rank) over ranked (qid, chunk_id, rank) lists."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if not lists:
        raise ValueError("there is nothing to fuse")
    both = reduce(DataFrame.unionByName, [x.select("qid", "chunk_id", "rank") for x in lists])
    return both.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"))


def fuse(dense: DataFrame, sparse: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """All fused candidates of (qid, chunk_id, score, rank) lists, unranked, with source and both trails."""
    d = dense.select("qid", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("qid", "chunk_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))
    part = lambda c: F.coalesce(1.0 / (config.rrf_k + F.col(c)), F.lit(0.0))
    source = F.when(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull(), "both").when(F.col("dense_rank").isNotNull(), "dense").otherwise("sparse")
    return d.join(s, ["qid", "chunk_id"], "full_outer").withColumn("source", source).withColumn("rrf_score", F.round(part("dense_rank") + part("sparse_rank"), 6))


def top_fused(fused: DataFrame, config: EngineConfig = DEFAULTS, number: bool = True) -> DataFrame:
    """The best by fused score; workspaces leave ``fused_rank`` null."""
    out = ranked(fused, config.fused_top_k, "rrf_score", "fused_rank")
    return out if number else out.withColumn("fused_rank", F.lit(None).cast("int"))


def fusion_stats(questions: DataFrame, fused: DataFrame) -> DataFrame:
    """Per question, over all candidates: dense_hits, sparse_hits, overlap, best_dense (null without dense hits)."""
    per = fused.groupBy("qid").agg(
        F.count("dense_rank").alias("dense_hits"), F.count("sparse_rank").alias("sparse_hits"),
        F.count_if(F.col("source") == "both").alias("overlap"), F.max("dense_score").alias("best_dense"),
    )
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return questions.select("qid").distinct().join(per, "qid", "left").select("qid", none("dense_hits"), none("sparse_hits"), none("overlap"), "best_dense")


def ladder(trail: DataFrame) -> DataFrame:
    """The score trail as one line: ``D·rank S·rank → RRF score → CE score``, with dashes for gaps."""
    mark = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    rrf = F.coalesce(F.regexp_replace(F.format_string("%.4f", F.round("rrf_score", 4)), "^0", ""), F.lit("—"))
    ce = F.when(F.col("rerank_score").isNotNull(), F.concat(F.lit(" → CE "), F.when(F.col("rerank_score") >= 0, "+").otherwise(""), F.format_string("%.2f", F.round("rerank_score", 2)))).otherwise("")
    return trail.withColumn("ladder", F.concat(F.lit("D·"), mark("dense_rank"), F.lit(" S·"), mark("sparse_rank"), F.lit(" → RRF "), rrf, ce))

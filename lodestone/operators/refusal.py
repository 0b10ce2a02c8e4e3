"""The refusal gate over reranked evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, EngineConfig


def refusal_gate(questions: DataFrame, reranked: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(qid, covered, signal, best_score, best_dense, floor, dense_floor) of questions (qid, scope_signal, best_dense).

    In this order: out of scope, however high the scores; nothing retrieved; the best cosine below its floor; covered if the
    best pair score is null or at least the floor; else below it.
    """
    best = reranked.where("final_rank = 1").select("qid", F.col("rerank_score").alias("best_score"), F.lit(True).alias("_any"))
    joined = questions.select("qid", "scope_signal", "best_dense").join(best, "qid", "left")
    signal = (
        F.when(F.col("scope_signal").isNotNull(), F.col("scope_signal"))
        .when(F.col("_any").isNull(), "empty-retrieval")
        .when(F.col("best_dense") < config.refusal_dense_floor, "below-domain-floor")
        .when(F.col("best_score").isNull() | (F.col("best_score") >= config.refusal_score_floor), "")
        .otherwise("below-relevance-floor")
    )
    out = joined.withColumn("signal", signal).withColumn("covered", F.col("signal") == "")
    return out.select("qid", "covered", "signal", "best_score", "best_dense", F.lit(config.refusal_score_floor).alias("floor"), F.lit(config.refusal_dense_floor).alias("dense_floor"))


def evidence(gated: DataFrame, reranked: DataFrame) -> DataFrame:
    """All reranked rows of covered questions."""
    return reranked.join(gated.where("covered").select("qid"), "qid", "left_semi")


def near_misses(gated: DataFrame, reranked: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """The first reranked rows of refused questions."""
    return reranked.where(F.col("final_rank") <= config.near_miss_count).join(gated.where("NOT covered").select("qid"), "qid", "left_semi")

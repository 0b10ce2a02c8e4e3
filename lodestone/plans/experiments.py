"""Measurements over whole runs: chunk sizes with their hits, and a rehearsal of expected kinds of answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, EngineConfig
from lodestone.operators import chunking, dense, evaluate, rerank
from lodestone.plans.ask import Index, rank, retrieve
from lodestone.sources.scratch import stored


def chunk_size_hits(
    articles: DataFrame, labels: DataFrame, targets: tuple[int, ...] = (300, 600, 1000), config: EngineConfig = DEFAULTS, embedder: dense.Embedder | None = None, scorer: rerank.PairScorer | None = None,
) -> DataFrame:
    """Per target, capped to the encoder's window and not: chunk statistics, and hit rates of the answerable labels at 1 and at ``rerank_top_k``.

    Labels are (qid, question, law_id, article_no, part). Each arm has its own tables, so the production index is never touched.
    """
    model = embedder or dense.HashingEmbedder(config.embedding_dim)
    out = []
    for target in targets:
        for capped in (True, False):
            chunks = stored(chunking.chunk_articles(articles, config, target, capped), "arm")
            index = Index(chunks, stored(dense.embed(chunks.select("chunk_id", "text"), F.col("text"), model).select("chunk_id", "embedding"), "arm-vectors"))
            asked = labels.select("qid", "question")
            ranked = rank(asked, retrieve(asked, index, config, model)[0], index, config, scorer).withColumn("rank", F.col("final_rank"))
            gold = evaluate.gold_ranks(labels, ranked).agg(
                F.round(F.avg(F.coalesce(F.col("gold_rank") == 1, F.lit(False)).cast("double")), 4).alias("hit_rate_at_1"),
                F.round(F.avg(F.coalesce(F.col("gold_rank") <= config.rerank_top_k, F.lit(False)).cast("double")), 4).alias("hit_rate_at_5"),
            )
            stats = chunking.chunk_stats(chunks, config.embedding_max_tokens).withColumn("target", F.lit(target)).withColumn("capped", F.lit(capped))
            out.append(stats.crossJoin(gold))  # one row each
    return reduce(DataFrame.unionByName, out)


def rehearsed(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """(qid, label, expected, kind, passed) of (qid, label, expected) cases against the answers; a case without an answer fails."""
    joined = cases.join(answers.select("qid", "kind"), "qid", "left")
    return joined.select("qid", "label", "expected", "kind", F.coalesce(F.col("kind") == F.col("expected"), F.lit(False)).alias("passed"))

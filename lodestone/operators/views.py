"""Result records as they go out: fixed columns, rounded figures, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import chunk_heading, citation_key, probability

STAGES = ["gate_ms", "retrieval_ms", "rerank_ms", "generation_ms", "verify_ms", "total_ms"]


def chunk_views(scored: DataFrame) -> DataFrame:
    """Scored chunks with their heading, citation key and displayed probability."""
    c = F.col
    heading = chunk_heading(c("law_label"), c("unit_label"), c("article_no"), c("article_title"), c("seq"), c("seq_total"))
    return scored.select(
        "qid", "chunk_id", "law_id", "law_label", "law_title", "part_title", "article_no", "article_title", "section", "seq", "seq_total", "page_start", "page_end", "text",
        heading.alias("heading"), citation_key(c("law_id"), c("part_id"), c("article_no")).alias("citation_key"), "source", "dense_rank", "dense_score", "sparse_rank", "sparse_score",
        "rrf_score", "fused_rank", "rerank_score", probability(c("rerank_score")).alias("rerank_probability"), "final_rank",
    )


def timing_views(timings: DataFrame) -> DataFrame:
    """Stage times to one place."""
    return timings.select("qid", *[F.round(s, 1).alias(s) for s in STAGES])


def usage_views(usage: DataFrame) -> DataFrame:
    """Tokens, and dollars to six places."""
    return usage.select("qid", "input_tokens", "output_tokens", F.round("usd", 6).alias("usd"))


def gate_views(gated: DataFrame) -> DataFrame:
    return gated.select("qid", "decision", "search_query", "rewritten", "reason", "signals", "engine")


def answer_views(answers: DataFrame, citations: DataFrame, evidence: DataFrame, near_misses: DataFrame) -> DataFrame:
    """(qid, record): one JSON record per answer (qid, kind, answer, engine) with its citations, evidence and near misses in order.

    What is gathered per question is bounded by the rerank limit and the length of an answer.
    """
    def listed(rows: DataFrame, order: str, name: str) -> DataFrame:
        item = F.struct(F.col(order).alias("_order"), F.struct(*[c for c in rows.columns if c != "qid"]).alias("item"))
        return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias(name))

    out = answers.join(listed(citations, "pos", "citations"), "qid", "left").join(listed(evidence, "final_rank", "evidence"), "qid", "left").join(listed(near_misses, "final_rank", "near_misses"), "qid", "left")
    lists = [F.coalesce(c, F.from_json(F.lit("[]"), out.schema[c].dataType)).alias(c) for c in ("citations", "evidence", "near_misses")]
    return out.select("qid", F.to_json(F.struct("kind", F.col("answer").alias("text"), "engine", *lists)).alias("record"))


def write_report(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines, replacing what was there."""
    metrics.write.mode("overwrite").json(path)

"""A batch of questions end to end: guard, retrieval, fusion, reranking, refusal, answer, verification."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, EngineConfig
from lodestone.functions.text import citation_key
from lodestone.operators import answer, dense, fusion, guard, refusal, rerank, sparse, verify
from lodestone.sources.scratch import stored


@dataclass(frozen=True)
class Index:
    """What a search reads: chunks with their text, (chunk_id, embedding) vectors, and the stored sparse index.

    Without the latter each search reads the chunks' texts anew.
    """

    chunks: DataFrame
    vectors: DataFrame | None
    sparse: sparse.SparseIndex | None = None


class Watch:
    """Milliseconds of each stage of a batch, as they pass; ``rows`` gives them per question, as the service reports them."""

    def __init__(self) -> None:
        self.spent: dict[str, float] = {}
        self._from = time.monotonic()

    def lap(self, stage: str) -> None:
        now = time.monotonic()
        self.spent[stage], self._from = self.spent.get(stage, 0.0) + 1000 * (now - self._from), now

    def rows(self, questions: DataFrame) -> DataFrame:
        """(qid, gate_ms, retrieval_ms, rerank_ms, generation_ms, verify_ms, total_ms): the batch's times, shared equally."""
        n = max(1, questions.count())
        stages = ("gate", "retrieval", "rerank", "generation", "verify")
        shares = [F.lit(self.spent.get(s, 0.0) / n).alias(f"{s}_ms") for s in stages]
        return questions.select("qid", *shares, F.lit(sum(self.spent.values()) / n).alias("total_ms"))

    def spans(self, trace_id: str) -> list[tuple[str, str, float, float]]:
        """(trace_id, span, begin_ms, end_ms) of the stages in order: what a tracing backend takes."""
        out, at = [], 0.0
        for stage, spent in self.spent.items():
            out.append((trace_id, stage, at, at + spent))
            at += spent
        return out


def fused_candidates(questions: DataFrame, index: Index, config: EngineConfig = DEFAULTS, embedder: dense.Embedder | None = None) -> DataFrame:
    """All fused candidates of (qid, question) with an optional ``embedding`` and an optional ``law_id``, as a stored table.

    It has at most both limits per question. With a ``law_id``, vector hits are of that law before the limit, term hits after it.
    """
    vectors = questions.select("qid", "embedding") if "embedding" in questions.columns else dense.embed_questions(questions.select("qid", "question"), embedder, config)
    asked = questions.select("qid", "question")
    if "law_id" not in questions.columns:
        by_vector = dense.search(index.vectors, vectors, config.dense_top_k, config)
        by_term = sparse.search(index.sparse or index.chunks.select("chunk_id", "text"), asked, config.sparse_top_k, config)
        return stored(fusion.fuse(by_vector, by_term, config), "fused")
    laws = questions.where("law_id IS NOT NULL").select("qid", "law_id")
    owned = index.vectors if "law_id" in index.vectors.columns else index.vectors.join(index.chunks.select("chunk_id", "law_id"), "chunk_id")
    free, bound = vectors.join(laws, "qid", "left_anti"), vectors.join(laws, "qid")
    by_vector = dense.search(index.vectors, free, config.dense_top_k, config).unionByName(dense.search(owned, bound, config.dense_top_k, config, key="law_id"))
    hits = sparse.search(index.sparse or index.chunks.select("chunk_id", "text"), asked, config.sparse_top_k, config)
    by_term = hits.join(laws, "qid", "left_anti").unionByName(sparse.restricted(hits, index.chunks, laws, config.sparse_top_k))
    return stored(fusion.fuse(by_vector, by_term, config), "fused")


def retrieve(questions: DataFrame, index: Index, config: EngineConfig = DEFAULTS, embedder: dense.Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(fused candidates with the score trail, per-question stats). In a workspace ``fused_rank`` stays null.

    Passage texts are joined only after the top-k.
    """
    fused = fused_candidates(questions, index, config, embedder)
    return fusion.top_fused(fused, config, number=config.source_profile != "workspace"), fusion.fusion_stats(questions, fused)


def rank(questions: DataFrame, candidates: DataFrame, index: Index, config: EngineConfig = DEFAULTS, scorer: rerank.PairScorer | None = None) -> DataFrame:
    """Candidates with their passages, reranked, as a stored table: a few rows per question."""
    rows = candidates.join(index.chunks, "chunk_id").join(questions.select("qid", "question"), "qid")
    return stored(rerank.rerank(rows, config, scorer), "ranked")


def unknown_law_text(known: DataFrame, limit: int = 50) -> str:
    """The names of the laws that may be asked for, the first ``limit`` of them."""
    names = [r["law_id"] for r in known.select("law_id").distinct().orderBy("law_id").limit(limit).collect()]
    return "Known laws: " + ", ".join(names) if names else "The index is empty."


def ask(
    questions: DataFrame, index: Index, config: EngineConfig = DEFAULTS, embedder: dense.Embedder | None = None, scorer: rerank.PairScorer | None = None, watch: Watch | None = None,
) -> DataFrame:
    """One row per question (qid, question, previous): kind, answer, signal, citation counts and best score.

    Blocked questions skip retrieval; refused ones name their signal; an uncited decline counts as a refusal. With a ``law_id`` column, which may be
    null, a question is answered from that law; one that the index doesn't hold is the caller's error (kind ``invalid``), not a refusal.
    """
    watch = watch or Watch()
    none, nothing = F.lit(0).cast("long"), F.lit(None)
    law = ["law_id"] if "law_id" in questions.columns else []
    invalid = None
    if law:
        wrong = guard.unknown_laws(questions, index.chunks)
        invalid = wrong.select("qid", F.lit("invalid").alias("kind"), F.lit(unknown_law_text(index.chunks)).alias("answer"), none.alias("cited"), none.alias("unsupported_count"),
                               F.lit("unknown-law").alias("signal"), F.lit("").alias("search_query"), nothing.cast("double").alias("best_score"))
        questions = questions.join(wrong.select("qid"), "qid", "left_anti")
    gated = stored(guard.gate(questions), "gated")
    blocked = gated.where("decision = 'block'")
    asked = gated.where("decision = 'allow'").select("qid", F.col("search_query").alias("question"), *law)
    watch.lap("gate")
    candidates, stats = retrieve(asked, index, config, embedder)
    watch.lap("retrieval")
    ranked = rank(asked, candidates, index, config, scorer)
    watch.lap("rerank")
    scoped = guard.check_scope(asked) if config.source_profile == "corpus" else asked.withColumn("scope_signal", F.lit(None).cast("string"))
    verdict = refusal.refusal_gate(scoped.join(stats.select("qid", "best_dense"), "qid"), ranked, config)
    used = refusal.evidence(verdict, ranked).withColumn("citation_key", citation_key(F.col("law_id"), F.col("part_id"), F.col("article_no")))
    covered = asked.join(verdict.where("covered").select("qid"), "qid", "left_semi")
    answers = stored(answer.offline_answers(covered, used, profile=config.source_profile), "answers")
    watch.lap("generation")
    report = verify.reports(answers, verify.verified(verify.citations(answers, ["qid"]), used, ["qid"]), ["qid"])
    decided = answers.join(report, "qid").withColumn("kind", F.when(answer.looks_like_refusal(F.col("answer"), F.col("verified_count")), "refusal").otherwise("answer"))
    columns = ["qid", "kind", "answer", "cited", "unsupported_count"]
    refused = verdict.where("NOT covered").select("qid", F.lit("refusal").alias("kind"), F.lit(answer.refusal_text(config.source_profile)).alias("answer"), none.alias("cited"), none.alias("unsupported_count"))
    stopped = blocked.select("qid", F.lit("blocked").alias("kind"), F.col("reason").alias("answer"), none.alias("cited"), none.alias("unsupported_count"))
    out = decided.select(*columns).unionByName(refused).unionByName(stopped)
    signal = F.when(F.size("signals") > 0, F.array_join("signals", ",")).otherwise(F.col("signal"))
    out = out.join(gated.select("qid", "signals", "search_query"), "qid").join(verdict.select("qid", "signal", "best_score"), "qid", "left").withColumn("signal", signal).drop("signals")
    if invalid is not None:
        out = out.unionByName(invalid)
    out = stored(out.withColumn("engine", F.lit("offline-extractive")), "asked")
    watch.lap("verify")
    return out

"""Reranking of a short candidate list by a pluggable pair scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, EngineConfig
from lodestone.functions import fixed
from lodestone.functions.text import keywords


class PairScorer(Protocol):
    def score(self, question: str, passages: list[str]) -> list[float]: ...


def prepared(text: Column, config: EngineConfig = DEFAULTS) -> Column:
    """The passage's first ``rerank_max_tokens`` counted tokens, joined by spaces."""
    found = F.regexp_extract_all(F.lower(text), F.lit(fixed.COUNTED_TOKEN), 0)
    return F.array_join(F.slice(found, 1, config.rerank_max_tokens), " ")


def lexical_logit(question: Column, passage: Column) -> Column:
    """The offline scorer: the share of the question's keywords that the passage holds, from -6 to 6. Not a model's score."""
    asked = keywords(question)
    held = F.array_distinct(F.regexp_extract_all(passage, F.lit(fixed.TOKEN), 0))
    share = F.size(F.array_intersect(asked, held)) / F.greatest(F.size(asked), F.lit(1))
    return F.round(share * 12 - 6, 6)


def rerank(candidates: DataFrame, config: EngineConfig = DEFAULTS, scorer: PairScorer | None = None, cut: Callable[[str, int], str] | None = None) -> DataFrame:
    """Candidates (qid, question, chunk_id, text, ...) with rerank_score, the best ``rerank_top_k`` by final_rank.

    A scorer gets passages of one question by length, ``rerank_batch_size`` at a time; truncation comes first, so the order
    of batches can't change a score. Null scores rank as 0. ``cut`` truncates by a model's own tokens (``models.SubwordCounter.cut``).
    """
    if cut is None:
        passage = prepared(F.col("text"), config)
    else:
        most = config.rerank_max_tokens

        @F.pandas_udf("string")
        def shortened(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield part.map(lambda t: None if t is None else cut(t, most))

        passage = shortened(F.col("text"))
    rows = candidates.withColumn("_passage", passage)
    if scorer is None:
        rows = rows.withColumn("rerank_score", lexical_logit(F.col("question"), F.col("_passage")))
    else:
        size = config.rerank_batch_size

        @F.pandas_udf("double")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for question, passage in parts:
                out = pd.Series([None] * len(question), dtype="float64")
                for q, group in passage.groupby(question.values):
                    order = group.str.len().sort_values(kind="stable").index
                    for at in range(0, len(order), size):
                        which = order[at : at + size]
                        out.loc[which] = scorer.score(q, passage.loc[which].tolist())
                yield out

        rows = rows.withColumn("rerank_score", run.asNondeterministic()("question", "_passage"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.coalesce("rerank_score", F.lit(0.0))), "chunk_id")
    return rows.drop("_passage").withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= config.rerank_top_k)


def passthrough(candidates: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """The first of the fused order, without a score."""
    kept = candidates.where(F.col("fused_rank") <= config.rerank_top_k)
    return kept.withColumn("rerank_score", F.lit(None).cast("double")).withColumn("final_rank", F.col("fused_rank"))

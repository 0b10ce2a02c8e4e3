"""The input gate: screening, follow-up rewriting, history, scope."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, EngineConfig
from lodestone.functions import fixed
from lodestone.functions.text import json_object, stripped, without_hidden, words


def signals(text: Column) -> Column:
    """The names of all screening families that match, in their order."""
    tests = [(n, p) for n, p in fixed.INJECTION] + [("encoded-payload", fixed.ENCODED_BLOB), ("hidden-characters", fixed.HIDDEN)]
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in tests]))


def previous_user_turn(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with ``previous``: the last user text before each."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("previous", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))


def rewritten(question: Column, previous: Column) -> Column:
    """A short follow-up with the previous user turn before it; longer questions unchanged."""
    bare = stripped(question)
    short = F.size(words(bare)) <= fixed.STANDALONE_WORDS
    return F.when(short & previous.isNotNull(), F.concat(stripped(previous), F.lit(" "), bare)).otherwise(bare)


def gate(questions: DataFrame) -> DataFrame:
    """Adds decision, reason, signals (three at most), search_query and rewritten to (question, previous) rows.

    Nothing but hidden characters: blocked. Any family that matches the text as sent: blocked. Else allowed.
    """
    cleaned = stripped(without_hidden(F.col("question")))
    found = signals(F.col("question"))
    out = questions.withColumn("_cleaned", cleaned).withColumn("_found", F.when(F.col("_cleaned") == "", F.array(F.lit("empty-question"))).otherwise(found))
    blocked = F.size("_found") > 0
    out = out.withColumn("decision", F.when(blocked, "block").otherwise("allow")).withColumn("signals", F.slice("_found", 1, fixed.MAX_SIGNALS))
    query = F.when(blocked, "").otherwise(rewritten(F.col("_cleaned"), F.col("previous")))
    out = out.withColumn("search_query", query).withColumn("rewritten", ~blocked & (F.col("search_query") != F.col("_cleaned")))
    reason = F.when(F.col("_cleaned") == "", "empty question").when(blocked, "an attempt to change how the system works").otherwise("")
    return out.withColumn("reason", reason).withColumn("engine", F.lit("deterministic")).drop("_cleaned", "_found")


def with_model(gated: DataFrame, verdicts: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Fold a gate model's parsed replies (qid, decision, query, reason) in: it may add blocks, never lift one.

    A missing or unparsed reply keeps the deterministic result with the signal ``gate-model-unavailable``.
    """
    v = verdicts.select("qid", F.col("decision").alias("m_decision"), F.col("query").alias("m_query"), F.col("reason").alias("m_reason"))
    joined = gated.join(v, "qid", "left")
    failed = F.col("m_decision").isNull()
    stop = (F.col("decision") == "block") | (F.col("m_decision") == "block")
    query = F.substring(F.coalesce(F.nullif(stripped(F.col("m_query")), F.lit("")), F.col("search_query")), 1, config.max_question_chars)
    return joined.select(
        *[c for c in gated.columns if c not in ("decision", "search_query", "signals", "reason", "engine")],
        F.when(stop, "block").otherwise("allow").alias("decision"),
        F.when(stop, "").otherwise(F.when(failed, F.col("search_query")).otherwise(query)).alias("search_query"),
        F.when(failed & (F.col("decision") == "allow"), F.array_append("signals", F.lit("gate-model-unavailable"))).otherwise(F.col("signals")).alias("signals"),
        F.coalesce(F.when(F.col("m_decision") == "block", F.col("m_reason")), F.col("reason")).alias("reason"),
        F.when(failed, "deterministic").otherwise("model").alias("engine"),
    )


class GateModel(Protocol):
    def reply(self, transcript: str, question: str) -> str: ...


VERDICT = "decision string, query string, reason string"


def transcripts(turns: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(conv_id, transcript): the last turns of each conversation as ``role: text`` lines, oldest first; a few rows per group."""
    line = F.concat("role", F.lit(": "), "text")
    kept = trimmed_history(turns, config).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return kept.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("transcript"))


def model_verdicts(asked: DataFrame, model: GateModel) -> DataFrame:
    """(qid, decision, query, reason) of (qid, transcript, question): the model's parsed replies; a failed call or a bad reply gives no decision."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for transcript, question in parts:
            out = []
            for t, q in zip(transcript, question, strict=True):
                try:
                    out.append(model.reply(t or "", q))
                except Exception:  # the model is foreign code; without it the deterministic result stands
                    out.append(None)
            yield pd.Series(out, dtype=object)

    reply = json_object(run.asNondeterministic()("transcript", "question"), VERDICT)
    rows = asked.select("qid", reply.alias("r")).select("qid", "r.*")
    good = F.col("decision").isin("allow", "block")
    return rows.select("qid", *[F.when(good, F.col(c)).alias(c) for c in ("decision", "query", "reason")])


def trimmed_history(turns: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """The last ``max_history_turns`` turns of each conversation, with ``age`` from 1, the newest."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= config.max_history_turns)


def scope_signal(question: Column) -> tuple[Column, Column]:
    """(signal, name) of the first scope rule that a question breaks; nulls when it is in scope.

    Fewer than two letters of any script come first; the rules follow in their order, those of emirates for tenancy questions only.
    """
    letters = F.regexp_count(question, F.lit(r"\p{L}")) < fixed.MIN_LETTERS
    tenancy = question.rlike(fixed.TENANCY_TERM)
    tests = [((question.rlike(p) & tenancy) if needs else question.rlike(p), s, n) for n, s, needs, p in fixed.SCOPE_RULES]
    signal = reduce(lambda c, t: c.when(t[0], F.lit(t[1])), tests, F.when(letters, F.lit("no-answerable-content")))
    name = reduce(lambda c, t: c.when(t[0], F.lit(t[2])), tests, F.when(letters, F.lit(None).cast("string")))
    return signal, name


def check_scope(questions: DataFrame) -> DataFrame:
    """Adds scope_signal and scope_name to rows with ``question``."""
    signal, name = scope_signal(F.col("question"))
    return questions.withColumn("scope_signal", signal).withColumn("scope_name", name)


def unknown_laws(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Questions whose law_id is not among the known: the caller's error, not a refusal."""
    return asked.where("law_id IS NOT NULL").join(known.select("law_id").distinct(), "law_id", "left_anti")

"""Citations: extraction, verification against the evidence, claims without one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions.text import folded_label, stripped, words


def citations(answers: DataFrame, keys: list[str], text: str = "answer") -> DataFrame:
    """(keys..., pos, raw, label, number) of every inline citation, in order."""
    whole, label, number = (F.regexp_extract_all(text, F.lit(fixed.CITATION), i) for i in (0, 1, 3))
    zipped = F.arrays_zip(whole.alias("raw"), label.alias("label"), number.alias("number"))
    rows = answers.select(*keys, F.posexplode(zipped).alias("pos", "c"))
    return rows.select(*keys, "pos", F.col("c.raw").alias("raw"), stripped(F.col("c.label")).alias("label"), F.col("c.number").cast("int").alias("number"))


def citation_offsets(answers: DataFrame, key: str, text: str = "answer") -> DataFrame:
    """(key, pos, start, end) in code points: offsets are not to be had from SQL functions."""
    pattern = regex.compile(fixed.CITATION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, i, m.start(), m.end()) for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True) for i, m in enumerate(pattern.finditer(t or ""))]
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=["k", "pos", "start", "end"])

    found = answers.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k long, pos long, start long, end long")
    return found.withColumnRenamed("k", key)


def verified(cited: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Citations with status, chunk_id and citation_key. They match by folded label and number; of equal evidence the last by rank counts.

    Evidence rows hold keys..., law_label, article_no, final_rank, chunk_id, citation_key.
    """
    last = evidence.groupBy(*keys, folded_label(F.col("law_label")).alias("_label"), F.col("article_no").cast("int").alias("number")).agg(
        F.max_by(F.struct(F.col("law_label").alias("found_label"), "chunk_id", "citation_key"), "final_rank").alias("m"))
    joined = cited.withColumn("_label", folded_label(F.col("label"))).join(last, [*keys, "_label", "number"], "left")
    there = F.col("m").isNotNull()
    return joined.select(
        *keys, "pos", "raw", F.coalesce("m.found_label", "label").alias("label"), "number",
        F.when(there, "verified").otherwise("unsupported").alias("status"), F.col("m.chunk_id").alias("chunk_id"), F.col("m.citation_key").alias("citation_key"),
    )


def uncited_claims(text: Column) -> Column:
    """Sentences of six words or more without a citation, without their list or heading mark."""
    sentences = F.transform(F.split(text, rf"(?<={fixed.CLAIM_MARKS})\s+"), lambda s: F.regexp_replace(stripped(s), fixed.MARKDOWN_NOISE, ""))
    return F.filter(sentences, lambda s: (F.size(words(s)) >= fixed.MIN_CLAIM_WORDS) & ~s.rlike(fixed.CITATION))


def reports(answers: DataFrame, checked: DataFrame, keys: list[str]) -> DataFrame:
    """Per answer: cited, verified_count, unsupported_count, uncited (array), passed (no unsupported citation; none at all passes)."""
    per = checked.groupBy(*keys).agg(F.count("*").alias("cited"), F.count_if(F.col("status") == "unsupported").alias("unsupported_count"))
    joined = answers.select(*keys, uncited_claims(F.col("answer")).alias("uncited")).join(per, keys, "left")
    cited, wrong = F.coalesce("cited", F.lit(0)), F.coalesce("unsupported_count", F.lit(0))
    return joined.select(*keys, cited.alias("cited"), (cited - wrong).alias("verified_count"), wrong.alias("unsupported_count"), "uncited", (wrong == 0).alias("passed"))


def segments(answers: DataFrame, keys: list[str], text: str = "answer") -> DataFrame:
    """(keys..., seq, kind, value): the answer as runs of text and citations, in order; joined they are the answer.

    Uses the full citation pattern, so sections and pages are segmented as well as articles.
    """
    mark = "\u0001"
    split = F.split(F.regexp_replace(text, f"(?i)({fixed.CITATION[4:]})", f"{mark}$1{mark}"), mark)
    rows = answers.select(*keys, F.posexplode(split).alias("seq", "value")).where("value <> ''")
    return rows.select(*keys, "seq", F.when(F.col("value").rlike(fixed.CITATION), "citation").otherwise("text").alias("kind"), "value")

"""The corpus pipeline: five stages over ``documents``, each on all rows that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of ``documents``. No stage is SQL, so ``ORACLE_SQL`` is None; the tests hold the stages
against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, mixing, neardup, repeats
from lodestone.llm.common import bounded_batches, discard, stored

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
PASSAGE_WORDS = 50  # whole words of a repeated passage, at least
PASSAGE_BYTES = 240  # bytes of the strings that make one up: fewer than 50 words of prose hold
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted, with ``lang`` as found; null texts and those without letters go, repeated rows stay repeated."""
    bounded_batches(spark)
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least doc_id. Null and empty texts, and rows without an id, are groups of their own; rows that repeat id and text stay once."""
    bounded_batches(spark)
    return neardup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of ``PASSAGE_WORDS`` words or more that a document of a smaller id holds too.

    The copy under the least id stays; null texts become empty; what repeats within one document only stays.
    """
    bounded_batches(spark)
    return repeats.cleaned(docs, length=PASSAGE_BYTES, words=PASSAGE_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; null and empty texts have no words and don't come."""
    bounded_batches(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of the ids and of the bytes they decode to; a null text is empty, repeated rows stay repeated."""
    bounded_batches(spark)
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN), ids=True)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mixture),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table. A stage's table is deleted once the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stored(docs, f"stage-{number}")
            discard(*before)
            before = [docs]
    return docs

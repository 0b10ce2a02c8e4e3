"""Cosine search over stored vectors, keyed by chunk_id, and embedding by a pluggable model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, EngineConfig
from lodestone.functions.ranks import best_of, half_up
from lodestone.operators.sparse import ranked


QUESTIONS = 8192
BLOCK = 1024


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """The offline default: signed hashed tokens, unit length. Deterministic; not a learned model."""

    def __init__(self, dim: int = DEFAULTS.embedding_dim):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for token in text.lower().split():
                digest = hashlib.sha256(token.encode()).digest()
                out[i, int.from_bytes(digest[:4], "big") % self.dim] += 1 if digest[4] & 1 else -1
            norm = np.linalg.norm(out[i])
            if norm:
                out[i] /= norm
        return out


def embed(rows: DataFrame, text: Column, embedder: Embedder | None = None, batch: int = 8) -> DataFrame:
    """``rows`` with ``embedding``. Batches are formed by length, so padding is small; results go back in row order."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            out: list = [None] * len(texts)
            for at in range(0, len(order), batch):
                which = order[at : at + batch]
                for i, v in zip(which, model.embed([texts[i] for i in which]), strict=True):
                    out[i] = v.tolist()
            yield pd.Series(out)

    return rows.withColumn("embedding", run(text))


def embed_questions(questions: DataFrame, embedder: Embedder | None = None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(qid, embedding): the query prefix is added here only, and each distinct question is embedded once."""
    distinct = embed(questions.select("question").distinct(), F.concat(F.lit(config.query_prefix), F.col("question")), embedder)
    return questions.select("qid", "question").join(distinct, "question").select("qid", "embedding")


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(vectors: DataFrame) -> DataFrame:
    """(chunk_id, v): unit vectors in double precision; a zero vector stays zero."""
    v = doubles(F.col("embedding"))
    length = F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return vectors.withColumn("v", F.transform(v, lambda x: x / length)).drop("embedding")


def scan(vectors: DataFrame, qids: pa.Array, unit: np.ndarray, k: int, keys: list | None = None) -> DataFrame:
    """(qid, chunk_id, score): each partition's k best per question, by blocked matrix products.

    With ``keys``, one per question, a vector counts only for questions of its own ``key``.
    """
    kinds = dict(vectors.dtypes)
    sent = vectors.sparkSession.sparkContext.broadcast((qids.to_pylist(), unit, None if keys is None else np.array(keys, object)))
    id_type = pa.string() if kinds["chunk_id"] == "string" else pa.int64()
    qid_type = qids.type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, wanted = sent.value
        row, score, found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object if id_type == pa.string() else np.int64)
        for batch in batches:
            lists, ids = batch.column("embedding"), batch.column("chunk_id").to_numpy(zero_copy_only=False)
            fits = np.array([n == q.shape[1] for n in lists.value_lengths().to_pylist()], bool)
            v = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
            ids = ids[fits]
            held = None if wanted is None else np.array(batch.column("key").to_pylist(), object)[fits]
            length = np.sqrt((v**2).sum(1, keepdims=True))
            v /= np.where(length == 0, 1.0, length)
            for at in range(0, len(v), BLOCK):
                s = half_up(q @ v[at : at + BLOCK].T)
                if held is not None:
                    s[wanted[:, None] != held[None, at : at + BLOCK]] = -np.inf
                floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                r, c = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
                pool = np.concatenate([found, ids[at : at + BLOCK]])
                row, score, place = best_of(np.concatenate([row, r]), np.concatenate([score, s[r, c]]), np.concatenate([np.arange(len(found)), len(found) + c]), pool, k)
                found = pool[place]
        for at in range(0, len(row), 50_000):
            part = slice(at, at + 50_000)
            yield pa.record_batch([pa.array([names[i] for i in row[part]], qid_type), pa.array(found[part], id_type), pa.array(score[part])], names=["qid", "chunk_id", "score"])

    return vectors.mapInArrow(run, f"qid {'string' if pa.types.is_string(qid_type) else 'long'}, chunk_id {kinds['chunk_id']}, score double")


def search(vectors: DataFrame, questions: DataFrame, limit: int | None = None, config: EngineConfig = DEFAULTS, key: str | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): exact cosine top-k of (qid, embedding) over (chunk_id, embedding).

    Every question meets every vector: that is what exact search is. The questions are a stated set, taken in blocks of ``QUESTIONS``
    by a hash; a block is broadcast and each partition of vectors, read in place, gives its k best only. Null vectors and those of another
    length than the questions' take no part. With ``key``, a column of both, only vectors of a question's own key count, before the limit; no join
    is made, so a key that holds most vectors is no hot spot. Null keys match nothing.
    """
    k, also = limit or config.dense_top_k, [] if key is None else [F.col(key).alias("key")]
    known = " AND ".join(["embedding IS NOT NULL", *["key IS NOT NULL" for _ in also]])
    asked, rows = questions.select("qid", "embedding", *also).where(f"qid IS NOT NULL AND {known}"), vectors.select("chunk_id", "embedding", *also).where(f"chunk_id IS NOT NULL AND {known}")
    blocks = max(1, -(-asked.count() // QUESTIONS))
    parts = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).toArrow()
        q = np.array(own["embedding"].to_pylist(), np.float64).reshape(own.num_rows, -1) if own.num_rows else np.zeros((0, 0))
        length = np.sqrt((q**2).sum(1, keepdims=True)) if q.size else np.ones((len(q), 1))
        if len(q):
            parts.append(scan(rows, own["qid"].combine_chunks(), q / np.where(length == 0, 1.0, length), k, own["key"].to_pylist() if also else None))
    if not parts:
        return ranked(rows.join(asked.select("qid").limit(0), F.lit(False)).select("qid", "chunk_id", F.lit(0.0).alias("score")), k)
    return ranked(reduce(DataFrame.unionByName, parts), k)


PAYLOAD = ["chunk_id", "law_id", "law_label", "law_title", "part_id", "part_title", "article_no", "article_title", "section", "seq", "seq_total", "page_start", "page_end", "text", "token_count"]


def payload(chunks: DataFrame) -> DataFrame:
    """The columns stored beside a vector; the unit label is not one of them and reads back as its default."""
    return chunks.select(*PAYLOAD)

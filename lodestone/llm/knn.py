"""Exact top-k inner-product search by pivot-table elimination.

Every vector carries its distances to a fixed table of pivots. For a query q and a candidate c the
triangle inequality gives ``|q-c| >= max_p | |q-p| - |c-p| |``, and with it an upper bound of the inner
product, ``(|q|^2 + |c|^2 - bound^2) / 2``. Candidates are evaluated in the order of that bound until the
next bound lies below the query's k-th score, so what is left out cannot be a result.

The pivots come from a bounded sample (``SAMPLE`` rows of smallest id hash); results do not depend on them.
Queries are taken in blocks of about ``QUERY_BLOCK`` rows: a block is the only thing that is broadcast,
and each block meets all rows in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import keyed, scratch

SCALE = 256.0
PIVOTS = 32
SAMPLE = 512
QUERY_BLOCK = 16_384
STEP = 256


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows with an id whose vector is non-null and holds finite components only, as (vec_id, v)."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return keyed(vectors, vec_id=id_col, v=vector_col).where("vec_id IS NOT NULL AND v IS NOT NULL").where(~F.coalesce(bad, F.lit(True)))


def quantised(flat: np.ndarray, dim: int) -> np.ndarray:
    """floor(256 x) of each component, as a float64 matrix: whole numbers, exact below 2**53."""
    return np.floor(SCALE * flat.astype(np.float64)).reshape(-1, dim)


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, matrix) for each vector length that occurs."""
    ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    flat, lens = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    starts = np.cumsum(lens) - lens
    for dim in np.unique(lens):
        at = np.flatnonzero(lens == dim)
        rows = flat[(starts[at][:, None] + np.arange(dim)).ravel()] if dim else np.zeros(0)
        yield int(dim), ids[at], quantised(rows, int(dim)) if dim else np.zeros((len(at), 0))


def choose_pivots(rows: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal: pivots far apart give the largest lower bounds."""
    chosen, gap = [0], np.full(len(rows), np.inf)
    while len(chosen) < min(count, len(rows)):
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(1))
        far = int(gap.argmax())
        if gap[far] <= 0:
            break
        chosen.append(far)
    return rows[chosen]


def pivot_table(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each row to each pivot, and squared norms."""
    norms = (rows**2).sum(1)
    squares = norms[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0.0)), norms


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class QueryBlock:
    """Queries of one dimension with their pivot distances and the k-th scores that the sample already guarantees."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int):
        self.k, self.ids, self.rows = k, ids, rows
        self.pivots = choose_pivots(sample, PIVOTS)
        self.table, self.norms = pivot_table(rows, self.pivots)
        scores = rows @ sample.T
        scores[ids[:, None] == sample_ids[None, :]] = -np.inf
        scores.sort(axis=1)
        self.floor = scores[:, -k].copy() if scores.shape[1] >= k else np.full(len(ids), -np.inf)

    def scan(self, ids: np.ndarray, rows: np.ndarray, kept: dict) -> None:
        """Put the candidates that may be among the k best of a query into ``kept`` (query position: scores, ids)."""
        table, norms = pivot_table(rows, self.pivots)
        for i, own in enumerate(self.ids):
            scores, found = kept.get(i, (np.zeros(0), np.zeros(0, np.int64)))
            floor = max(self.floor[i], scores[-1] if len(scores) == self.k else -np.inf)
            lower = np.abs(table - self.table[i]).max(1)
            total = norms + self.norms[i]
            upper = (total - lower**2) / 2.0 + 1e-6 * total + 1e-3  # the slack outweighs rounding
            left = np.flatnonzero((upper >= floor) & (ids != own))
            left = left[np.argsort(-upper[left], kind="stable")]
            for at in range(0, len(left), STEP):
                part = left[at : at + STEP]
                if upper[part[0]] < floor:
                    break
                got = rows[part] @ self.rows[i]
                good = got >= floor
                if good.any():
                    scores, found = best(np.concatenate([scores, got[good]]), np.concatenate([found, ids[part][good]]), self.k)
                    if len(scores) == self.k:
                        floor = max(floor, scores[-1])
            if len(scores):
                kept[i] = (scores, found)


PARTIAL = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest integer inner product for each row of ``queries``.

    Returns (query_id, rank from 1, vec_id, score); ties go to the smaller vec_id. Null ids or vectors, and
    vectors with null or non-finite components, take no part. Vectors meet those of their own length only.
    A candidate with the query's own id is skipped; a repeated candidate row counts as often as it occurs;
    query rows that share an id count once, by their least vector. With fewer candidates than ``k`` all are returned; empty input gives no
    rows. Scores are exact below 2**53. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    seeds = {d: (i, m) for d, i, m in matrices(sample["vec_id"].combine_chunks(), sample["v"].combine_chunks())} if sample.num_rows else {}
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = scratch(spark, "topk")
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        held = {}
        if own.num_rows:
            for dim, ids, m in matrices(own["vec_id"].combine_chunks(), own["v"].combine_chunks()):
                held[dim] = QueryBlock(ids, m, *seeds.get(dim, (ids[:1], m[:1])), k)
        sent = spark.sparkContext.broadcast(held)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            kept: dict[int, dict] = {}
            for batch in batches:
                if batch.num_rows:
                    for dim, ids, m in matrices(batch.column("vec_id"), batch.column("v")):
                        if dim in sent.value:
                            sent.value[dim].scan(ids, m, kept.setdefault(dim, {}))
            for dim, found in kept.items():
                asks = sent.value[dim].ids
                for at in range(0, len(found), 4096):
                    part = list(found.items())[at : at + 4096]
                    sizes = [len(s) for _, (s, _) in part]
                    yield pa.record_batch([
                        pa.array(np.repeat(asks[[i for i, _ in part]], sizes)),
                        pa.array(np.concatenate([x for _, (_, x) in part])),
                        pa.array(np.rint(np.concatenate([s for _, (s, _) in part])).astype(np.int64)),
                    ], schema=PARTIAL)

        partial = rows.mapInArrow(scan, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        sent.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)

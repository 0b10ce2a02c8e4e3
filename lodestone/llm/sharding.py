"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix.

Rows are dealt to buckets by a hash of their content. How many rows of each bucket go to each shard is drawn
exactly, row by row of the matrix, from the multivariate hypergeometric law, so that every shard gets its exact
size and every assignment of rows to shards is equally likely. Each bucket is permuted locally and cut by its row
of the matrix; after the exchange each shard is permuted again, which gives the slots.

Buckets and order come from content alone, not from physical partitions: a recomputed task gives the same rows.
The driver holds counts only, at most ``MAX_BUCKETS`` x shards numbers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored

ROWS_PER_BUCKET = 16_384
MAX_BUCKETS = 8192
SUBS = 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken without replacement are good: numpy's exact draw below 10**9 rows, above it rejection with log-gamma weights, exact but for their rounding (about 1e-6 in a weight at 10**12)."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good + bad else 0
    total, lg = good + bad, math.lgamma
    low, high = max(0, draws - bad), min(draws, good)
    mean = draws * good / total
    spread = math.sqrt(mean * (bad / total) * ((total - draws) / (total - 1)) + 0.5)
    weight = lambda x: -(lg(x + 1) + lg(good - x + 1) + lg(draws - x + 1) + lg(bad - draws + x + 1))
    mode = min(high, max(low, math.floor((draws + 1) * (good + 1) / (total + 2))))
    top, half = weight(mode), 2 * math.sqrt(2 / math.e) * spread + (3 - 2 * math.sqrt(3 / math.e))
    while True:  # ratio of uniforms with the hat of Stadlober (1990)
        u, v = rng.random(), rng.random()
        if not u:
            continue
        x = math.floor(mean + 0.5 + half * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= weight(x) - top:
            return x


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts [bucket, shard] with the given row and column sums, drawn with the chance that a uniform shuffle gives them."""
    rng, left = np.random.Generator(np.random.Philox(seed)), list(shards)
    out = np.zeros((len(rows), len(shards)), np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for j, room in enumerate(left):
            rest -= room
            got = hypergeometric(rng, room, rest, n) if rest else n
            out[i, j], n = got, n - got
            left[j] = room - got
    return out


def shard_rows(df: DataFrame, identity: list[str], n_shards: int = 40, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one at most (the law ``rows``); the first N mod n_shards shards are the larger. Rows
    are told apart by the columns ``identity``; rows equal in all of these (null equals null) share out equal
    places and are interchangeable. Equal content gives an equal result on every run. An empty table gives no rows.
    Input columns named ``shard`` or ``slot`` give way to the result's; all others come back as they are, whatever their names.
    """
    spark, names = df.sparkSession, df.columns
    # The row travels as one struct under numbered fields, so no column of the input can clash with one of the steps.
    at = {c: F.col(f"row.c{i}") for i, c in enumerate(names)}
    packed = df.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row"))
    ids = [at[c] for c in identity]
    draw = lambda k: F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("\x00")) for c in ids], *[c.isNull() for c in ids], F.lit(seed * 16 + k))
    total = df.count()
    buckets = min(MAX_BUCKETS, max(8, -(-total // ROWS_PER_BUCKET)))
    dealt = packed.withColumn("bucket", F.pmod(draw(0), F.lit(buckets)).cast("int")).withColumn("a", draw(1)).withColumn("b", draw(2))
    counts = {r[0]: r[1] for r in dealt.groupBy("bucket").count().collect()}  # at most MAX_BUCKETS rows
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([counts.get(b, 0) for b in range(buckets)], sizes, seed)
    cuts = spark.createDataFrame([(b, [int(x) for x in row]) for b, row in enumerate(matrix.cumsum(axis=1))], "bucket int, cuts array<long>")

    local = Window.partitionBy("bucket").orderBy("a", *ids)
    sent = dealt.withColumn("n", F.row_number().over(local) - 1).join(F.broadcast(cuts), "bucket")
    sent = sent.select("row", "b", F.size(F.filter("cuts", lambda c: c <= F.col("n"))).alias("shard"))
    sent = stored(sent.withColumn("sub", F.pmod("b", F.lit(SUBS)).cast("int")), "shards")

    # The order within a shard is by (sub, hash): windows of a sub-range, offset by the counts before it.
    offsets = sent.groupBy("shard", "sub").count().withColumn("offset", F.sum("count").over(Window.partitionBy("shard").orderBy("sub")) - F.col("count")).drop("count")
    again = Window.partitionBy("shard", "sub").orderBy("b", *ids)
    out = sent.withColumn("n", F.row_number().over(again) - 1).join(F.broadcast(offsets), ["shard", "sub"])
    kept = [at[c].alias(c) for c in names if c.lower() not in ("shard", "slot")]
    return out.select(*kept, "shard", (F.col("offset") + F.col("n")).cast("long").alias("slot"))

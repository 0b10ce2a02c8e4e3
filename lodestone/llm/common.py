"""What several operators use: tables that cut lineage, hashes, bounded batches."""

from __future__ import annotations

import ctypes

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.scratch import discard, scratch, shared_dir, stored

__all__ = ["bounded_batches", "discard", "give_back", "keyed", "mixed", "scratch", "shared_dir", "small", "stored", "tidied"]

def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


MAX_BROADCAST_ROWS = 50_000


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a table of a row per source or language, given only when its counted rows prove it small."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on between tasks, beside the next stage's workers."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(run):
    """``run``, a function of batches for mapInArrow, that gives its memory back when its frame is gone."""

    def tidy(batches):
        yield from run(batches)
        give_back()

    return tidy


BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Send whole texts to Python by at most ``BATCH_ROWS`` at once, unless the session says less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def keyed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so extra or clashing columns of the input can't interfere."""
    return df.select(*(F.col(f"`{v}`").alias(k) for k, v in columns.items()))

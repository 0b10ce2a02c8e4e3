"""Session state, rate limits and answer events as Structured Streaming queries, each equal to its batch form once input ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.config import DEFAULTS, EngineConfig
from lodestone.operators.answer import answer_deltas
from lodestone.sources import scratch

WATERMARK = "10 minutes"


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of Parquet events with a watermark on ``ts``, as a timestamp of the session's zone; later rows are dropped and counted by the engine."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)


def finished(stream: DataFrame, name: str) -> DataFrame:
    """The result table of an aggregating stream once all input that is there now has been read.

    Each batch replaces the table by the complete result of the moment; state and progress lie in the shared folder, so a lost executor or a restart loses none.
    """
    spark = stream.sparkSession
    out = scratch.scratch(spark, name)
    query = (
        stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}-progress")
        .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(out)).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def rate_counts(events: DataFrame, client: str = "user_id") -> DataFrame:
    """(client, minute, requests) of fixed minutes; batch or stream."""
    return events.groupBy(F.col(client).alias("client"), F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("requests")).select("client", F.col("w.start").alias("minute"), "requests")


def over_rate(events: DataFrame, client: str = "user_id", config: EngineConfig = DEFAULTS) -> DataFrame:
    return rate_counts(events, client).where(F.col("requests") > config.rate_per_minute)


def sessions(events: DataFrame, key: str = "user_id", config: EngineConfig = DEFAULTS) -> DataFrame:
    """(key, started, ended, events) of runs whose gaps stay below the TTL; batch or stream."""
    gap = F.session_window("ts", f"{config.workspace_ttl_seconds} seconds")
    return events.groupBy(F.col(key), gap.alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("last_ts")).select(key, F.col("w.start").alias("started"), F.col("last_ts").alias("ended"), "events")


EXPIRED = "session_id long, created_at timestamp, touched_at timestamp, touches long"
STATE = "created_at double, touched_at double, touches long"


def expired_sessions(events: DataFrame, key: str = "user_id", config: EngineConfig = DEFAULTS) -> DataFrame:
    """Sessions as they expire: idle for strictly more than the TTL of event time.

    State is three numbers per session, kept by the engine's store; a timer ends it when the watermark passes touched_at + TTL.
    """
    ttl = config.workspace_ttl_seconds

    def row(session: int, created: float, touched: float, n: int) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [session], "created_at": [pd.Timestamp(round(created * 1e6), unit="us")], "touched_at": [pd.Timestamp(round(touched * 1e6), unit="us")], "touches": [n]})

    def update(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield row(name[0], *state.get)
            state.remove()
            return
        times = sorted(t for part in parts for t in part["ts"].astype("int64").to_numpy() / _unit(part["ts"]))
        held = state.get if state.exists else None
        for t in times:
            if held and t - held[1] > ttl:
                yield row(name[0], *held)
                held = None
            held = (held[0], max(held[1], t), held[2] + 1) if held else (t, t, 1)
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max(int((held[1] + ttl) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    return events.select(F.col(key).cast("long").alias("session_id"), "ts").groupBy("session_id").applyInPandasWithState(update, EXPIRED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _unit(ts: pd.Series) -> float:
    return {"s": 1.0, "ms": 1e3, "us": 1e6, "ns": 1e9}[getattr(ts.dtype, "unit", "ns")]


def answer_events(answers: DataFrame) -> DataFrame:
    """The token events of an answer stream, append only, keyed by (qid, seq)."""
    return answer_deltas(answers)

from collections import Counter
from datetime import datetime, timedelta

from conftest import DATA
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.operators import workspace
from lodestone.streaming import sessions

CONFIG = EngineConfig(workspace_ttl_seconds=3600, rate_per_minute=1, workspace_max_sessions=2, workspace_max_documents=2)


def drained(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return df.sparkSession.table(name)


def split_files(spark, tmp_path, n=4):
    """The small event table in order of time, and a far later event that lets the watermark pass all others."""
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").select("user_id", "ts").orderBy("ts").limit(400)
    rows = events.collect()
    step = -(-len(rows) // n)
    schema = "user_id long, ts timestamp"
    for i in range(n):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    spark.createDataFrame([(-1, rows[-1]["ts"] + timedelta(days=9))], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{n}"))
    return spark.createDataFrame(rows, schema), sessions.event_stream(spark, str(tmp_path / "in/*"), schema)


def test_rates_and_sessions_equal_their_batch_form(spark, tmp_path):
    batch, stream = split_files(spark, tmp_path)
    got = Counter(map(tuple, drained(sessions.rate_counts(stream), "rates").where("client >= 0").collect()))
    assert got == Counter(map(tuple, sessions.rate_counts(batch).collect()))
    runs = Counter(map(tuple, drained(sessions.sessions(stream, "user_id", CONFIG), "runs").where("user_id >= 0").collect()))
    assert runs == Counter(map(tuple, sessions.sessions(batch, "user_id", CONFIG).collect()))


def test_expiry_equals_runs_of_the_batch(spark, tmp_path):
    batch, stream = split_files(spark, tmp_path)
    got = Counter((r["session_id"], r["touches"]) for r in drained(sessions.expired_sessions(stream, "user_id", CONFIG), "expired").where("session_id >= 0").collect())
    runs = workspace.sessionised(batch.withColumnRenamed("user_id", "session_id"), CONFIG).groupBy("session_id", "session_no").count()
    assert got == Counter((r["session_id"], r["count"]) for r in runs.collect())


def test_session_rules(spark):
    t = datetime(2024, 1, 1)
    touches = spark.createDataFrame([("a", t), ("b", t + timedelta(hours=1)), ("c", t + timedelta(hours=2)), ("d", t + timedelta(hours=2)), ("a", t + timedelta(hours=2, seconds=1))], "session_id string, ts timestamp")
    alive = workspace.live_sessions(touches, F.lit(t + timedelta(hours=3)), CONFIG)
    assert sorted(r["session_id"] for r in alive.collect()) == ["a", "d"]
    uploads = spark.createDataFrame([("s", f"d{i}", float(i), 1) for i in range(3)] + [("s", "e", 0.5, 0)], "session_id string, doc_id string, added_at double, chunks int")
    status = {r["doc_id"]: r["status"] for r in workspace.admitted_documents(uploads, CONFIG).collect()}
    assert status == {"d0": "added", "d1": "added", "d2": "full", "e": "empty"}
    docs = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a"), ("u", "x")], "session_id string, doc_id string")
    left = workspace.removed(docs, spark.createDataFrame([("s", "a"), ("u", None)], "session_id string, doc_id string"))
    assert sorted(map(tuple, left.collect())) == [("s", "b"), ("t", "a")]


def test_requests_and_notices(spark):
    rows = spark.createDataFrame([("ok", "corpus", 1), (" ", None, 0), ("x" * 1001, None, 0), ("a", "else", 0), ("a", None, 21)], "question string, scope string, turns int")
    assert [r["problem"] for r in workspace.request_problems(rows).collect()] == [None, "blank question", "question too long", "unknown scope", "too many turns"]
    row = spark.range(1).select(workspace.coverage_warning(F.lit(False), F.lit(0.9)).alias("a"), workspace.coverage_warning(F.lit(False), F.lit(1.0)).alias("b"), workspace.described_kind(F.lit("pdf"), F.lit(2), F.lit(None).cast("string")).alias("c"), workspace.size_problem(F.lit(0)).alias("d")).first()
    assert tuple(row) == ("About 10% of this document could not be read.", None, "PDF · 2 pages", "empty")

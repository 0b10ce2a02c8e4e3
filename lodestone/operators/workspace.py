"""Sessions, limits and service rules over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, EngineConfig


def live_sessions(touches: DataFrame, now: Column, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(session_id, created_at, touched_at) still alive at ``now``: not idle beyond the TTL, and among the newest by last touch.

    Touches are (session_id, ts). Ties at the cap go to the larger id. The cap needs a global order, which the planner limits per
    partition before one task sees it.
    """
    per = touches.groupBy("session_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("touched_at"))
    fresh = per.where(F.unix_timestamp(now) - F.unix_timestamp("touched_at") <= config.workspace_ttl_seconds)
    return fresh.orderBy(F.desc("touched_at"), F.desc("session_id")).limit(config.workspace_max_sessions)


def _seconds(touches: DataFrame) -> Column:
    """``ts`` as a double of seconds since 1970 with their parts; null for the first and last time that 64 bits hold, which stand for infinite ones.

    A time without a zone is read as UTC in any session's zone, so that none of its days has 23 hours.
    """
    if dict(touches.dtypes)["ts"] == "timestamp_ntz":
        since = F.col("ts") - F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
        seconds = (since.cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("long") / 1e6
    else:
        seconds = F.col("ts").cast("timestamp").cast("double")
    return F.when(F.abs(seconds) < 2**63 / 1e6, seconds)


def sessionised(touches: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Touches with ``session_no``: a new session starts after an idle time above the TTL, by parts of a second too. Touches without a time come last, together."""
    order = Window.partitionBy("session_id").orderBy(F.asc_nulls_last("ts"))
    gap = _seconds(touches) - F.lag(_seconds(touches)).over(order)
    return touches.withColumn("session_no", F.sum(F.when(gap <= config.workspace_ttl_seconds, 0).otherwise(1)).over(order.rangeBetween(Window.unboundedPreceding, 0)))


def admitted_documents(uploads: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Uploads (session_id, doc_id, added_at, chunks) with ``status``: ``empty`` without chunks, ``full`` beyond the cap, else ``added``."""
    good = uploads.where("chunks > 0").withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("added_at", "doc_id")))
    taken = good.withColumn("status", F.when(F.col("n") <= config.workspace_max_documents, "added").otherwise("full")).drop("n")
    return taken.unionByName(uploads.where("chunks <= 0").withColumn("status", F.lit("empty")))


def removed(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents without those of (session_id, doc_id); a null doc_id clears its session. Vectors are keyed alike and go with them."""
    one = documents.join(gone.where("doc_id IS NOT NULL"), ["session_id", "doc_id"], "left_anti")
    return one.join(gone.where("doc_id IS NULL").select("session_id"), "session_id", "left_anti")


def vectors_for(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """The vectors of the (session_id, doc_id, position) documents with ``row_no``: in the order asked for, then by chunk."""
    order = Window.partitionBy("session_id").orderBy("position", "seq")
    met = vectors.join(documents.select("session_id", "doc_id", "position"), ["session_id", "doc_id"])
    return met.withColumn("row_no", F.row_number().over(order)).drop("position")


def touched(sessions: DataFrame, requests: DataFrame, now: Column, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Sessions (session_id, created_at, touched_at) after (session_id, creates) requests at ``now``, with ``found``.

    Idle ones go first. A request touches its session; one that may create opens an empty session under the id it brings, or a new
    random one if it brings none. ``found`` is true for sessions that a request met; those beyond the cap go, oldest touch first.
    """
    alive = sessions.where(F.unix_timestamp(now) - F.unix_timestamp("touched_at") <= config.workspace_ttl_seconds)
    named = requests.where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("creates").alias("creates"))
    fresh = requests.where("session_id IS NULL AND creates").select(F.sha2(F.concat(F.uuid(), F.uuid()), 256).alias("session_id"), F.lit(True).alias("creates"))
    met = alive.join(named.unionByName(fresh), "session_id", "full_outer").where("touched_at IS NOT NULL OR creates")
    asked = F.col("creates").isNotNull()
    out = met.select("session_id", F.coalesce("created_at", now).alias("created_at"), F.when(asked, now).otherwise(F.col("touched_at")).alias("touched_at"), (asked & F.col("touched_at").isNotNull()).alias("found"))
    return out.orderBy(F.desc("touched_at"), F.desc("session_id")).limit(config.workspace_max_sessions)


def scope_problems(asked: DataFrame, documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """Questions (qid, scope, session_id) with ``status``: 200; 409 for a workspace without documents; 500 if its chunks and vectors differ in number.

    Documents are (session_id, doc_id, chunks), vectors (session_id, doc_id, ...). A workspace is asked with ``EngineConfig.for_workspace`` and without the scope check.
    """
    held = documents.groupBy("session_id").agg(F.sum("chunks").alias("_chunks"))
    there = vectors.join(documents.select("session_id", "doc_id"), ["session_id", "doc_id"], "left_semi").groupBy("session_id").agg(F.count("*").alias("_vectors"))
    rows = asked.join(held, "session_id", "left").join(there, "session_id", "left")
    own = F.col("scope") == "workspace"
    status = F.when(own & F.col("_chunks").isNull(), 409).when(own & (F.col("_chunks") != F.coalesce("_vectors", F.lit(0))), 500).otherwise(200)
    return rows.withColumn("status", status).drop("_chunks", "_vectors")


def over_rate(requests: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(client, minute, requests, rejected) of fixed minutes with more requests than allowed."""
    per = requests.groupBy("client", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("requests"))
    return per.where(F.col("requests") > config.rate_per_minute).withColumn("rejected", F.col("requests") - config.rate_per_minute)


def store_stats(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def usage_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls (model, input_tokens, output_tokens) with ``usd``, by a (model, price_in, price_out) table; others cost the default."""
    from lodestone.functions.text import cost_usd

    joined = calls.join(prices, "model", "left")
    return joined.withColumn("usd", F.round(cost_usd(F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out")), 6)).drop("price_in", "price_out")


def request_problems(requests: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Requests (question, scope, turns) with ``problem``, null when valid."""
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    problem = F.when(blank, "blank question").when(F.length("question") > config.max_question_chars, "question too long").when(~F.coalesce("scope", F.lit("corpus")).isin("corpus", "workspace"), "unknown scope").when(F.col("turns") > 20, "too many turns")
    return requests.withColumn("problem", problem)


def size_problem(size: Column, config: EngineConfig = DEFAULTS) -> Column:
    return F.when(size == 0, "empty").when(size > config.workspace_max_bytes, "too large")


BODY_BYTES = 64 * 1024


def body_problems(requests: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Requests (path, declared, received) with ``status``: 413 if the declared or the received size is over the path's limit, 411 without either, else 200."""
    limit = F.when(F.col("path").startswith("/workspace"), config.workspace_max_bytes).otherwise(BODY_BYTES)
    size = F.greatest("declared", "received")
    return requests.withColumn("status", F.when(size.isNull(), 411).when(size > limit, 413).otherwise(200))


def chunk_lookup(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk_id) rows with their chunk and ``found``; unknown ids stay, without one."""
    return ids.select("chunk_id").join(chunks.withColumn("found", F.lit(True)), "chunk_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def coverage_warning(truncated: Column, coverage: Column) -> Column:
    lost = F.round((1 - coverage) * 100).cast("int").cast("string")
    return F.when(truncated, "Only the first part of this document was read — it is longer than the page limit.").when(coverage < 0.999, F.concat(F.lit("About "), lost, F.lit("% of this document could not be read.")))


def described_kind(kind: Column, pages: Column, ocr_engine: Column) -> Column:
    names = {"pdf": "PDF", "docx": "Word document", "image": "Image", "html": "Web page", "text": "Text"}
    base = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), kind)
    count = F.when(pages == 1, "1 page").otherwise(F.concat(pages.cast("string"), F.lit(" pages")))
    return F.concat(base, F.lit(" · "), count, F.when(ocr_engine.isNull(), "").otherwise(F.concat(F.lit(" · read by "), ocr_engine)))


def health(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """One row: chunks, points, and ok when both agree and are not empty."""
    return chunks.agg(F.count("*").alias("chunks")).crossJoin(points.agg(F.count("*").alias("points"))).withColumn("ok", (F.col("chunks") == F.col("points")) & (F.col("chunks") > 0))


def law_listing(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """Every declared law with its counts, 0 where nothing is indexed."""
    return manifest.join(counts, "law_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chunks", "articles")})

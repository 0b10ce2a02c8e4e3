"""Queries of sessions, limits, costs, manifests and label checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lodestone.config import DEFAULTS
from lodestone.operators import answer, dense, evaluate, guard, workspace
from lodestone.plans.common import longs, table
from lodestone.sources import manifest
from lodestone.streaming import sessions

TIGHT = replace(DEFAULTS, rate_per_minute=1, workspace_max_documents=2, workspace_max_sessions=40, workspace_ttl_seconds=2 * 86_400)


def _touches(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "ts", "event_id")


def session_purge(spark, sf_dir):
    """Sessions alive at the last event, of 40 at most with a TTL of two days."""
    touches = _touches(spark, sf_dir)
    last = touches.agg(F.max("ts").alias("now"))
    return workspace.live_sessions(touches.crossJoin(F.broadcast(last)).where("ts <= now").select("session_id", "ts"), F.lit(last.first()[0]), TIGHT)


def session_runs(spark, sf_dir):
    runs = workspace.sessionised(_touches(spark, sf_dir), TIGHT)
    return longs(runs.groupBy("session_id", "session_no").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events")))


def doc_cap(spark, sf_dir):
    uploads = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("doc_id"), F.col("ts").alias("added_at"), (F.col("event_id") % 4).alias("chunks"))
    return workspace.admitted_documents(uploads, TIGHT).select("session_id", "doc_id", "status")


def rate_limit_minute(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("client"), "ts")
    return longs(workspace.over_rate(requests, TIGHT))


def stream_rate_batch(spark, sf_dir):
    """The streaming query of rate limits, run over the table at once."""
    return sessions.rate_counts(table(spark, sf_dir, "events")).select(F.col("client").alias("user_id"), "minute", "requests")


def stream_sessions_batch(spark, sf_dir):
    return sessions.sessions(table(spark, sf_dir, "events"), "user_id", TIGHT)


def _event_stream(spark, sf_dir):
    path = f"{sf_dir}/[e]vents.parquet"  # a pattern, which may match one file as well as a folder of them; a plain path must be a folder
    return sessions.event_stream(spark, path, table(spark, sf_dir, "events").schema)


def stream_rate_run(spark, sf_dir):
    """Rate limits by a stream over the event files, run to the end of its input."""
    return sessions.finished(sessions.rate_counts(_event_stream(spark, sf_dir)), "stream-rate").select(F.col("client").alias("user_id"), F.col("minute").cast("timestamp_ntz").alias("minute"), "requests")


def stream_sessions_run(spark, sf_dir):
    """Session runs by a stream over the event files, run to the end of its input."""
    found = sessions.finished(sessions.sessions(_event_stream(spark, sf_dir), "user_id", TIGHT), "stream-sessions")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


def usage_cost(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.length("props").cast("long").alias("input_tokens"), (F.col("event_id") % 700).alias("output_tokens"))
    prices = spark.createDataFrame([("click", 1.0, 5.0), ("view", 2.0, 4.0)], "model string, price_in double, price_out double")
    return workspace.usage_costs(calls, prices).select("event_id", "usd")


def latency_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("latency_ms"))
    return evaluate.latency_summary(rows, ["event_type"])


def upper_median(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("latency_ms"))
    return evaluate.upper_median(rows, ["event_type"])


def request_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 0, F.lit("  ")).otherwise(F.col("text")).alias("question"), F.when(F.col("conv_id") % 4 == 0, "other").otherwise("workspace").alias("scope"), (F.col("conv_id") % 25).alias("turns"))
    return workspace.request_problems(rows).select("conv_id", "turn", "problem")


def label_quality_join(spark, sf_dir):
    """Labels against documents: labelled, unlabelled and orphan counts per source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    return longs(joined.groupBy("source").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")))


def label_verification(spark, sf_dir):
    """Questions over documents: duplicates by text, articles that don't exist, keywords that they lack."""
    docs = table(spark, sf_dir, "documents")
    labels = docs.select(F.col("doc_id").alias("qid"), F.col("text").alias("question"), (F.col("doc_id") % 3 > 0).alias("answerable"), F.col("source").alias("law_id"), F.col("doc_id").alias("article_no"), F.lit("p").alias("part"), F.array(F.lit("the"), F.lit("que")).alias("must_contain"))
    articles = docs.where("doc_id % 7 > 0").select(F.col("source").alias("law_id"), F.col("doc_id").alias("article_no"), F.lit("p").alias("part"), "text")
    return evaluate.label_problems(labels, articles)


LABEL_SQL = """
WITH d AS (SELECT * FROM documents)
SELECT doc_id AS qid, 'duplicate question' AS problem FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS i FROM d) WHERE i > 1
UNION ALL SELECT doc_id, 'no such article' FROM d WHERE doc_id % 3 > 0 AND doc_id % 7 = 0
UNION ALL SELECT doc_id, 'lacks ' || array_to_string(list_filter(['the', 'que'], lambda t: NOT contains(lower(text), t)), ', ') FROM d WHERE doc_id % 3 > 0 AND doc_id % 7 > 0 AND NOT (contains(lower(text), 'the') AND contains(lower(text), 'que'))
"""


def law_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("law_id"), F.col("lang").alias("part_id"), (F.col("doc_id") % 9).alias("article_no"))
    return evaluate.law_counts(rows)


def manifest_join(spark, sf_dir):
    counts = law_counts(spark, sf_dir)
    manifest = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("law_id"), F.col("n_name").alias("label"))
    return longs(workspace.law_listing(manifest, counts))


def health(spark, sf_dir):
    return longs(workspace.health(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select("vec_id")))


def store_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 4).alias("chunks"))
    return longs(workspace.store_stats(docs))


def document_notices(spark, sf_dir):
    """Kind lines and coverage warnings of documents with planted facts."""
    kind = F.element_at(F.array(*map(F.lit, ["pdf", "docx", "image", "html", "text"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", workspace.described_kind(kind, F.col("doc_id") % 3 + 1, F.when(F.col("doc_id") % 4 == 0, "OCR")).alias("kind"), workspace.coverage_warning(F.col("doc_id") % 11 == 0, F.lit(1.0) - (F.col("doc_id") % 8) / 100).alias("warning"))


NOTICE_SQL = """
SELECT doc_id, ['PDF', 'Word document', 'Image', 'Web page', 'Text'][doc_id % 5 + 1] || ' · ' || CASE WHEN doc_id % 3 = 0 THEN '1 page' ELSE (doc_id % 3 + 1) || ' pages' END || CASE WHEN doc_id % 4 = 0 THEN ' · read by OCR' ELSE '' END AS kind,
  CASE WHEN doc_id % 11 = 0 THEN 'Only the first part of this document was read — it is longer than the page limit.' WHEN doc_id % 8 > 0 THEN 'About ' || (doc_id % 8) || '% of this document could not be read.' END AS warning FROM documents
"""


def event_log(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), F.when(F.col("conv_id") % 3 == 0, "blocked").otherwise("answer").alias("kind"), F.col("text").alias("answer"))
    return longs(answer.event_log(rows).groupBy("qid").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"), F.count_if(F.col("type") == "token").alias("tokens")))


EVENT_LOG_SQL = r"""
SELECT conv_id || '-' || turn AS qid, n + CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 3 END AS events, n + 2 AS last_seq, n AS tokens
FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '\S+\s*'))::BIGINT AS n FROM conversations WHERE role = 'assistant')
"""

def digest_check(spark, sf_dir):
    """Documents as declared files: a third unpinned, a third pinned right, a third wrong; every tenth file is missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    pin = F.when(F.col("doc_id") % 3 == 0, manifest.UNPINNED).when(F.col("doc_id") % 3 == 1, F.sha2("content", 256)).otherwise("ff")
    declared = docs.select("filename", pin.alias("sha256"))
    return manifest.digest_problems(docs.where("doc_id % 10 > 0").select(F.concat(F.lit("dir/"), "filename").alias("path"), "content"), declared)


def unknown_laws(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 7 > 0, F.concat(F.lit("src"), (F.col("item_id") % 30).cast("string"))).alias("law_id"))
    return guard.unknown_laws(asked, table(spark, sf_dir, "documents").select(F.col("source").alias("law_id"))).select("qid", "law_id")


def answer_relevance_all(spark, sf_dir):
    """The mean cosine of every vector with all other vectors of its label."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"), F.col("label").alias("group"))
    return evaluate.group_relevance(v)


def faithfulness(spark, sf_dir):
    claims = table(spark, sf_dir, "labels").select((F.col("doc_id") % 50).alias("qid"), (F.col("quality") == 1).alias("supported"))
    return evaluate.faithfulness(claims).select("qid", "claims", F.round("faithfulness", 6).alias("faithfulness"))


def budget_log(spark, sf_dir):
    """Build log lines planted on events; one expected stage never reports."""
    stage = F.element_at(F.array(*map(F.lit, ["embedding", "reranker", "other", "noise"])), (F.col("event_id") % 4 + 1).cast("int"))
    line = F.when(F.col("event_id") % 4 == 3, F.lit("nothing here")).otherwise(F.concat(F.lit("baked ["), stage, F.lit("] done — peak RSS "), (F.col("event_id") % 700).cast("string"), F.lit(" MB")))
    return evaluate.budget_problems(table(spark, sf_dir, "events").select(line.alias("line")))


BUDGET_SQL = """
WITH p AS (SELECT ['embedding', 'reranker', 'other'][event_id % 4 + 1] AS stage, max(event_id % 700)::DOUBLE AS peak_mb FROM events WHERE event_id % 4 < 3 GROUP BY 1)
SELECT * FROM (SELECT stage, peak_mb, CASE WHEN peak_mb IS NULL THEN 'missing' WHEN peak_mb > 600 THEN 'over budget' END AS problem FROM p FULL JOIN (SELECT unnest(['embedding', 'reranker', 'vectorstore']) AS stage) USING (stage)) WHERE problem IS NOT NULL
"""

def workspace_removal(spark, sf_dir):
    """Documents of sessions (users) without every fifth one, and without whole sessions of users that 11 divides."""
    docs = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("doc_id"))
    one = docs.where("doc_id % 5 = 0")
    whole = docs.where("session_id % 11 = 0").select("session_id", F.lit(None).cast("long").alias("doc_id")).distinct()
    return workspace.removed(docs, one.unionByName(whole)).select("session_id", "doc_id")


def workspace_vectors(spark, sf_dir):
    """Two chunks of each document, in the order in which a session asks for its documents: the latest first."""
    docs = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("doc_id"), (-F.col("event_id")).alias("position"))
    held = docs.select("session_id", "doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    return longs(workspace.vectors_for(held, docs.where("doc_id % 3 > 0")))


def scope_states(spark, sf_dir):
    """Questions of sessions: some without documents, some whose chunks and vectors differ in number."""
    events = table(spark, sf_dir, "events")
    docs = events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("doc_id"), F.when(F.col("user_id") % 4 == 0, 2).otherwise(1).alias("chunks")).where("session_id % 3 > 0")
    asked = events.select(F.col("event_id").alias("qid"), F.when(F.col("event_id") % 7 == 0, "corpus").otherwise("workspace").alias("scope"), F.col("user_id").alias("session_id"))
    return longs(workspace.scope_problems(asked, docs, docs.select("session_id", "doc_id")).select("qid", "status"))


def gold_ranks(spark, sf_dir):
    """Labels (customers' nations as laws) against ranked rows (suppliers): the first with the law, the number and, where a label names one, the part."""
    labels = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_nationkey").cast("string").alias("law_id"), (F.col("c_custkey") % 3).cast("int").alias("article_no"), F.when(F.col("c_custkey") % 4 == 0, "decree-law").when(F.col("c_custkey") % 4 == 1, "cabinet-resolution").alias("part"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("law_id"), (F.col("s_suppkey") % 3).cast("int").alias("article_no"), F.when(F.col("s_suppkey") % 2 == 0, "cabinet-resolution-1").otherwise("law-1").alias("part_id"), F.col("s_suppkey").alias("rank"))
    return longs(evaluate.gold_ranks(labels, suppliers))


def payload_columns(spark, sf_dir):
    """What is stored beside a vector, read back: all fields but the unit label."""
    d, lit = F.col, F.lit
    chunks = table(spark, sf_dir, "documents").select(
        d("doc_id").alias("chunk_id"), d("source").alias("law_id"), d("source").alias("law_label"), lit("t").alias("law_title"), lit("p").alias("part_id"), lit("P").alias("part_title"), d("doc_id").alias("article_no"), d("lang").alias("article_title"),
        lit("").alias("section"), lit(0).alias("seq"), lit(1).alias("seq_total"), lit(1).alias("page_start"), lit(2).alias("page_end"), "text", d("n_chars").alias("token_count"), lit("Section").alias("unit_label"))
    return longs(dense.payload(chunks))


def chunk_lookup(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("law_id"))
    return longs(workspace.chunk_lookup(chunks, table(spark, sf_dir, "events").select((F.col("event_id") * 3).alias("chunk_id")).distinct()))


QUERIES = {
    "workspace_removal": (workspace_removal, "SELECT user_id AS session_id, event_id AS doc_id FROM events WHERE event_id % 5 > 0 AND user_id % 11 > 0"),
    "workspace_vectors": (workspace_vectors, "SELECT user_id AS session_id, event_id AS doc_id, s AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, s) AS row_no FROM events, (SELECT unnest([0::BIGINT, 1]) AS s) WHERE event_id % 3 > 0"),
    "scope_states": (scope_states, "SELECT event_id AS qid, CASE WHEN event_id % 7 = 0 THEN 200 WHEN user_id % 3 = 0 THEN 409 WHEN user_id % 4 = 0 THEN 500 ELSE 200 END::BIGINT AS status FROM events"),
    "gold_ranks": (gold_ranks, """SELECT c_custkey AS qid, min(s_suppkey) AS gold_rank FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey % 3 = c_custkey % 3
      AND (c_custkey % 4 > 1 OR (c_custkey % 4 = 0 AND s_suppkey % 2 = 1) OR (c_custkey % 4 = 1 AND s_suppkey % 2 = 0)) GROUP BY c_custkey"""),
    "payload_columns": (payload_columns, "SELECT doc_id AS chunk_id, source AS law_id, source AS law_label, 't' AS law_title, 'p' AS part_id, 'P' AS part_title, doc_id AS article_no, lang AS article_title, '' AS section, 0::BIGINT AS seq, 1::BIGINT AS seq_total, 1::BIGINT AS page_start, 2::BIGINT AS page_end, text, n_chars AS token_count FROM documents"),
    "chunk_lookup": (chunk_lookup, "SELECT e.id AS chunk_id, source AS law_id, (doc_id IS NOT NULL)::BIGINT AS found FROM (SELECT DISTINCT event_id * 3 AS id FROM events) e LEFT JOIN documents ON doc_id = e.id"),
    "digest_check": (digest_check, "SELECT doc_id || '.txt' AS filename, CASE WHEN doc_id % 10 = 0 THEN 'missing' ELSE 'digest differs' END AS problem FROM documents WHERE doc_id % 10 = 0 OR doc_id % 3 = 2"),
    "unknown_laws": (unknown_laws, "SELECT item_id AS qid, 'src' || (item_id % 30) AS law_id FROM benchmark WHERE item_id % 7 > 0 AND 'src' || (item_id % 30) NOT IN (SELECT source FROM documents)"),
    "answer_relevance_all": (answer_relevance_all, "SELECT q.vec_id AS qid, coalesce(round(avg(list_cosine_similarity(q.embedding::DOUBLE[], g.embedding::DOUBLE[])), 6), 0.0::DOUBLE) AS relevance FROM embeddings q LEFT JOIN embeddings g ON g.label = q.label AND g.vec_id <> q.vec_id GROUP BY q.vec_id"),
    "faithfulness": (faithfulness, "SELECT doc_id % 50 AS qid, count(*) AS claims, round(avg((quality = 1)::INT), 6) AS faithfulness FROM labels GROUP BY 1"),
    "budget_log": (budget_log, BUDGET_SQL),
    "session_purge": (session_purge, """
WITH s AS (SELECT user_id AS session_id, min(ts) AS created_at, max(ts) AS touched_at FROM events GROUP BY user_id)
SELECT * FROM s WHERE epoch((SELECT max(ts) FROM events)) // 1 - epoch(touched_at) // 1 <= 172800 ORDER BY touched_at DESC, session_id DESC LIMIT 40"""),
    "session_runs": (session_runs, """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) // 1 - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) // 1 <= 172800 THEN 0 ELSE 1 END AS n FROM events),
r AS (SELECT user_id, ts, (sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING))::BIGINT AS session_no FROM g)
SELECT user_id AS session_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM r GROUP BY ALL"""),
    "doc_cap": (doc_cap, "SELECT user_id AS session_id, event_id AS doc_id, CASE WHEN event_id % 4 = 0 THEN 'empty' WHEN row_number() OVER (PARTITION BY user_id, event_id % 4 > 0 ORDER BY ts, event_id) <= 2 THEN 'added' ELSE 'full' END AS status FROM events"),
    "rate_limit_minute": (rate_limit_minute, "SELECT user_id % 10 AS client, date_trunc('minute', ts) AS minute, count(*) AS requests, count(*) - 1 AS rejected FROM events GROUP BY ALL HAVING count(*) > 1"),
    "stream_rate_batch": (stream_rate_batch, "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY ALL"),
    "stream_sessions_batch": (stream_sessions_batch, """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 172800 SECOND THEN 0 ELSE 1 END AS n FROM events),
r AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM r GROUP BY user_id, k"""),
    "stream_sessions_run": (stream_sessions_run, """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 172800 SECOND THEN 0 ELSE 1 END AS n FROM events),
r AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM r GROUP BY user_id, k"""),
    "stream_rate_run": (stream_rate_run, "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY ALL"),
    "usage_cost": (usage_cost, "SELECT event_id, round((length(props) * CASE event_type WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 2.0 ELSE 3.0 END + (event_id % 700) * CASE event_type WHEN 'click' THEN 5.0::DOUBLE WHEN 'view' THEN 4.0 ELSE 15.0 END) / 1000000, 6) AS usd FROM events"),
    "latency_summary": (latency_summary, "SELECT event_type, round(median(value), 1) AS p50_ms, round(list_sort(list(value))[least(count(*) - 1, floor(count(*) * 0.95))::INT + 1], 1) AS p95_ms, round(max(value), 1) AS max_ms FROM events WHERE value IS NOT NULL GROUP BY event_type"),
    "upper_median": (upper_median, "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS p50_ms FROM events WHERE value IS NOT NULL GROUP BY event_type"),
    "request_problems": (request_problems, "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 OR trim(text) = '' THEN 'blank question' WHEN length(text) > 1000 THEN 'question too long' WHEN conv_id % 4 = 0 THEN 'unknown scope' WHEN conv_id % 25 > 20 THEN 'too many turns' END AS problem FROM conversations"),
    "label_quality_join": (label_quality_join, "SELECT source, count(*) AS docs, count(quality) AS labelled, coalesce(sum(quality), 0)::BIGINT AS good, coalesce(sum(toxic), 0)::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"),
    "label_verification": (label_verification, LABEL_SQL),
    "law_counts": (law_counts, "SELECT source AS law_id, count(*) AS chunks, count(DISTINCT (lang, doc_id % 9)) AS articles FROM documents GROUP BY source"),
    "manifest_join": (manifest_join, "SELECT 'src' || n_nationkey AS law_id, n_name AS label, coalesce(chunks, 0) AS chunks, coalesce(articles, 0) AS articles FROM nation LEFT JOIN (SELECT source, count(*) AS chunks, count(DISTINCT (lang, doc_id % 9)) AS articles FROM documents GROUP BY source) ON source = 'src' || n_nationkey"),
    "health": (health, "SELECT c AS chunks, p AS points, (c = p AND c > 0)::BIGINT AS ok FROM (SELECT count(*) AS c FROM documents), (SELECT count(*) AS p FROM embeddings)"),
    "store_stats": (store_stats, "SELECT count(DISTINCT user_id) AS sessions, count(*) AS documents, sum(event_id % 4)::BIGINT AS chunks FROM events"),
    "document_notices": (document_notices, NOTICE_SQL),
    "event_log": (event_log, EVENT_LOG_SQL),
}

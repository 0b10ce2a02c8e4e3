"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, knn, langid, licenses, mixing, neardup, repeats, sharding, tiff, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows by integer inner product for every vec_id divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""


def op2_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a TIFF file, its pages read back."""
    files = tiff.encode_texts(table(spark, sf_dir, "documents"))
    return tiff.digest_files(files).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages")


def op3_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op4_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most (the law ``rows``)."""
    text = F.encode("text", "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"),
    )
    placed = sharding.shard_rows(docs, ["doc_id", "size", "text_crc32"], 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out()))
    return langid.identify(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text without the 400-byte strings that repeat; beside it, without the shared passages of 50 words or more but their first copies."""
    rows = repeats.removed_beside_cleaned(table(spark, sf_dir, "documents"))
    digests = [F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept")]
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", *digests, "n_shared", "n_passages", "text")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as token ids, and these as bytes again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical digest of every whole text, and the licence that it is, if any."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def license_sql() -> str:
    """The canonical form line by line: DuckDB's patterns can't look around, so paragraphs and their leading notices are lists."""
    spellings = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in licenses.SPELLINGS.items())
    known = ", ".join(f"('{d}', '{n}')" for d, n in licenses.digest_list(licenses.KNOWN) + licenses.FULL)
    notice = rf"regexp_matches(x, '^{licenses.START}copyright[ \t:]+') AND NOT regexp_matches(x, '^{licenses.START}copyright[ \t:]{licenses.BODY}')"
    closing = rf"i = len(lines) AND regexp_matches(x, '^{licenses.START}\(c\).{{1,60}}$')"
    return rf"""
WITH l AS (SELECT doc_id, string_split(lower(text), chr(10)) AS lines FROM documents),
blank AS (SELECT doc_id, list_transform(lines, lambda x, i: CASE WHEN i > 1 AND i < len(lines) AND NOT regexp_matches(x, '[\p{{L}}\p{{N}}]') THEN '' ELSE x END) AS lines FROM l),
dated AS (SELECT doc_id, list_transform(lines, lambda x: regexp_replace(x, '(?s)^{licenses.START}{licenses.DATED}', '')) AS lines FROM blank),
paragraphs AS (SELECT doc_id, regexp_split_to_array(regexp_replace(array_to_string(lines, chr(10)), '\n$', ''), '\n{{2,}}') AS ps FROM dated),
each AS (SELECT doc_id, ps, unnest(ps) AS p, generate_subscripts(ps, 1) AS no FROM paragraphs),
flagged AS (SELECT doc_id, no, string_split(p, chr(10)) AS lines FROM each),
led AS (SELECT doc_id, no, lines, list_position(list_transform(lines, lambda x, i: ({notice}) OR ({closing})), false) AS stop FROM flagged),
kept AS (SELECT doc_id, string_agg(CASE WHEN coalesce(stop, 0) = 0 THEN '' ELSE array_to_string(lines[stop:], chr(10)) END, chr(10) ORDER BY no) AS body FROM led GROUP BY doc_id),
words AS (SELECT documents.doc_id, CASE WHEN text IS NOT NULL THEN string_split(trim(regexp_replace(coalesce(body, ''), '{licenses.OTHER}', ' ', 'g')), ' ') END AS w FROM documents LEFT JOIN kept USING (doc_id)),
digests AS (SELECT doc_id, sha256(array_to_string(list_transform(w, lambda x: CASE x {spellings} ELSE x END), ' ')) AS canonical_sha256 FROM words)
SELECT doc_id, canonical_sha256, license FROM digests LEFT JOIN (VALUES {known}) known(digest, license) ON canonical_sha256 = digest
"""


def op9_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mixed_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), coalesce(source, 'null'), md5(coalesce(text, '')))) AS place
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place_no FROM sized GROUP BY source
), s1 AS (
  SELECT *, CASE (place_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s0
), s2 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY cap / weight, place_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s1
), s3 AS (
  SELECT *, CASE WHEN cap <= weight * level THEN cap::DOUBLE ELSE weight * max(CASE WHEN cap > weight * level THEN level END) OVER () END AS target FROM s2
), s4 AS (
  SELECT *, least(cap, round(target)::BIGINT) AS words, (source_size + 999) // 1000 AS n_blocks FROM s3
), s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN (words // source_size) * n_blocks + (words % source_size + 999) // 1000 ELSE 0 END AS slots FROM s4
), src AS (
  SELECT *, (sum(slots) OVER (ORDER BY place_no))::BIGINT AS up_to FROM s5
), points AS (
  SELECT slot, ((slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE * (SELECT max(up_to) FROM src) AS x
  FROM (SELECT unnest(range((SELECT coalesce(max(up_to), 0) FROM src)::BIGINT)) AS slot)
), drawn AS (
  SELECT slot, (SELECT min(place_no) FROM src WHERE up_to > x) AS place_no FROM points
), ranked AS (
  SELECT place_no, row_number() OVER (PARTITION BY place_no ORDER BY slot) - 1 AS rank FROM drawn
), given AS (
  SELECT place_no, count(*) AS n FROM ranked GROUP BY place_no
), every AS (
  SELECT place_no, rank FROM ranked
  UNION ALL SELECT src.place_no, unnest(range(coalesce(n, 0)::BIGINT, slots::BIGINT)) FROM src LEFT JOIN given USING (place_no)
), cut AS (
  SELECT place_no, rank % n_blocks AS block, (rank % n_blocks) * 1000 AS lo,
         least((rank % n_blocks) * 1000 + 1000, source_size, (rank % n_blocks) * 1000 + words - (rank // n_blocks) * source_size - (rank % n_blocks) * 1000) AS hi
  FROM every JOIN src USING (place_no) WHERE rank < slots
), at_words AS (
  SELECT doc_id, size, source_size, target, place_no, row_number() OVER () AS row_no,
         (sum(size) OVER (PARTITION BY place_no ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM sized JOIN src ON sized.source IS NOT DISTINCT FROM src.source
), got AS (
  SELECT row_no, sum(greatest(0, least(hi, start + size) - greatest(lo, start))) AS taken
  FROM (SELECT *, unnest(range(start // 1000, (start + size - 1) // 1000 + 1)) AS block FROM at_words WHERE size > 0) JOIN cut USING (place_no, block)
  GROUP BY row_no
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM at_words LEFT JOIN got USING (row_no)
"""


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of normalised archives, read back by offset."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pivot_topk": op1_pivot_topk,
        "op2_tiff_pages": op2_tiff_pages,
        "op3_probminhash": op3_probminhash,
        "op4_hypergeometric_shards": op4_hypergeometric_shards,
        "op5_kneser_ney": op5_kneser_ney,
        "op6_run_length_index": op6_run_length_index,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_license_digests": op8_license_digests,
        "op9_golden_mix": op9_golden_mix,
        "op10_warc_round_trip": op10_warc_round_trip,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_topk": OP1_SQL, "op8_license_digests": license_sql(), "op9_golden_mix": OP9_SQL, "op10_warc_round_trip": OP10_SQL}

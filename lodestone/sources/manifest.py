"""Declared sources, their digests, and provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNPINNED = "0" * 64
MIN_PDF_BYTES = 8192
SOURCE = "law_id string, label string, title string, jurisdiction string, publisher string, language string, filename string, official_url string, mirror_url string, sha256 string, article_pattern string, notes string, bytes long, retrieved_from string"


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """The declared sources of a JSON file with a ``documents`` list; an empty list is an error."""
    rows = spark.read.schema(f"documents array<struct<{SOURCE.replace(' string', ': string').replace(' long', ': bigint')}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = rows.select(F.explode("documents").alias("d")).select("d.*")
    if out.isEmpty():
        raise ValueError(f"{path} declares no documents")
    return out


def chosen_url(official: Column, mirror: Column, official_ok: Column) -> Column:
    """The official address if it served the file, else the mirror."""
    return F.when(official_ok, official).otherwise(mirror)


def fetch_problem(url: Column, content: Column) -> Column:
    """Why a fetched file is refused, or null: not https, no PDF, too small."""
    return F.when(~url.startswith("https://"), "not https").when(F.substring(content, 1, 5) != F.encode(F.lit("%PDF-"), "UTF-8"), "not a PDF").when(F.octet_length(content) < MIN_PDF_BYTES, "too small")


def download(urls: list[str], get: Callable[[str], bytes]) -> tuple[str | None, bytes | None, str | None]:
    """(retrieved_from, content, problem) of the first of the URLs that serves a whole PDF; the problems of all if none does."""
    problems = []
    for url in filter(None, urls):
        if not url.startswith("https://"):
            problems.append(f"{url}: not https")
            continue
        try:
            content = get(url)
        except (OSError, ValueError) as e:
            problems.append(f"{url}: {e}")
            continue
        if content.startswith(b"%PDF-") and len(content) >= MIN_PDF_BYTES:
            return url, content, None
        problems.append(f"{url}: " + ("too small" if content.startswith(b"%PDF-") else "not a PDF"))
    return None, None, "; ".join(problems) or "no URL is declared"


def downloaded(manifest: DataFrame, get: Callable[[str], bytes]) -> DataFrame:
    """(filename, retrieved_from, content, problem) of declared sources: the official address, then the mirror. ``get`` is the network."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, official, mirror in zip(*(batch.column(c).to_pylist() for c in ("filename", "official_url", "mirror_url")), strict=True):
                url, content, problem = download([official, mirror], get)
                row = [pa.array([name], pa.string()), pa.array([url], pa.string()), pa.array([content], pa.binary()), pa.array([problem], pa.string())]
                yield pa.record_batch(row, names=["filename", "retrieved_from", "content", "problem"])

    return manifest.select("filename", "official_url", "mirror_url").mapInArrow(run, "filename string, retrieved_from string, content binary, problem string")


def digest_problems(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(filename, problem): declared files that are missing or differ from their pin; a pin of zeros passes.

    Files are (path, content), as the ``binaryFile`` source reads them.
    """
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("found"))
    joined = manifest.select("filename", "sha256").join(own, "filename", "left")
    problem = F.when(F.col("found").isNull(), "missing").when((F.col("sha256") != UNPINNED) & (F.lower("sha256") != F.col("found")), "digest differs")
    return joined.select("filename", problem.alias("problem")).where("problem IS NOT NULL")


def pinned(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest with the digests and sizes of the files on disk."""
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.sha2("content", 256).alias("_sha"), F.octet_length("content").cast("long").alias("_bytes"))
    return manifest.join(own, "filename", "left").withColumn("sha256", F.coalesce("_sha", "sha256")).withColumn("bytes", F.coalesce("_bytes", "bytes")).drop("_sha", "_bytes")


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows with a fixed schema; a missing file fails, as does a malformed row."""
    return spark.read.schema(SOURCE).option("mode", "FAILFAST").json(path)

"""WARC archives: write whole-file gzip streams, normalise them to one gzip member per record, read back by offset.

A monolithic archive is one gzip stream around all its records, so nothing in it can be read without
inflating what stands before. The normaliser inflates such a stream once, in pieces, and rewrites each record
as a member of its own with a sidecar index of (offset, length, type, id) lines; the reader then seeks.

Files go to a folder that all executors share, by any URI that ``pyarrow.fs`` resolves. Every file has a
name of its own per task attempt and only the names that committed tasks return are read on, so a lost executor
or a second attempt leaves at most an unread file behind.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import keyed, scratch, stored

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 8 << 20
PIECE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture time; a fixed date keeps archives reproducible
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, record_type, refers_to) for each row.

    Of rows with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, that with the smallest id is the response
    and the others revisit it; smaller payloads are all responses. A null payload counts as empty. A row without an
    id is a response, as is a repeat of the smallest id. Only digests that occur more than once are joined,
    after a pre-aggregation; a hot digest is split by adaptive skew handling.
    """
    payload = F.encode(F.coalesce(F.col("payload"), F.lit("")), "UTF-8")
    rows = keyed(pages, page_id=id_col, url=url_col, payload=payload_col).withColumn("payload", payload)
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select("digest", "first_id")
    revisits = F.col("page_id") > F.col("first_id")  # null when either is null
    joined = rows.join(first, "digest", "left")
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "digest",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("first_id")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    text = urn.strip("<>").rpartition(":")[2]
    return None if text == "none" else int(text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload of its own; its length stands in an extension field."""
    block = HTTP + payload if kind == "response" else HTTP
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; raises ValueError on what is no WARC header."""
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces."""
    engine, data = zlib.decompressobj(31), source.read(PIECE)
    while data:
        out = engine.decompress(data, PIECE)
        if out:
            yield out
        if engine.eof:
            rest = engine.unused_data.lstrip(b"\0") or source.read(PIECE)
            engine, data = zlib.decompressobj(31), rest
        else:
            data = engine.unconsumed_tail or source.read(PIECE)
            if not data and not engine.eof and not out:
                raise ValueError("the gzip stream is truncated")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, the whole record's bytes) of each record in a stream."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a header")
                return
        fields = parse_head(bytes(held[:end]))
        total = end + 4 + int(fields["content-length"]) + 4
        while len(held) < total:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(held[:total])
        del held[:total]


def opened(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``record_types`` as whole-file gzip archives of about ``archive_bytes``; one row a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = engine = path = None
        size = count = 0

        def close():
            sink.write(engine.flush())
            sink.close()
            return pa.record_batch([pa.array([path]), pa.array([count], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                if sink is None:
                    path, engine, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                    fs, inner = opened(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    sink = fs.open_output_stream(inner, compression=None)
                data = record(*r)
                sink.write(engine.compress(data))
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return rows.mapInArrow(write, "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive with one gzip member per record and a sidecar index; one row per rewritten file.

    Works on any gzip framing: a file of one member, of many, or already normalised. A truncated or malformed archive
    raises ValueError.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                base = f"{folder}/{uuid.uuid4().hex}"
                fs, inner = opened(source)
                _, target = opened(base)
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                at = n = 0
                with fs.open_input_stream(inner, compression=None) as raw, fs.open_output_stream(f"{target}.warc.gz", compression=None) as out, fs.open_output_stream(f"{target}.idx", compression=None) as index:
                    for fields, data in records(inflated(raw)):
                        engine = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = engine.compress(data) + engine.flush()
                        out.write(member)
                        index.write(json.dumps([at, len(member), fields["warc-type"], fields["warc-record-id"]]).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.record_batch([pa.array([f"{base}.warc.gz"]), pa.array([f"{base}.idx"]), pa.array([n], pa.int64())], names=["archive", "index", "records"])

    return archives.mapInArrow(rewrite, "archive string, index string, records long")


READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def read_record(member: bytes) -> tuple:
    """(page_id, type, payload bytes, payload digest, refers_to) of one member; the digest of a response is computed anew."""
    data = zlib.decompress(member, 31)
    end = data.index(b"\r\n\r\n")
    fields = parse_head(data[:end])
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    payload, said = block[block.index(b"\r\n\r\n") + 4 :], fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "revisit":
        return page_of(fields["warc-record-id"]), "revisit", int(fields["x-payload-length"]), said, page_of(fields["warc-refers-to"])
    if (digest := hashlib.sha256(payload).hexdigest()) != said:
        raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
    return page_of(fields["warc-record-id"]), fields["warc-type"], len(payload), digest, None


def read_indexed(normalised: DataFrame) -> DataFrame:
    """One row per record, each read on its own by the offset and length of the sidecar index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist(), strict=True):
                fs, inner = opened(path)
                found = []
                with fs.open_input_stream(opened(index)[1], compression=None) as f:
                    lines = [json.loads(x) for x in f.read().splitlines()]
                with fs.open_input_file(inner) as f:
                    for at, length, _, _ in lines:
                        f.seek(at)
                        found.append((*read_record(f.read(length)), at, length))
                for k in range(0, len(found), 5000):
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*found[k : k + 5000], strict=True), READ.types, strict=True)], schema=READ)

    return normalised.mapInArrow(read, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long, length long")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Pages -> monolithic archives -> normalised archives with index -> one row per record read back.

    Empty tables give no rows. Between the steps only file names pass through Spark.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    raw = stored(write_archives(record_types(pages, id_col, url_col, payload_col), f"{folder}/raw"), "warc-raw")
    files = max(1, raw.count())
    clean = stored(normalise(raw.repartition(files), f"{folder}/clean"), "warc-clean")
    return read_indexed(clean.repartition(files))

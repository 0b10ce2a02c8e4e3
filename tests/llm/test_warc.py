import gzip
import hashlib
import io
import json
import os

import pytest
from conftest import DATA, same_as_duckdb

from lodestone.llm import queries, warc
from lodestone.llm.common import scratch

SCHEMA = "page_id long, url string, html string, digest int, payload string"


def test_matches_sql_on_a_table(spark):
    assert same_as_duckdb(queries.op10_warc_round_trip(spark, f"{DATA}/sf0.01"), queries.OP10_SQL, f"{DATA}/sf0.01") == 250


def test_nulls_copies_long_texts_and_clashing_columns(spark):
    long = "é" * 300_000
    rows = [(7, "u", "a" * 100), (3, None, "a" * 100), (9, "u\r\nX: 1", "a" * 99), (1, "u", "a" * 99), (4, "u", None), (5, "u", ""), (None, "u", "a" * 100), (3, "u", "a" * 100), (20, "u", long), (21, "u", long), (22, "u", "x\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA)
    got = sorted(map(tuple, warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        again = len(data) >= 100 and i is not None and i > min(same)
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_each_record_is_a_member_at_its_indexed_offset(spark):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 50, 1, "z") for i in range(40)], SCHEMA)
    folder = scratch(spark, "warc-test")
    raw = warc.write_archives(warc.record_types(df).coalesce(1), folder, archive_bytes=5000).cache()
    assert raw.count() > 1
    done = warc.normalise(raw, folder).collect()
    raw.unpersist()
    n = 0
    for r in done:
        data = open(r["archive"].removeprefix("file://"), "rb").read()
        for at, length, kind, name in map(json.loads, open(r["index"].removeprefix("file://"))):
            one = gzip.decompress(data[at : at + length])
            assert one.startswith(b"WARC/1.1\r\n") and f"WARC-Type: {kind}".encode() in one and name.encode() in one
            n += 1
        assert data == b"".join(data[at : at + length] for at, length, *_ in map(json.loads, open(r["index"].removeprefix("file://"))))
    assert n == 40


def test_streams_of_any_framing_and_broken_ones():
    one = warc.record(1, "u", b"abc", "d", "response", None)
    whole, members = gzip.compress(one * 3), gzip.compress(one) * 3
    for data in (whole, members):
        assert [f["warc-record-id"] for f, _ in warc.records(warc.inflated(io.BytesIO(data)))] == ["<urn:page:1>"] * 3
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(io.BytesIO(whole[: len(whole) // 2]))))
    with pytest.raises(ValueError):
        list(warc.records(iter([one[:-30]])))
    big = gzip.compress(os.urandom(1 << 18) + b"\0" * (1 << 22))
    assert max(map(len, warc.inflated(io.BytesIO(big)))) <= warc.PIECE

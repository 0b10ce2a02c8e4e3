import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from conftest import DATA

from lodestone.llm import queries, tiff


def payloads():
    rng = random.Random(2)
    yield b"\0" * 64
    yield bytes(rng.randrange(256) for _ in range(64 * 700))
    yield (b"the same words again and again, " * 4000)[: 64 * 1999]
    yield bytes(rng.choice(b"ab") for _ in range(64 * 300))


@pytest.mark.parametrize("compression", sorted(tiff.ENCODERS))
@pytest.mark.parametrize("predictor", [1, 2])
def test_files_give_back_their_payload(compression, predictor):
    for payload in payloads():
        found = list(tiff.pages(tiff.write(payload, compression, predictor, page_rows=500)))
        assert b"".join(p.pixels for p in found) == payload
        assert [p.number for p in found] == list(range(-(-len(payload) // (64 * 500))))
        assert all(p.compression == compression and p.predictor == predictor and p.width == 64 for p in found)


def build(order, fields, blobs, big=False):
    """A file by hand: fields are (tag, type, values); ``blobs`` are put first and their offsets replace the value ``blobs``."""
    out = bytearray(b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0))
    places = []
    for b in blobs:
        places.append(len(out))
        out += b
    entries = []
    for tag, kind, values in fields:
        values = places if values == "blobs" else values
        data = struct.pack(f"{order}{len(values)}{tiff.TYPE_CODES[kind]}", *values)
        room = 8 if big else 4
        if len(data) > room:
            at, data = len(out), data
            out += data
            data = struct.pack(order + ("Q" if big else "I"), at)
        entries.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(values)) + data.ljust(room, b"\0"))
    struct.pack_into(order + ("Q" if big else "I"), out, 8 if big else 4, len(out))
    out += struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries) + b"\0" * (8 if big else 4)
    return bytes(out)


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("big", [False, True])
def test_tiles_planes_and_wide_samples(order, big):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 65536, (37, 45, 3), dtype=np.uint16)
    tiles = []
    for plane in range(3):
        for y in range(0, 37, 16):
            for x in range(0, 45, 32):
                tile = np.zeros((16, 32), np.uint16)
                part = image[y : y + 16, x : x + 32, plane]
                tile[: part.shape[0], : part.shape[1]] = part
                tile = np.concatenate([tile[:, :1], np.diff(tile, axis=1)], axis=1)
                tiles.append(zlib.compress(tile.astype(np.dtype(np.uint16).newbyteorder(order)).tobytes()))
    kind = 16 if big else 4
    data = build(order, [(256, 4, [45]), (257, 3, [37]), (258, 3, [16] * 3), (259, 3, [8]), (277, 3, [3]), (284, 3, [2]), (317, 3, [2]), (322, 3, [32]), (323, 3, [16]), (324, kind, "blobs"), (325, kind, list(map(len, tiles)))], tiles, big)
    (page,) = tiff.pages(data)
    assert page.samples == 3 and page.bits == 16 and page.pixels == image.astype("<u2").tobytes()


def test_chunky_strips_with_a_short_last_one():
    image = np.random.default_rng(2).integers(0, 256, (10, 7, 3), dtype=np.uint8)
    strips = [tiff.pack_bits(image[y : y + 4].tobytes()) for y in (0, 4, 8)]
    data = build(">", [(256, 3, [7]), (257, 3, [10]), (258, 3, [8] * 3), (259, 3, [32773]), (273, 4, "blobs"), (277, 3, [3]), (278, 3, [4]), (279, 3, list(map(len, strips)))], strips)
    (page,) = tiff.pages(data)
    assert page.pixels == image.tobytes()


def test_known_codes():
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 99) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.un_lzw(tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_broken_files_give_a_reason(spark):
    good = tiff.write(b"\1" * 64 * 1200, tiff.DEFLATE, 2, page_rows=1000)
    loop = bytearray(tiff.write(b"\0" * 64))
    at = struct.unpack_from("<I", loop, 4)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * 10, at)
    files = [(1, b"no image"), (2, None), (3, good[:-20]), (4, bytes(loop)), (5, good), (6, good[:8])]
    df = spark.createDataFrame([(i, m, 5) for i, m in files], "doc_id long, media binary, page int")
    got = {}
    for r in tiff.tiff_pages(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert all(got[i][-1]["problem"] and got[i][-1]["pixels"] is None for i in (1, 2, 3, 4, 6))
    assert [r["problem"] for r in got[5]] == [None, None] and b"".join(bytes(r["pixels"]) for r in got[5]) == b"\1" * 64 * 1200
    assert tiff.tiff_pages(df.limit(0)).count() == 0


def test_texts_through_files(spark):
    texts = [(1, "é" * 33), (2, None), (3, ""), (4, "x" * 64), (5, "long " * 300_000), (None, "y"), (1, "é" * 33)]
    df = spark.createDataFrame([(i, t, 1, "m") for i, t in texts], "doc_id long, text string, n_bytes int, media string")
    got = sorted(map(tuple, tiff.digest_files(tiff.encode_texts(df)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "problem").collect()), key=repr)
    want = []
    for i, t in texts:
        n, payload = tiff.payload_of(t)
        assert len(payload) % 64 == 0 and payload
        want.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None))
    assert got == sorted(want, key=repr)


def test_query_on_a_table(spark):
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    for r in queries.op2_tiff_pages(spark, f"{DATA}/sf0.001").collect():
        data = docs.pop(r["doc_id"])
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        media = tiff.write(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
    assert not docs


def read_again(data):
    """A second reader, of little-endian files with deflate strips and horizontal differences: (pages, samples)."""
    assert data[:4] == b"II*\0"
    at, out, n = struct.unpack_from("<I", data, 4)[0], b"", 0
    while at:
        count = struct.unpack_from("<H", data, at)[0]
        tags = {}
        for k in range(count):
            tag, kind, many, inline = struct.unpack_from("<HHII", data, at + 2 + 12 * k)
            size = {1: 1, 3: 2, 4: 4}.get(kind, 0) * many
            place = inline if size > 4 else at + 2 + 12 * k + 8
            tags[tag] = list(struct.unpack_from(f"<{many}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, place)) if size else None
        assert tags[259] == [8] and tags[317] == [2] and tags[256] == [64]
        for start, length in zip(tags[273], tags[279], strict=True):
            rows = np.frombuffer(zlib.decompress(data[start : start + length]), np.uint8).reshape(-1, 64)
            out += np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
        at, n = struct.unpack_from("<I", data, at + 2 + 12 * count)[0], n + 1
    return n, out


def test_a_second_reader_and_features_by_hand(spark):
    texts = [(1, "é" * 333), (2, None), (3, "x" * 64), (4, "long text " * 200_000)]
    files = tiff.encode_texts(spark.createDataFrame(texts, "doc_id long, text string"))
    media = {r["doc_id"]: bytes(r["media"]) for r in files.select("doc_id", "media").collect()}
    for r in tiff.digest_files(files).collect():
        pages, samples = read_again(media[r["doc_id"]])
        assert samples == tiff.payload_of(dict(texts)[r["doc_id"]])[1] and hashlib.sha256(media[r["doc_id"]]).hexdigest() == r["media_sha256"] and len(media[r["doc_id"]]) == r["media_bytes"]
        value = np.frombuffer(samples, np.uint8).astype(float)
        share = np.unique(value, return_counts=True)[1] / len(value)
        found = dict(x.split("=") for x in r["feature"].split(";"))
        assert int(found["pages"]) == pages == r["n_pages"] and int(found["values"]) == len(share)
        assert float(found["mean"]) == pytest.approx(value.mean(), abs=1e-4) and float(found["std"]) == pytest.approx(value.std(), abs=1e-4)
        assert float(found["entropy"]) == pytest.approx(-(share * np.log2(share)).sum(), abs=1e-4)

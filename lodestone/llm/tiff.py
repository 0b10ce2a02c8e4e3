"""TIFF columns: walk image directories, decode strips and tiles, undo predictors, one row per page.

Read: both byte orders, classic and BigTIFF, strips and tiles, chunky and planar samples of 8 or 16 bits, compression
none, PackBits, LZW and deflate (both codes), predictors 1 and 2. Written: classic little-endian files of 8-bit grey pages
in strips, by any of these compressions. A file that is no TIFF, ends early or uses another feature gives no page but a
row with the reason.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import keyed

NO_COMPRESSION, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 16_384, 1024
# Fixed values of the format: tags and the sizes of field types.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 273: "strip_offsets", 277: "samples", 278: "rows_per_strip", 279: "strip_counts", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts"}
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}


class Page(NamedTuple):
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes  # rows from the top, samples of a pixel together, 16-bit samples little-endian


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits; ``size`` bytes are enough."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = at + 1
        while run < len(data) and run - at < 128 and data[run] == data[at]:
            run += 1
        if run - at >= 3:
            out += bytes([257 - (run - at), data[at]])
            at = run
            continue
        end = at
        while end < len(data) and end - at < 128 and data[end : end + 1] * 3 != data[end : end + 3]:
            end += 1
        end = max(end, at + 1)
        out += bytes([end - at - 1]) + data[at:end]
        at = end
    return bytes(out)


def un_lzw(data: bytes, size: int) -> bytes:
    """LZW with codes from the most significant bit on, 9 to 12 bits wide, widened one code early."""
    table, out, held, bits, width, last = [], bytearray(), 0, 0, 9, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW code is out of range")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    codes, word, width, nxt = {bytes([i]): i for i in range(256)}, b"", 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer], nxt, word = nxt, nxt + 1, data[i : i + 1]
        width = 9 + (nxt >= 512) + (nxt >= 1024) + (nxt >= 2048)
        if nxt == 4094:
            put(codes[word])
            put(256)
            codes, word, width, nxt = {bytes([i]): i for i in range(256)}, b"", 9, 258
    if word:
        put(codes[word])
        nxt += 1
        width = 9 + (nxt >= 512) + (nxt >= 1024) + (nxt >= 2048)
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size)


DECODERS = {NO_COMPRESSION: lambda data, size: data[:size], LZW: un_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
ENCODERS = {NO_COMPRESSION: bytes, LZW: lzw, DEFLATE: lambda data: zlib.compress(data, 6), OLD_DEFLATE: lambda data: zlib.compress(data, 6), PACKBITS: pack_bits}


def directories(data: bytes) -> Iterator[tuple[str, dict]]:
    """(byte order, fields by name) of each image directory; raises ValueError on what can't be followed."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    kind = struct.unpack_from(order + "H", data, 2)[0]
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    number, entry, inline = ("Q", 20, 8) if big else ("I", 12, 4)
    try:
        at, seen = struct.unpack_from(order + number, data, 8 if big else 4)[0], set()
        while at:
            if at in seen:
                raise ValueError("the directories form a loop")
            seen.add(at)
            count = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
            at += 8 if big else 2
            fields = {}
            for k in range(count):
                tag, kind, n = struct.unpack_from(order + "HH" + number, data, at + k * entry)
                if tag not in TAGS or kind not in TYPE_CODES:
                    continue
                place = at + k * entry + entry - inline
                if n * TYPE_SIZES[kind] > inline:
                    place = struct.unpack_from(order + number, data, place)[0]
                if place + n * TYPE_SIZES[kind] > len(data):
                    raise ValueError("a field lies beyond the end")
                fields[TAGS[tag]] = struct.unpack_from(f"{order}{n}{TYPE_CODES[kind]}", data, place)
            yield order, fields
            at = struct.unpack_from(order + number, data, at + count * entry)[0]
    except struct.error as e:
        raise ValueError(f"the file ends early: {e}") from e


def block(data: bytes, offset: int, count: int, shape: tuple[int, int, int], order: str, bits: int, compression: int, predictor: int) -> np.ndarray:
    """A decoded strip or tile as [rows, columns, samples]."""
    if offset + count > len(data):
        raise ValueError("a strip or tile lies beyond the end")
    size = shape[0] * shape[1] * shape[2] * bits // 8
    raw = DECODERS[compression](data[offset : offset + count], size)
    if len(raw) < size:
        raise ValueError(f"a strip or tile has {len(raw)} of {size} bytes")
    out = np.frombuffer(raw, np.uint8 if bits == 8 else np.dtype(np.uint16).newbyteorder(order), shape[0] * shape[1] * shape[2]).reshape(shape)
    if predictor == 2:
        out = np.cumsum(out, axis=1, dtype=np.uint8 if bits == 8 else np.uint16)
    return out


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, one after the other."""
    for number, (order, f) in enumerate(directories(data)):
        one = lambda name, default=None: f.get(name, (default,))[0]  # noqa: B023, E731
        width, height, samples, compression, predictor = one("width"), one("height"), one("samples", 1), one("compression", 1), one("predictor", 1)
        bits, planes = f.get("bits", (1,)), one("samples", 1) if one("planar", 1) == 2 else 1
        if not width or not height:
            raise ValueError("a page has no size")
        if compression not in DECODERS or set(bits) - {8} and set(bits) - {16} or predictor not in (1, 2):
            raise ValueError(f"not supported: compression {compression}, bits {bits}, predictor {predictor}")
        tiled = "tile_offsets" in f
        rows, columns = (one("tile_height"), one("tile_width")) if tiled else (min(one("rows_per_strip", height), height), width)
        offsets, counts = (f["tile_offsets"], f["tile_counts"]) if tiled else (f["strip_offsets"], f["strip_counts"])
        depth, across, down = samples // planes, -(-width // columns), -(-height // rows)
        if len(offsets) != len(counts) or len(offsets) < planes * across * down:
            raise ValueError("strips or tiles are missing")
        out = np.zeros((height, width, samples), np.uint8 if bits[0] == 8 else "<u2")
        for k in range(planes * across * down):
            plane, y, x = k // (across * down), k // across % down * rows, k % across * columns
            high, wide = min(rows, height - y), min(columns, width - x)
            got = block(data, offsets[k], counts[k], (rows if tiled else high, columns, depth), order, bits[0], compression, predictor)
            out[y : y + high, x : x + wide, plane * depth : (plane + 1) * depth] = got[:high, :wide]
        yield Page(number, width, height, samples, bits[0], compression, predictor, out.tobytes())


def write(payload: bytes, compression: int = DEFLATE, predictor: int = 2, page_rows: int = PAGE_ROWS) -> bytes:
    """A file whose pages hold ``payload``, a multiple of ``WIDTH`` bytes, as 8-bit grey rows of ``WIDTH`` pixels."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 8)), 4
    for top in range(0, len(grid), page_rows):
        page = grid[top : top + page_rows]
        if predictor == 2:
            page = np.concatenate([page[:, :1], np.diff(page, axis=1)], axis=1)
        strips = [ENCODERS[compression](page[y : y + STRIP_ROWS].tobytes()) for y in range(0, len(page), STRIP_ROWS)]
        places = []
        for strip in strips:
            places.append(len(out))
            out += strip + b"\0" * (len(strip) % 2)
        lists = len(out)
        if len(strips) > 1:
            out += struct.pack(f"<{2 * len(strips)}I", *places, *map(len, strips))
        struct.pack_into("<I", out, link, len(out))
        entries = [(256, 4, 1, WIDTH), (257, 4, 1, len(page)), (258, 3, 1, 8), (259, 3, 1, compression), (262, 3, 1, 1), (273, 4, len(strips), places[0] if len(strips) == 1 else lists), (277, 3, 1, 1), (278, 4, 1, STRIP_ROWS), (279, 4, len(strips), len(strips[0]) if len(strips) == 1 else lists + 4 * len(strips)), (317, 3, 1, predictor)]
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


# DataFrame operators


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, these with zero bytes up to a positive multiple of ``WIDTH``)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def small_batches(rows: Iterator[dict], schema: pa.Schema, weight: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` bytes of the column ``weight``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"")
        if size >= limit or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, null as empty, as a TIFF file. Narrow: no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    n, payload = payload_of(text.as_py())
                    yield {"doc_id": doc_id, "n_bytes": n, "media": write(payload, compression)}

        yield from small_batches(rows(), schema, "media")

    return keyed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def tiff_pages(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: doc_id, page (from 0), width, height, samples, bits, compression, predictor, pixels, problem.

    A file that can't be read on gives the pages before the fault and then one row with ``problem`` and null pixels; so does
    a null file. An empty table gives no rows. Works a file at a time, so memory is bounded by the largest file.
    """
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int32()) for c in ("page", "width", "height", "samples", "bits", "compression", "predictor")], ("pixels", pa.binary()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for doc_id, media in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                    try:
                        for p in pages(media.as_py() or b""):
                            yield {"doc_id": doc_id, "page": p.number, "width": p.width, "height": p.height, "samples": p.samples, "bits": p.bits, "compression": p.compression, "predictor": p.predictor, "pixels": p.pixels, "problem": None}
                    except (ValueError, KeyError, IndexError, zlib.error) as e:
                        yield {"doc_id": doc_id, "pixels": None, "problem": f"{type(e).__name__}: {e}"}

        yield from small_batches(rows(), schema, "pixels")

    ddl = "doc_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, problem string"
    return keyed(files, doc_id=id_col, media=media_col).select(F.col("doc_id").cast("long"), "media").mapInArrow(run, ddl)


def feature(histogram: np.ndarray, n_pages: int) -> str:
    """Pages, distinct sample values, mean, standard deviation and entropy in bits of the samples."""
    total = histogram.sum()
    if not total:
        return f"pages={n_pages};values=0;mean=0;std=0;entropy=0"
    share, value = histogram / total, np.arange(256)
    mean = float((share * value).sum())
    std = float(np.sqrt(max(0.0, (share * value**2).sum() - mean**2)))
    some = share[share > 0]
    return f"pages={n_pages};values={len(some)};mean={mean:.4f};std={std:.4f};entropy={max(0.0, float(-(some * np.log2(some)).sum())):.4f}"


def digest_files(files: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """One row per file: digests and features of the samples that its pages hold, page after page.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the last ``WIDTH`` bytes), media_bytes, media_sha256, n_pages, feature and
    problem. With a problem the digests cover the pages before it. ``keep`` names long columns that are passed on.
    """
    names = [*keep, "payload_bytes", "tail_crc32", "media_bytes", "n_pages"]
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in names], *[(c, pa.string()) for c in ("payload_sha256", "media_sha256", "feature", "problem")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            own = [batch.column(c).to_pylist() for c in keep]
            for i, (doc_id, scalar) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True)):
                media = scalar.as_py() or b""
                sha, histogram, tail, size, n, problem = hashlib.sha256(), np.zeros(256, np.int64), b"", 0, 0, None
                try:
                    for p in pages(media):
                        sha.update(p.pixels)
                        histogram += np.bincount(np.frombuffer(p.pixels, np.uint8), minlength=256)
                        tail, size, n = (tail + p.pixels)[-WIDTH:], size + len(p.pixels), n + 1
                except (ValueError, KeyError, IndexError, zlib.error) as e:
                    problem = f"{type(e).__name__}: {e}"
                out.append({"doc_id": doc_id, **{c: own[k][i] for k, c in enumerate(keep)}, "payload_bytes": size, "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "n_pages": n, "feature": feature(histogram, n), "problem": problem})
            yield pa.RecordBatch.from_pylist(out, schema)

    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", payload_sha256 string, media_sha256 string, feature string, problem string"
    return keyed(files, doc_id=id_col, media=media_col, **{c: c for c in keep}).select(F.col("doc_id").cast("long"), "media", *[F.col(c).cast("long") for c in keep]).mapInArrow(run, ddl)

"""Removal of passages that repeat: run-length index over suffixes, matching statistics, long matches marked.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the table, in the same document
or another (``first=False``), or starts in an earlier document (``first=True``: the copy in the document of the least id stays). The work is
split exactly by minimizers: the least hash of the ``K``-byte strings in a window of ``length`` bytes
names the bucket of that window, so equal windows meet. Neighbouring windows of one name form a segment. Texts are read in pieces of
``PIECE`` bytes that overlap by a window less a byte, so a very long text costs no more memory than a piece.

1. Segments are listed as names, content hashes and places, without their bytes; those whose name occurs once are left out, equal ones are
   counted. Where a segment's content occurs twice, all its bytes repeat.
2. Names under which different contents met, or that occur twice in a segment, go on with one copy of each content. Blocks of whole names are
   indexed: a run-length Burrows-Wheeler transform with the suffix positions at the run ends. The matching statistics, the longest match of
   each suffix with the one before it in the order, stream from the samples, since within a run a match shrinks by one byte per step. Neighbours
   in the order with matches of ``length`` or more are one string, and the bytes under its occurrences are marked.
3. Names with more different bytes than ``HOT_BYTES`` don't form a block: their windows are counted one by one by a 128-bit hash.

Nothing is gathered on the driver, and a task holds one block at a time. Neighbouring marks are merged as they stream by, sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, give_back, mixed, stored, tidied

LENGTH = 400
K = 32
BLOCK_BYTES = 1 << 20  # a block is closed before a name would lift it above this; a larger name is a block of its own
HOT_BYTES = 4 << 20
SLICE = 1 << 18  # positions of an index that are worked on at once
LONGEST_SEGMENT = 4096  # windows; longer runs of one name (periodic text) are cut, with the overlap that keeps every window
BATCH_BYTES = 4 << 20
PIECE = 1 << 20  # bytes of a text that are read at once
SEPARATOR = 0xFF  # no byte of UTF-8


def window_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes (a multiple of 8) from each position that has so many."""
    n = len(data) - k + 1
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.uint64).ravel()
    out = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at in range(8, k, 8):
        out = mixed(out) + words[at : at + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed(out)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from running minima within blocks."""
    n = len(values) - width + 1
    blocks = np.concatenate([values, np.full(-len(values) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


POWER = 0x9E3779B97F4A7C15 | 1


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def segments(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, content hash, start, bytes, again) of the segments of one text of at least ``length`` bytes.

    ``again`` tells that the string behind the name occurs more than once in the segment, so a window may repeat within it.
    """
    h, width = window_hashes(data), length - K + 1
    names = least_in_windows(h, width)
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
    ends = np.append(starts[1:], len(names))
    if (ends - starts).max() > LONGEST_SEGMENT:
        parts = [np.arange(a, b, LONGEST_SEGMENT) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        starts = np.concatenate(parts)
        ends = np.append(starts[1:], len(names))
    # Prefix sums of hashed strings times powers: equal contents give equal differences after the shift is divided out.
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(len(h), POWER))])
    back = powers(len(h) + 1, pow(POWER, -1, 1 << 64))
    content = mixed((sums[ends + length - K] - sums[starts]) * back[starts])
    own, views = names[starts], np.lib.stride_tricks.sliding_window_view(h, width)
    again = ends - starts > width
    for at in range(0, len(starts), 4096):
        part = slice(at, at + 4096)
        fresh = np.arange(width)[None, :] >= np.maximum(0, starts[part] + width - ends[part] + 1)[:, None]
        count = (views[starts[part]] == own[part, None]).sum(1) + ((views[ends[part] - 1] == own[part, None]) & fresh).sum(1)
        again[part] |= count > 1
    return own, content, starts, ends - starts + length - 1, again


def text_segments(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(name, content hash, bytes, again, start, more) of one text, piece by piece; ``more`` lists the further starts of equal segments."""
    parts = []
    for at in range(0, len(data) - length + 1, PIECE):
        name, content, start, size, again = segments(data[at : at + PIECE + length - 1], length)
        parts.append((name, content, size, again, start + at))
    name, content, size, again, start = (np.concatenate(c) for c in zip(*parts, strict=True))
    if len(np.unique(content)) == len(content):
        return name, content, size, again, start, [None] * len(name)
    order = np.lexsort((start, size, content, name))
    name, content, size, again, start = (c[order] for c in (name, content, size, again, start))
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (content[1:] != content[:-1]) | (size[1:] != size[:-1])])
    first = np.flatnonzero(new)
    more = [None] * len(first)
    counts = np.diff(np.append(first, len(new)))
    for k in np.flatnonzero(counts > 1).tolist():
        more[k] = start[first[k] + 1 : first[k] + counts[k]].tolist()
    return name[first], content[first], size[first], again[first], start[first], more


# The index of a block


def suffix_order(data: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes up to their separator; separators compare by position.

    ``room`` is each position's distance to its separator. Prefix doubling over the positions that still tie.
    """
    n, key = len(data), np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.full(8, SEPARATOR, np.uint8)])
    for i in range(7):
        key <<= np.uint64(8)
        key |= np.where(room >= i, padded[i : i + n], np.uint8(SEPARATOR))
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1])])
    del key
    short = room[order] < 7
    fresh |= short
    fresh[1:] |= short[:-1]
    rank, h = np.empty(n, np.int32), 7
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), np.int32(0)))
    while True:
        slots = np.flatnonzero(~(fresh & np.append(fresh[1:], True))).astype(np.int32)
        if not len(slots):
            return order
        who = order[slots]
        pair = rank[who].astype(np.int64)
        pair *= n
        pair += rank[who + h]
        again = np.argsort(pair, kind="stable")
        who, pair = who[again], pair[again]
        del again
        differs = np.concatenate([[True], pair[1:] != pair[:-1]])
        del pair
        order[slots], fresh[slots] = who, differs
        rank[who] = slots[np.maximum.accumulate(np.where(differs, np.arange(len(slots), dtype=np.int32), np.int32(0)))]
        h *= 2


def common(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The number of equal bytes from each a and b on, ``most`` at most; eight at a time."""
    padded, out = np.concatenate([data, np.zeros(8, np.uint8)]), np.zeros(len(a), np.int32)
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # a view: eight bytes from each position
    for at in range(0, len(a), SLICE):
        one, other, limit = (c[at : at + SLICE].astype(np.int64) for c in (a, b, most))
        same, todo = np.zeros(len(one), np.int64), np.flatnonzero(limit > 0)
        while len(todo):
            x = words[one[todo] + same[todo]] ^ words[other[todo] + same[todo]]
            low = x & (~x + np.uint64(1))
            met = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            same[todo] += met
            todo = todo[(met == 8) & (same[todo] < limit[todo])]
        out[at : at + SLICE] = np.minimum(same, limit)
    return out


class RunIndex:
    """A run-length Burrows-Wheeler transform of separated segments, with sampled run ends.

    ``runs`` are (symbol, length). For each run head, ``head`` is its text position and ``match`` the length of the common prefix with
    the suffix before it in the order (the end of the run above). ``order`` lists the suffixes.
    """

    def __init__(self, parts: list[bytes]):
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        self.ends = np.cumsum(lens + 1) - 1
        self.starts = self.ends - lens
        data = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)
        self.size = len(data)
        room = np.repeat(self.ends.astype(np.int32), lens + 1) - np.arange(len(data), dtype=np.int32)
        order = suffix_order(data, room)
        before = data[order - 1]
        before[order == 0] = SEPARATOR
        new = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == SEPARATOR)])
        heads = np.flatnonzero(new)
        self.runs = before[heads], np.diff(np.append(heads, len(order)))
        self.order = order
        inner = heads[1:]
        self.head, above = order[inner], order[inner - 1]
        self.match = common(data, self.head, above, np.minimum(room[self.head], room[above]))

    def statistics(self) -> np.ndarray:
        """For each position the longest match with the suffix before it in the order, streamed from the samples."""
        out, at = np.zeros(self.size, np.int32), np.argsort(self.head)
        head, match = self.head[at], self.match[at]
        if len(head):  # each head's value holds until the next head
            ends = np.repeat(head + match, np.diff(np.append(head, self.size)))
            out[head[0] :] = np.maximum(0, ends - np.arange(head[0], self.size, dtype=np.int32))
        return out

    def spans(self, length: int, rank: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each segment the (start, end) of its bytes under strings of ``length`` bytes that start twice in the block.

        With ``rank``, the place of each segment's document: under strings that start in an earlier document. Suffixes that begin with one
        string are neighbours in the order, joined by matches of ``length`` or more.
        """
        places, owner, later = self.places(length, rank)
        return self.joined(places, owner, length) if rank is None else self.joined(places[later], owner[later], length)

    def both_spans(self, length: int, rank: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
        """``spans`` without and with ``rank``, from one reading of the statistics."""
        places, owner, later = self.places(length, rank)
        return self.joined(places, owner, length), self.joined(places[later], owner[later], length)

    def places(self, length: int, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The starts of strings of ``length`` bytes that start twice, their segments, and with ``rank`` whether an earlier document has the string."""
        joins = self.statistics()[self.order] >= length
        met = np.flatnonzero(joins | np.append(joins[1:], False))
        places, opens = self.order[met], np.flatnonzero(~joins[met])
        owner, later = np.searchsorted(self.ends, places), None
        if rank is not None:
            own = rank[owner]
            later = own > np.repeat(np.minimum.reduceat(own, opens), np.diff(np.append(opens, len(met)))) if len(met) else np.zeros(0, bool)
        return places, owner, later

    def joined(self, places: np.ndarray, owner: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
        """For each segment the (start, end) of its bytes under the strings at ``places``."""
        by_place = np.argsort(places)
        places, owner = places[by_place], owner[by_place]
        out: list[list[tuple[int, int]]] = [[] for _ in self.ends]
        if len(places):
            apart = np.concatenate([[True], (owner[1:] != owner[:-1]) | (places[1:] > places[:-1] + length)])
            first = np.flatnonzero(apart)
            last = np.append(first[1:], len(places)) - 1
            base = self.starts[owner[first]]
            for k, a, b in zip(owner[first].tolist(), (places[first] - base).tolist(), (places[last] + length - base).tolist(), strict=True):
                out[k].append((a, b))
        return out


# The steps over tables

LISTED = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("name", pa.int64()), ("content", pa.int64()), ("bytes", pa.int32()), ("again", pa.bool_()), ("start", pa.int32()), ("more", pa.list_(pa.int32()))])
MARKS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("bytes", pa.int32())])
MARK = "k1 long, k2 long, start int, bytes int"


def list_segments(rows: DataFrame, length: int) -> DataFrame:
    """The different segments of each of the (k1, k2, text) rows: name, content hash and places, without bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            k1, k2, parts = zip(*held, strict=True)
            sizes = [len(p[0]) for p in parts]
            name, content, bytes_, again, start = (np.concatenate(c) for c in list(zip(*parts, strict=True))[:5])
            keys = [pa.array(np.repeat(np.array(k, np.int64), sizes)) for k in (k1, k2)]
            more = pa.array([m for p in parts for m in p[5]], pa.list_(pa.int32()))
            return pa.record_batch([*keys, pa.array(name.view(np.int64)), pa.array(content.view(np.int64)), pa.array(bytes_.astype(np.int32)), pa.array(again), pa.array(start.astype(np.int32)), more], schema=LISTED)

        for batch in batches:
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                if len(data) >= length:
                    held.append((k1, k2, text_segments(data, length)))
                    size += len(held[-1][2][0])
                    if size >= 100_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(tidied(run), "k1 long, k2 long, name long, content long, bytes int, again boolean, start int, more array<int>")


def index_blocks(rows: DataFrame, length: int, first: bool, both: bool = False) -> DataFrame:
    """Marks of (name, k1, k2, start, more, seg) rows, which come with all segments of a name together and in order.

    With ``both``, marks of either kind, and a column ``later`` that tells those of ``first``.
    """
    schema = MARKS.append(pa.field("later", pa.bool_())) if both else MARKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, own, fresh, name = [], 0, [], 0, None  # the block's rows and bytes, and those of the name that is being read

        def marks(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                keys = [h[:2] for h in rows]
                places = {k: i for i, k in enumerate(sorted(set(keys)))}
                index = RunIndex([h[4] for h in rows])
                rank = np.array([places[k] for k in keys]) if first or both else None
                if both:  # where both kinds are the same spans, these are listed once
                    found = [(s, l, s != l) for s, l in zip(*index.both_spans(length, rank), strict=True)]
                    found = [[(a, b, True) for a, b in l] + [(a, b, False) for a, b in s if differ] for s, l, differ in found]
                else:
                    found = index.spans(length, rank)
                out = [(k1, k2, at + a, b - a, *kind) for (k1, k2, start, more, _), spans in zip(rows, found, strict=True) for a, b, *kind in spans for at in (start, *(more or ()))]
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                give_back()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "k1", "k2", "start", "more", "seg")), strict=True):
                if row[0] != name:
                    if size + fresh > BLOCK_BYTES:
                        yield from marks(held)
                        held, size = [], 0
                    held.extend(own)
                    size, own, fresh, name = size + fresh, [], 0, row[0]
                own.append(row[1:])
                fresh += len(row[5])
        if size + fresh > BLOCK_BYTES:
            yield from marks(held)
            held = []
        held.extend(own)
        yield from marks(held)

    return rows.mapInArrow(tidied(run), MARK + ", later boolean" * both)


def list_windows(rows: DataFrame, length: int) -> DataFrame:
    """Every window of (k1, k2, start, more, seg) rows with a 128-bit hash of its bytes and its place in the segment."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("more", pa.list_(pa.int32())), ("offset", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, start, more, seg in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "start", "more", "seg")), strict=True):
                h = window_hashes(np.frombuffer(seg, np.uint8), 8)
                n, both = len(seg) - length + 1, []
                for base in (POWER, 0xD6E8FEB86659FD93):
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(len(h), base))])
                    both.append(mixed((sums[length - 7 :][:n] - sums[:n]) * powers(n, pow(base, -1, 1 << 64))).view(np.int64))
                same = [pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(np.full(n, start, np.int32)), pa.array([more] * n, pa.list_(pa.int32()))]
                yield pa.record_batch([pa.array(both[0]), pa.array(both[1]), *same, pa.array(np.arange(n, dtype=np.int32))], schema=schema)

    return rows.mapInArrow(tidied(run), "a long, b long, k1 long, k2 long, start int, more array<int>, offset int")


def merged_marks(marks: DataFrame) -> DataFrame:
    """Marks as maximal spans of each (k1, k2), in order; a task reads its sorted rows as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[int, int, int, int] | None = None  # key, start, end of the span that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2, start, size = (batch.column(c).to_numpy().astype(np.int64) for c in ("k1", "k2", "start", "bytes"))
            end = start + size
            if open_ is not None:
                k1, k2, start, end = (np.concatenate([[o], c]) for o, c in zip(open_, (k1, k2, start, end), strict=True))
            group = np.concatenate([[0], np.cumsum((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))]).astype(np.int64) << 33
            reach = np.maximum.accumulate(group + end)
            first = np.flatnonzero(np.concatenate([[True], (group + start)[1:] > reach[:-1]]))
            upto = (reach - group)[np.append(first[1:], len(group)) - 1]
            open_ = (int(k1[first[-1]]), int(k2[first[-1]]), int(start[first[-1]]), int(upto[-1]))
            done = first[:-1]
            yield pa.record_batch([pa.array(k1[done]), pa.array(k2[done]), pa.array(start[done].astype(np.int32)), pa.array((upto[:-1] - start[done]).astype(np.int32))], schema=MARKS)
        if open_ is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((*open_[:3], open_[3] - open_[2]), MARKS.types, strict=True)], schema=MARKS)

    return marks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "start").mapInArrow(tidied(run), MARK)


def with_key(docs: DataFrame, id_col: str, text_col: str, extra: list[Column] | None = None) -> DataFrame:
    """(doc_id, text, k1, k2) and the columns ``extra``: null texts as empty, and a key that orders by id (null ids by a hash) and tells texts apart.

    Rows equal in id and text share it, and their marks.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *(extra or []))
    return rows.withColumn("k1", F.coalesce("doc_id", F.xxhash64(F.lit(1), "text"))).withColumn("k2", F.xxhash64("text", F.col("doc_id").isNull()))


def starts() -> Column:
    """All places of a segment in its document, one per row."""
    return F.explode(F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<int>"))))


def marked(keyed_docs: DataFrame, length: int = LENGTH, first: bool = False) -> DataFrame:
    """(k1, k2, start, bytes): the spans that repeat, merged. See the module's description for the steps."""
    marks, *spent = found_marks(keyed_docs, length, first)
    out = stored(merged_marks(marks), "marks")
    discard(*spent)
    return out


def marked_both(keyed_docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """``marked`` without and with ``first``, from one index."""
    marks, *spent = found_marks(keyed_docs, length, False, both=True)
    marks = stored(marks, "found")
    discard(*spent)
    out = stored(merged_marks(marks.drop("later")), "marks"), stored(merged_marks(marks.where("later").drop("later")), "later-marks")
    discard(marks)
    return out


def marked_within(keyed_docs: DataFrame, spans: DataFrame, length: int) -> DataFrame:
    """``marked`` for a greater length, from the ``spans`` that a smaller one has marked: each lies wholly in one of them, so only these are read."""
    by_doc = spans.where(F.col("bytes") >= length).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "bytes")).alias("spans"))
    cuts = F.expr("transform(spans, s -> struct(s.start AS at, substring(data, s.start + 1, s.bytes) AS text))")
    own = keyed_docs.select("k1", "k2", F.col("text").cast("binary").alias("data")).join(by_doc, ["k1", "k2"])
    cuts = own.select("k1", "k2", cuts.alias("cuts")).select("k1", "k2", F.explode("cuts").alias("s")).select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "s.*")
    cuts = stored(cuts, "spans")
    marks = marked(cuts.select(F.col("id").alias("k1"), F.lit(0).cast("long").alias("k2"), "text"), length)
    # Rows equal in id and text have the same spans with the same marks: these count once.
    places = marks.select(F.col("k1").alias("id"), "start", "bytes").join(cuts.select("id", "k1", "k2", "at"), "id")
    out = stored(places.select("k1", "k2", (F.col("at") + F.col("start")).alias("start"), "bytes").distinct(), "marks-within")
    discard(cuts, marks)
    return out


def found_marks(keyed_docs: DataFrame, length: int, first: bool, both: bool = False) -> tuple[DataFrame, ...]:
    """(k1, k2, start, bytes) before these are merged, and the tables they are read from. With ``both``, ``later`` tells the marks of ``first``."""
    listed = stored(list_segments(keyed_docs.select("k1", "k2", "text"), length), "segments")
    places = F.lit(1) + F.coalesce(F.array_size("more"), F.lit(0))
    names = listed.groupBy("name").agg(F.sum(places).alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("name")
    met = stored(listed.join(names, "name", "left_semi"), "met")
    discard(listed)
    listed = met
    key = ["name", "content", "bytes"]
    contents = listed.groupBy(*key).agg(
        F.sum(places).alias("copies"), F.min(F.struct("k1", "k2", "start", "more")).alias("first"), F.max(F.struct("k1", "k2")).alias("last"), F.max("again").alias("again")
    )
    contents = stored(contents, "contents")
    lead = F.struct("first.k1", "first.k2")
    if first:
        copied = contents.where(lead < F.col("last")).select(*key, lead.alias("kept"))
        repeated = listed.join(copied, key).where(F.struct("k1", "k2") > F.col("kept"))
        wanted = F.min("lead") < F.max("lead")
    else:
        repeated = listed.join(contents.where("copies > 1").select(*key), key, "left_semi")
        wanted = (F.count("*") > 1) | F.max("again")
    kind = ["later"] if both else []
    if both:
        copied = contents.where("copies > 1").select(*key, lead.alias("kept"))
        repeated = listed.join(copied, key).withColumn("later", F.struct("k1", "k2") > F.col("kept"))
    repeated = repeated.select("k1", "k2", starts().alias("start"), "bytes", *kind)

    per_name = contents.withColumn("lead", lead).groupBy("name").agg(F.sum("bytes").alias("total"), wanted.alias("wanted")).where("wanted").drop("wanted")
    asked = contents.join(per_name, "name").select("name", "first.*", "bytes", (F.col("total") > HOT_BYTES).alias("hot"))
    by_doc = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("name", "start", "more", "bytes", "hot")).alias("asked"))
    own = keyed_docs.select("k1", "k2", F.col("text").cast("binary").alias("data"))
    # Segments are cut out before they become rows, so no row carries the whole text beside one of them.
    cuts = F.expr("transform(asked, s -> struct(s.name, s.start, s.more, s.hot, substring(data, s.start + 1, s.bytes) AS seg))")
    parts = own.join(by_doc, ["k1", "k2"]).select("k1", "k2", cuts.alias("cuts")).select("k1", "k2", F.explode("cuts").alias("s")).select("k1", "k2", "s.*")
    parts = stored(parts, "segment-bytes")

    blocks = parts.where("NOT hot").select("name", "k1", "k2", "start", "more", "seg")
    blocks = index_blocks(blocks.repartition("name").sortWithinPartitions("name"), length, first, both)
    windows = list_windows(parts.where("hot").select("k1", "k2", "start", "more", "seg"), length)
    if first:
        twice = windows.groupBy("a", "b").agg(F.min(F.struct("k1", "k2")).alias("kept"), F.max(F.struct("k1", "k2")).alias("last")).where("kept < last").drop("last")
        single = windows.join(twice, ["a", "b"]).where(F.struct("k1", "k2") > F.col("kept"))
    elif both:
        twice = windows.groupBy("a", "b").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2")).alias("kept")).where("copies > 1").drop("copies")
        single = windows.join(twice, ["a", "b"]).withColumn("later", F.struct("k1", "k2") > F.col("kept"))
    else:
        twice = windows.groupBy("a", "b").agg(F.count("*").alias("copies")).where("copies > 1").select("a", "b")
        single = windows.join(twice, ["a", "b"], "left_semi")
    single = single.select("k1", "k2", starts().alias("at"), "offset", *kind).select("k1", "k2", (F.col("at") + F.col("offset")).alias("start"), F.lit(length).alias("bytes"), *kind)
    return repeated.unionByName(blocks).unionByName(single), listed, contents, parts


def whole_words(data: bytes, a: int, b: int) -> int:
    """The words between white space that lie in data[a:b] as a whole."""
    n = len(data[a:b].split())
    cut_ahead = a > 0 and not data[a - 1 : a].isspace() and not data[a : a + 1].isspace()
    cut_behind = b < len(data) and not data[b : b + 1].isspace() and not data[b - 1 : b].isspace()
    return max(0, n - cut_ahead - cut_behind)


def less(data: bytes, begins: pa.Scalar, sizes: pa.Scalar, words: int) -> tuple[int, bytes]:
    """The number of marked runs of ``words`` whole words or more, and what stays without them."""
    spans = [(a, a + n) for a, n in zip(begins.as_py(), sizes.as_py(), strict=True)] if begins.is_valid else []
    spans = [(a, b) for a, b in spans if not words or whole_words(data, a, b) >= words]
    edges = [0, *[x for span in spans for x in span], len(data)]
    return len(spans), b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def cut(docs: DataFrame, id_col: str, text_col: str, keep: list[str], as_text: bool = False, length: int = LENGTH, first: bool = False, words: int = 0) -> DataFrame:
    """Each row of ``docs`` as doc_id, n_bytes, n_removed, n_spans, kept, and the columns ``keep`` as kept_0, kept_1 and so on.

    ``kept`` is binary, or with ``as_text`` a string without the parts of characters that a cut went through. Marked runs of fewer than
    ``words`` whole words stay.
    """
    extra = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]
    marks = marked(with_key(docs, id_col, text_col), length, first)
    by_doc = marks.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "bytes"))).alias("marks"))
    rows = with_key(docs, id_col, text_col, extra)
    names = [f"kept_{i}" for i in range(len(keep))]
    joined = rows.join(by_doc, ["k1", "k2"], "left").select("doc_id", "text", F.col("marks.start").alias("starts"), F.col("marks.bytes").alias("sizes"), *names)
    kinds = dict(joined.dtypes)
    added = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string() if as_text else pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = at = size = 0
            out = []
            for text, begins, sizes in zip(batch.column("text"), batch.column("starts"), batch.column("sizes"), strict=True):
                data = text.as_buffer().to_pybytes()
                spans, left = less(data, begins, sizes, words)
                out.append((len(data), len(data) - len(left), spans, left.decode("utf-8", "ignore") if as_text else left))
                size, at = size + len(left), at + 1
                if size >= BATCH_BYTES or at == batch.num_rows:
                    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), added, strict=True)]
                    same = [batch.column(c).slice(done, at - done) for c in ("doc_id", *names)]
                    yield pa.record_batch([*same, *columns], names=["doc_id", *names, *[n for n, _ in added]])
                    done, size, out = at, 0, []

    ddl = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *names))
    return joined.mapInArrow(tidied(run), f"{ddl}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans and kept (binary: the bytes that stay, joined).

    Bytes are those of UTF-8; a null text is empty. Matches never cross documents; strings are judged on the input. A
    repeated row is another occurrence of its text. Cuts may fall within a character, so ``kept`` is binary. Empty tables
    give no rows; texts below ``length`` bytes stay whole. Other columns are not read, so their names can't clash.
    """
    return cut(docs, id_col, text_col, [], length=length)


def removed_beside_cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, short: int = 240, words: int = 50) -> DataFrame:
    """The columns of ``removed``, then those of another rule that passages too short for ``length`` meet: n_shared, n_passages and text.

    ``text`` is the row's text as ``cleaned`` leaves it with strings of ``short`` bytes, ``length`` at most, and ``words``: of a passage that
    documents share the copy under the least id stays. n_shared and n_passages are the bytes and runs that go from it. Null texts are empty, and
    rows equal in id and text count as in ``removed`` and in ``cleaned``. The table is indexed for ``short``; for ``length`` only what is marked there.
    """
    every, later = marked_both(with_key(docs, id_col, text_col), short)
    long = marked_within(with_key(docs, id_col, text_col), every, length)
    discard(every)
    kinds = long.withColumn("long", F.lit(True)).unionByName(later.withColumn("long", F.lit(False)))
    lists = [F.sort_array(F.collect_list(F.when(c, F.struct("start", "bytes")))).alias(n) for n, c in (("marks", F.col("long")), ("later", ~F.col("long")))]
    by_doc = kinds.groupBy("k1", "k2").agg(*lists)
    places = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("marks", "later") for c in ("start", "bytes")]
    joined = with_key(docs, id_col, text_col).join(by_doc, ["k1", "k2"], "left").select("doc_id", "text", *places)
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("n_shared", pa.int64()), ("n_passages", pa.int64()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = at = size = 0
            out = []
            for text, *spans in zip(*(batch.column(c) for c in ("text", "marks_start", "marks_bytes", "later_start", "later_bytes")), strict=True):
                data = text.as_buffer().to_pybytes()
                (runs, left), (passages, rest) = less(data, *spans[:2], 0), less(data, *spans[2:], words)
                out.append((len(data), len(data) - len(left), runs, left, len(data) - len(rest), passages, rest.decode("utf-8", "ignore")))
                size, at = size + len(left) + len(rest), at + 1
                if size >= BATCH_BYTES or at == batch.num_rows:
                    columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), fields, strict=True)]
                    yield pa.record_batch([batch.column("doc_id").slice(done, at - done), *columns], names=["doc_id", *[n for n, _ in fields]])
                    done, size, out = at, 0, []

    return joined.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_shared long, n_passages long, text string")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", length: int = LENGTH, words: int = 0) -> DataFrame:
    """All rows of ``docs`` with their texts less what an earlier document holds, and the new length in ``chars_col``.

    A run of bytes goes if strings of ``length`` bytes that cover it all start in a document of a smaller id too, and it has ``words`` whole words
    at least. So of a passage that documents share, the copy under the least id stays, and what repeats within one document only stays
    too. Rows that repeat id and text count as one document. Characters that a cut went through go whole. Null texts become empty.
    Extra columns are carried along under any name.
    """
    keep = [c for c in docs.columns if c not in (id_col, text_col, chars_col)]
    rows = cut(docs, id_col, text_col, keep, as_text=True, length=length, first=True, words=words)
    values = {id_col: F.col("doc_id"), text_col: F.col("kept")} | {c: F.col(f"kept_{i}") for i, c in enumerate(keep)}
    if chars_col in docs.columns:
        values[chars_col] = F.length("kept").cast(docs.schema[chars_col].dataType)
    return rows.select(*[values[c].alias(c) for c in docs.columns])

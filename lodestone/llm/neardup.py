"""Near-duplicate groups by ProbMinHash: weighted five-word shingles, banding, exact verification.

A shingle with weight w (how often it occurs in the text) sends points of a Poisson process of rate w to random registers;
each register keeps its earliest point. Shingles stop once their next point comes later than every register's, so most
send two or three. Two texts agree in a register with the probability Jaccard similarity J_P, which for equal weights is the
Jaccard similarity. ``BANDS`` bands of ``ROWS`` registers name candidate buckets: at J_P = 0.8 a pair shares no bucket
with a chance of 2e-5. Candidates are verified by their exact J_P over all shingles.

Texts with equal words are one node, so copies cost no pairs. In a bucket not all pairs are formed: every member meets the
bucket's most connected member (the likely source of a family of variants); verified links are merged into
components; then only members of one bucket that are still in different components meet, in blocks of bounded size. A pair
is verified only if a byte of each register agrees in at least ``SKETCH`` of them, which a pair at the threshold fails with a
chance of 1e-4. So a family of variants costs about one verified pair per member, and no link between components is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, keyed, mixed, stored, tidied

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 36, 6
REGISTERS = BANDS * ROWS
BATCH_WORDS = 400_000
STAR_ROUNDS = 2
SKETCH = 0.70
BLOCK = 1024
EMPTY_WORD = np.int64(np.uint64(xxhash.xxh64(b"", seed=42).intdigest()).view(np.int64))  # how Spark hashes the empty string


def word_hashes(text):
    """The hashes of a text's words: lower case, split at white space; empty ends are told by ``EMPTY_WORD``."""
    return F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.xxhash64(w))


def shingles(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of texts given as word hashes, sorted by row and shingle.

    A text of one to four words is one shingle; one without words has none.
    """
    ends = np.cumsum(sizes)
    row, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(words)) - np.repeat(ends - sizes, sizes)
    h = np.zeros(len(words), np.uint64)
    for k in range(WORDS):  # words beyond the end count as zero
        follows = np.zeros(len(words), np.uint64)
        follows[: len(words) - k] = words[k:]
        inside = place + k < np.repeat(sizes, sizes)
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, follows, np.uint64(0)) + np.uint64(k + 1))
    keep = place <= np.repeat(np.maximum(sizes - WORDS, 0), sizes)
    row, h = row[keep], h[keep]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return row[first], h[first], np.diff(np.append(first, len(h))).astype(np.float64)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """The element that each register of each row keeps, [rows, registers]; zeros for rows without elements."""
    first, kept = np.full(rows * registers, np.inf), np.zeros(rows * registers, np.uint64)
    arrival, stream = np.zeros(len(row)), element
    while len(row):
        stream = mixed(stream + np.uint64(0x9E3779B97F4A7C15))
        arrival = arrival - np.log(((stream >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        place = row * registers + (mixed(stream ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(arrival < first[place])
        np.minimum.at(first, place[early], arrival[early])
        won = early[first[place[early]] == arrival[early]]
        kept[place[won]] = element[won]
        on = np.flatnonzero(arrival < first.reshape(rows, registers).max(1)[row])
        row, element, weight, arrival, stream = row[on], element[on], weight[on], arrival[on], stream[on]
    return kept.reshape(rows, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket name for each band, [rows, BANDS]."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two (sorted shingles, weights): sum over i of 1 / sum over j of max(a_j/a_i, b_j/b_i)."""
    union = np.union1d(a[0], b[0])
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])], y[np.searchsorted(union, b[0])] = a[1], b[1]
    both = (x > 0) & (y > 0)
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    sx, sy = x[order], y[order]
    above = np.append(np.cumsum(sx[::-1])[::-1], 0.0)  # those from a place on have a_j/b_j at least as large
    below = np.concatenate([[0.0], np.cumsum(sy)])
    at = np.searchsorted(ratio[order], ratio[both])
    return float((1.0 / (above[at] / x[both] + below[at] / y[both])).sum())


def word_batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, word hashes, words per row) of pieces of a batch, without empty words."""
    column = batch.column("words")
    sizes = np.array([x or 0 for x in column.value_lengths().to_pylist()], np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_WORDS, side="right")))
        part, owner = flat[ends[at] - sizes[at] : ends[to - 1]], np.repeat(np.arange(to - at), sizes[at:to])
        real = part != EMPTY_WORD
        yield at, to, part[real].view(np.uint64), np.bincount(owner[real], minlength=to - at)
        at = to


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n_words, bands, sketch, tags) of each row.

    (k1, k2) is a 128-bit key of the words in order, sketch a byte per register, tags the low four bytes per band.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n_words", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary()), ("tags", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words, sizes in word_batches(batch):
                place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                owner = np.repeat(np.arange(to - at), sizes)
                keys = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    sums = np.zeros(to - at, np.uint64)
                    np.add.at(sums, owner, mixed(words ^ mixed((place + 1).astype(np.uint64) * np.uint64(salt))))
                    keys.append(mixed(sums + sizes.astype(np.uint64)).view(np.int64))
                signature = signatures(*shingles(words, sizes), to - at)
                bands = band_keys(signature).view(np.int64)
                sketch = pa.array([x.tobytes() for x in (mixed(signature) & np.uint64(255)).astype(np.uint8)], pa.binary())
                tags = pa.array([x.tobytes() for x in bands.astype(np.uint32)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                yield pa.record_batch([batch.column("doc_id").slice(at, to - at), pa.array(keys[0]), pa.array(keys[1]), pa.array(sizes), lists, sketch, tags], schema=schema)

    rows = keyed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), word_hashes(F.col("text")).alias("words"))
    return rows.mapInArrow(tidied(run), "doc_id long, k1 long, k2 long, n_words long, bands array<long>, sketch binary, tags binary")


def shingle_table(docs: DataFrame) -> DataFrame:
    """(node, shingles, weights) of (node, text) rows."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64())), ("weights", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, words, sizes in word_batches(batch):
                row, element, weight = shingles(words, sizes)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=to - at))]).astype(np.int32))
                yield pa.record_batch([batch.column("node").slice(at, to - at), pa.ListArray.from_arrays(offsets, pa.array(element.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(weight.astype(np.int32)))], schema=schema)

    return docs.select("node", word_hashes(F.col("text")).alias("words")).mapInArrow(tidied(run), "node long, shingles array<long>, weights array<int>")


def verified(pairs: DataFrame, table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Those of the (a, b) pairs whose exact similarity is at least ``threshold``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("sa", "wa", "sb", "wb")]
            good = []
            for i in range(batch.num_rows):
                sa, wa, sb, wb = (c[i].values.to_numpy() for c in columns)
                if similarity((sa.view(np.uint64), wa.astype(float)), (sb.view(np.uint64), wb.astype(float))) >= threshold - 1e-12:
                    good.append(i)
            if good:
                yield pa.record_batch([batch.column("a").take(pa.array(good)), batch.column("b").take(pa.array(good))], schema=schema)

    left = table.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    right = table.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "wa", "sb", "wb").mapInArrow(tidied(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of its component for each node of (a, b) edges, by alternating star contraction.

    Each step is a pre-aggregated minimum per node and a join, stored in the shared folder; no links go to the driver.
    """
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        heads = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(heads, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(heads.select("u", F.col("m").alias("v")))
        before, links = links, stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        discard(before)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bytes of sketches, row by row."""
    return (a == b).mean(axis=1)


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), REGISTERS)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def star_pairs(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Distinct (a, b) of (key, node, root, sketch) members and their bucket's centre (key, other, other_root, other_sketch) that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = agree(sketches(batch.column("sketch")), sketches(batch.column("other_sketch"))) >= SKETCH
                x, y = (batch.column(c).to_numpy()[good] for c in ("node", "other"))
                yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], schema=PAIR)

    met = members.join(centres, "key").where("root <> other_root").select("node", "other", "sketch", "other_sketch")
    return met.mapInArrow(tidied(run), "a long, b long").distinct()


def block_pairs(members: DataFrame) -> DataFrame:
    """Distinct (a, b) of different roots in one bucket that may be links, for (key, node, root, sketch, tags) members.

    A pair that shares several buckets comes from the first of its shared bands only. A bucket of more than ``BLOCK`` members is dealt to blocks by a hash, and a group compares two blocks, so groups are bounded.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / BLOCK)
    dealt = members.join(sizes, "key").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
    groups = dealt.withColumn("to", F.explode(F.expr("sequence(0L, parts - 1)")))
    groups = groups.select("key", F.least("own", "to").alias("p"), F.greatest("own", "to").alias("q"), "node", "root", "sketch", "tags", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            node, root, own = (np.array(c) for c in list(zip(*held, strict=True))[:3])
            lines = np.frombuffer(b"".join(h[3] for h in held), np.uint8).reshape(len(held), REGISTERS)
            tags = np.frombuffer(b"".join(h[4] for h in held), np.uint32).reshape(len(held), BANDS)
            band = int((tags[0] == np.uint32(name[0] & 0xFFFFFFFF)).argmax())
            apart = name[1] != name[2]
            out = []
            for i in range(len(held)):
                there = np.flatnonzero((root[i + 1 :] != root[i]) & ((own[i + 1 :] != own[i]) if apart else True)) + i + 1
                there = there[agree(lines[there], lines[i]) >= SKETCH] if len(there) else there
                there = there[(tags[there] == tags[i]).argmax(axis=1) == band] if len(there) else there
                if len(there):
                    out.append(np.stack([np.minimum(node[there], node[i]), np.maximum(node[there], node[i])]))
            if out:
                a, b = np.concatenate(out, axis=1)
                yield pa.record_batch([pa.array(a), pa.array(b)], schema=PAIR)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q", "node", "root", "own", "sketch", "tags")), strict=True):
                if row[:3] != name:
                    if len(held) > 1:
                        yield from pairs()
                    name, held = row[:3], []
                held.append(row[3:])
        if len(held) > 1:
            yield from pairs()

    rows = groups.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return rows.mapInArrow(tidied(run), "a long, b long").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (the least doc_id of its near-duplicate class), n_words.

    Classes are the components of links J_P >= 0.8 over five-word shingles weighted by their counts; words are lower case and split at
    white space. Texts of one to four words are one shingle. A null text, or one without words, is a class of its own, as is a row
    without an id (class null). Rows that repeat an id are one document. Empty tables give no rows.
    """
    signed = stored(sign(docs, id_col, text_col), "signed")
    real = signed.where("n_words > 0 AND doc_id IS NOT NULL")
    nodes = stored(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("tags").alias("tags")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    found = stored(banded.join(shared, "key"), "buckets")
    reach = found.groupBy("node").agg(F.sum(F.col("n") - 1).alias("reach"))
    live = stored(found.join(reach.join(nodes.select("node", "sketch", "tags").hint("merge"), "node"), "node").select("key", "node", "reach", "sketch", "tags"), "live")

    # A shuffled join at every size: the ids of texts that share a bucket grow with the table.
    needed = reach.select("node")
    texts = keyed(docs, node=id_col, text=text_col).select(F.col("node").cast("long"), "text").where("text IS NOT NULL")
    table = stored(shingle_table(texts.join(needed.hint("shuffle_hash"), "node", "left_semi")), "shingles")

    links = roots = tested = None
    spent = [found, live, table]  # tables that nothing reads once the components are known
    for turn in range(STAR_ROUNDS + 1):
        if roots is None:
            open_ = live.withColumn("root", F.col("node"))
        else:
            open_ = live.join(roots, "node", "left").select("key", "node", "reach", "sketch", "tags", F.coalesce("root", "node").alias("root"))
            split = open_.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
            open_ = stored(open_.join(split, "key", "left_semi"), "open")
            spent.append(open_)
        if turn < STAR_ROUNDS:
            centre = F.max(F.struct("reach", -F.col("node"), "root", "sketch")).alias("c")
            centres = (open_ if turn == 0 else outside_top(open_)).groupBy("key").agg(centre)
            met = star_pairs(open_, centres.select("key", (-F.col("c.col2")).alias("other"), F.col("c.root").alias("other_root"), F.col("c.sketch").alias("other_sketch")))
        else:
            met = block_pairs(open_.select("key", "node", "root", "sketch", "tags"))
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        met = stored(met, "pairs")
        good = stored(verified(met, table), "verified")
        spent += [met, good]
        tested = met if tested is None else tested.unionByName(met)
        links = good if links is None else links.unionByName(good)
        if turn == STAR_ROUNDS and good.isEmpty():
            break
        roots = components(links)
    discard(*spent)

    member = nodes.select("k1", "k2", "node").join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("class_id"))
    out = signed.select("doc_id", "k1", "k2", "n_words").join(member, ["k1", "k2"], "left")
    real_row = (F.col("n_words") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(real_row, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_words")


def outside_top(open_: DataFrame) -> DataFrame:
    """Members of each bucket outside the component of its most connected member."""
    top = open_.groupBy("key").agg(F.max(F.struct("reach", -F.col("node"), "root")).alias("t")).select("key", F.col("t.root").alias("top_root"))
    return open_.join(top, "key").where("root <> top_root").drop("top_root")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their class's least: one document of each group stays, with all its columns."""
    kept = classes(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[f"`{id_col}`"].eqNullSafe(kept["_kept_id"]), "left_semi").dropDuplicates([id_col, text_col])

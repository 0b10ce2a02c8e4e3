"""Byte-level BPE over length-bucketed padded numpy matrices.

The distinct pieces of a batch are put into buckets of similar length, a row of token ids each. Every round finds each
row's leftmost pair of minimum rank, merges it, moves the rest of the row up by one place and looks up the two pairs
that are new; rows without a pair left leave the matrix. Pairs are looked up in an open-addressing hash table. Pieces longer
than ``LONG`` bytes would make quadratic work of this; they take the same merges in the same order from a heap.

The vocabulary is a rank file whose path is a parameter; a worker loads it once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import keyed, tidied

NONE = np.int32(2**31 - 1)
LONG = 1024
BUCKETS = (4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, LONG)
MATRIX_CELLS = 1 << 20
PIECES_AT_ONCE = 120_000
CACHED_PIECES = 300_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> rank of the merged token, by linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys, self.ranks, self.probes = np.full(1 << self.bits, 2**64 - 1, np.uint64), np.full(1 << self.bits, NONE, np.int32), 0
        waiting, at = np.arange(len(keys)), self.home(keys)
        while len(waiting):
            free = self.keys[at] == np.uint64(2**64 - 1)
            taken, first = np.unique(at[free], return_index=True)  # one key for each free place, the others probe on
            who = np.flatnonzero(free)[first]
            self.keys[taken], self.ranks[taken] = keys[waiting[who]], rank[waiting[who]]
            rest = np.ones(len(waiting), bool)
            rest[who] = False
            waiting, at = waiting[rest], (at[rest] + 1) & self.mask
            self.probes += 1

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where either id is negative or the pair merges to nothing."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys, at = keys[todo], self.home(keys[todo])
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            if not on.any():
                break
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & self.mask
        return out


class Tokenizer:
    """Ranks, pair table, and a bounded cache of the pieces seen by this worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*(np.array(c, np.int64) for c in zip(*pairs, strict=True))) if pairs else PairTable(*[np.zeros(0, np.int64)] * 3)
        top = max(self.tokens, default=-1) + 1
        lens = np.array([len(self.tokens.get(i, b"")) for i in range(top)], np.int64)
        self.token_start, self.token_len = np.cumsum(lens) - lens, lens
        self.token_bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(top)), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.length, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    # Merging

    def merge_matrix(self, ids: np.ndarray) -> np.ndarray:
        """Merge rows of byte ids, padded with -1 on the right, to the end; the result is padded alike."""
        out = np.full(ids.shape, -1, np.int32)
        rows = np.arange(len(ids))
        ranks = self.pairs.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            done = least == NONE
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                on = ~done
                rows, ids, ranks, at, least = rows[on], ids[on], ranks[on], at[on], least[on]
                if not len(rows):
                    break
            line, column = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            moved = column[None, :] > at[:, None]
            ids = np.where(moved, ids[:, 1:], ids[:, :-1])
            ids[line, at] = least
            ranks = np.where(moved[:, :-1], ranks[:, 1:], ranks[:, :-1])
            if ranks.shape[1]:
                inner = at < ranks.shape[1]
                ranks[line[inner], at[inner]] = self.pairs.lookup(ids[line[inner], at[inner]], ids[line[inner], at[inner] + 1])
                inner = at > 0
                ranks[line[inner], at[inner] - 1] = self.pairs.lookup(ids[line[inner], at[inner] - 1], ids[line[inner], at[inner]])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges, leftmost pair of minimum rank first, from a heap over a linked list."""
        ids: list = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, tokens, get = len(ids), self.tokens, self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get(tokens[ids[i]] + tokens[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(tokens[ids[i]] + tokens[ids[j]]) != r:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (x := get(tokens[r] + tokens[ids[after[i]]])) is not None:
                    heapq.heappush(heap, (x, i))
            if before[i] >= 0 and (x := get(tokens[ids[before[i]]] + tokens[r])) is not None:
                heapq.heappush(heap, (x, before[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, start and number of each piece's ids among them); a piece that is a token stays whole."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        start, count, used = np.zeros(len(pieces), np.int64), np.ones(len(pieces), np.int64), int((whole >= 0).sum())
        flat = [whole[whole >= 0].astype(np.int32)]
        start[whole >= 0] = np.arange(used)
        for i in np.flatnonzero((whole < 0) & (lens > LONG)):
            flat.append(self.merge_long(pieces[i]))
            start[i], count[i] = used, len(flat[-1])
            used += len(flat[-1])
        low = 0
        for width in BUCKETS:
            which = np.flatnonzero((whole < 0) & (lens > low) & (lens <= width) & (lens <= LONG))
            low = width
            for at in range(0, len(which), step := max(1, MATRIX_CELLS // width)):
                part = which[at : at + step]
                wide = int(lens[part].max())
                ids = np.full((len(part), wide), -1, np.int32)
                ids[np.arange(wide)[None, :] < lens[part][:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
                merged = self.merge_matrix(ids)
                real = merged >= 0
                flat.append(merged[real])
                count[part] = real.sum(1)
                start[part] = used + np.cumsum(count[part]) - count[part]
                used += len(flat[-1])
        return np.concatenate(flat), start, count

    # Pieces of texts

    def places(self, pieces: list[str]) -> np.ndarray:
        """Positions of (distinct) pieces in the cache, encoding those that it doesn't hold."""
        if len(self.known) + len(pieces) > CACHED_PIECES + PIECES_AT_ONCE:
            self.forget()
        new = [p for p in pieces if p not in self.known]
        if new:
            flat, start, count = self.merge([p.encode("utf-8", "surrogatepass") for p in new])
            base, n, total = len(self.known), len(self.known) + len(new), self.used + len(flat)
            if total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(total, 2 * len(self.flat)) - len(self.flat), np.int32)])
            if n > len(self.start):
                more = np.zeros(max(n, 2 * len(self.start)) - len(self.start), np.int64)
                self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
            self.flat[self.used : total] = flat
            self.start[base:n], self.length[base:n] = self.used + start, count
            self.used = total
            self.known.update(zip(new, range(base, n), strict=True))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each piece)."""
        named = pa.array(pieces, pa.string()).dictionary_encode()
        at = self.places(named.dictionary.to_pylist())[named.indices.to_numpy()]
        lens = self.length[at]
        return gather(self.flat, self.start[at], lens), lens

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Texts share rounds of up to ``PIECES_AT_ONCE`` pieces; a longer one takes several."""
        held, counts, parts = [], [], []

        def flush() -> Iterator[np.ndarray]:
            ids, lens = self.encode_pieces(held) if held else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            ends, piece_ends = np.concatenate([[0], np.cumsum(lens)]), np.cumsum([0, *counts])
            for a, b in zip(piece_ends[:-1], piece_ends[1:], strict=True):
                yield ids[ends[a] : ends[b]]
            held.clear()
            counts.clear()

        for text in texts:
            found = (m.group() for m in self.pattern.finditer(text)) if len(text) > PIECES_AT_ONCE else iter(self.pattern.findall(text))
            while len(part := list(islice(found, PIECES_AT_ONCE))) == PIECES_AT_ONCE:
                parts.append(self.encode_pieces(part)[0])
            if parts:
                if held:
                    yield from flush()
                yield np.concatenate([*parts, self.encode_pieces(part)[0]]) if part else np.concatenate(parts)
                parts.clear()
                continue
            held += part
            counts.append(len(part))
            if len(held) >= PIECES_AT_ONCE:
                yield from flush()
        yield from flush()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        return gather(self.token_bytes, self.token_start[ids], self.token_len[ids])


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + len], joined."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + lens, lens) + np.arange(total)]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    return Tokenizer(path, pattern)


def batches_of(rows: Iterator[tuple], size_of, limit: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def id_batches(own: Tokenizer, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids of their texts, number of ids of each text) for parts of a batch of (doc_id, text)."""
    texts, at = (x.as_py() or "" for x in batch.column("text")), 0
    for part in batches_of(own.encode(texts), len, 1 << 20):
        yield batch.column("doc_id").slice(at, len(part)), np.concatenate(part), np.fromiter(map(len, part), np.int64, len(part))
        at += len(part)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def decoded_bytes(own: Tokenizer, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes that each run of ``sizes`` ids stands for."""
    ends = np.concatenate([[0], np.cumsum(own.token_len[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(own.decode(ids).tobytes())])


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of each row: the ids of its text without special tokens, in order; null and empty texts have none.

    One narrow pass over the rows: no shuffle, nothing is cut. Rows repeat as they do in the input; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            for doc_id, ids, sizes in id_batches(own, batch):
                yield pa.record_batch([doc_id, lists(ids, sizes)], names=["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, ids): the bytes that the ids stand for. Null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            column = batch.column("ids")
            for at in range(0, len(column), 512):
                part = column.slice(at, 512)
                sizes = np.array([x or 0 for x in part.value_lengths().to_pylist()], np.int64)
                out = decoded_bytes(own, part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
                yield pa.record_batch([batch.column("doc_id").slice(at, 512), part, out], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(tidied(run), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ``encode`` and ``decode`` of the ids in one pass, so that a task needs one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            for doc_id, ids, sizes in id_batches(own, batch):
                yield pa.record_batch([doc_id, lists(ids, sizes), decoded_bytes(own, ids.astype(np.int64), sizes)], names=["doc_id", "ids", "decoded"])

    return texts_of(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256, and if asked the ids, of rows of ``decode``."""
    own = F.coalesce("ids", F.array().cast("array<int>"))
    return decoded.select(
        "doc_id",
        *([own.alias("ids")] if ids else []),
        F.size(own).cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(own.cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

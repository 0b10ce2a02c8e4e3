import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA

from lodestone.llm import queries, repeats


def brute(texts, length):
    """Covered bytes of each text, by a dictionary of all its strings."""
    seen = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            seen.setdefault(t[j : j + length], []).append((i, j))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                cover[i][j : j + length] = b"\1" * length
    return cover


def earlier(docs, length):
    """Covered bytes of each (order, text): strings that start in a document of a smaller order too."""
    least = {}
    for order, t in docs:
        for j in range(len(t) - length + 1):
            s = t[j : j + length]
            least[s] = min(least.get(s, order), order)
    out = []
    for order, t in docs:
        c = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if least[t[j : j + length]] < order:
                c[j : j + length] = b"\1" * length
        out.append(c)
    return out


def runs(cover):
    edges = [0, *[i for i in range(1, len(cover)) if cover[i] != cover[i - 1]], len(cover)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b and cover[a]]


def whole(data, a, b):
    """Words of data[a:b] that neither end cuts."""
    at = [(m.start(), m.end()) for m in re.finditer(rb"\S+", data)]
    return sum(a <= x and y <= b for x, y in at)


def expected(texts, length):
    out = []
    for t, c in zip(texts, brute(texts, length), strict=True):
        kept = bytes(b for b, m in zip(t, c, strict=True) if not m)
        spans = sum(m and (k == 0 or not c[k - 1]) for k, m in enumerate(c))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in repeats.removed(df).collect()), key=repr)


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd"])
def test_index_against_brute_force(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(120):
        base = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(4)]
        parts = [b"".join(rng.choice(base)[rng.randint(0, 5) :] for _ in range(rng.randint(1, 3))) or b"a" for _ in range(rng.randint(1, 8))]
        length = rng.choice([3, 5, 10, 20])
        got = repeats.RunIndex(parts).spans(length)
        for spans, cover in zip(got, brute(parts, length), strict=True):
            mine = bytearray(len(cover))
            for a, b in spans:
                mine[a:b] = b"\1" * (b - a)
            assert mine == cover


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd"])
def test_index_keeps_the_first_document(alphabet):
    rng = random.Random(len(alphabet) + 9)
    for _ in range(120):
        base = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(4)]
        parts = [b"".join(rng.choice(base)[rng.randint(0, 5) :] for _ in range(rng.randint(1, 3))) or b"a" for _ in range(rng.randint(1, 8))]
        rank = [rng.randint(0, 3) for _ in parts]
        length = rng.choice([3, 5, 10, 20])
        got = repeats.RunIndex(parts).spans(length, np.array(rank))
        for spans, cover in zip(got, earlier(list(zip(rank, parts, strict=True)), length), strict=True):
            mine = bytearray(len(cover))
            for a, b in spans:
                mine[a:b] = b"\1" * (b - a)
            assert mine == cover


def test_index_takes_few_bytes_a_position():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(100)).encode() for _ in range(40)]
    parts = [rng.choice(base) + word().encode() for _ in range(1000)]
    tracemalloc.start()
    repeats.RunIndex(parts).spans(240, np.arange(len(parts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * sum(map(len, parts))


def test_blocks_close_before_a_name_lifts_them_over_the_limit(monkeypatch):
    sizes = []

    class Index(repeats.RunIndex):
        def __init__(self, parts):
            sizes.append(sum(map(len, parts)))
            super().__init__(parts)

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(repeats, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(repeats, "RunIndex", Index)
    names = [1] * 9 + [2] * 15 + [3] * 4 + [4] * 4
    columns = [names, range(len(names)), [0] * len(names), [0] * len(names), [None] * len(names), [b"q" * 100] * len(names)]
    batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()], strict=True)], names=["name", "k1", "k2", "start", "more", "seg"])
    out = list(repeats.index_blocks(Rows(), 50, False)(iter([batch.slice(0, 5), batch.slice(5)])))
    assert sizes == [900, 1500, 800] and sum(b.num_rows for b in out) == len(names)


def test_statistics_run_lengths_and_order():
    parts = [b"banana", b"ananas", b"bandana"]
    index = repeats.RunIndex(parts)
    text = b"".join(p + b"\xff" for p in parts)
    assert index.runs[1].sum() == len(text) and len(index.runs[0]) < len(text)
    ends = [i for i, b in enumerate(text) if b == 255]
    tail = lambda i: (text[i : min(e for e in ends if e >= i)], i)
    order = sorted(range(len(text)), key=lambda i: (text[i : min(e for e in ends if e >= i)] + b"\xff", i))
    stats = index.statistics()
    assert index.order.tolist() == order
    for a, b in zip(order, order[1:], strict=False):
        x, y = tail(a)[0], tail(b)[0]
        lcp = next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert stats[b] == lcp


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, edge, long = prose(90), "".join(rng.choice("xy") for _ in range(399)), prose(1500)
    texts = [prose(rng.randint(0, 300)) for _ in range(15)]
    texts += [prose(rng.randint(1, 40)) + passage + prose(rng.randint(1, 40)) for _ in range(25)]
    texts += [edge + prose(3), edge + prose(2), edge + "z" + prose(5), edge + "z" + prose(6)]
    texts += [long, long, long[:4000] + "!" + long[4000:], long[500:] + prose(30)]
    texts += ["a" * 5000, "ab" * 900, "abc" * 133, "q" * 400, "q" * 399, "r" * 401]
    texts += [(t := prose(100)) + prose(3) + t]
    return texts


@pytest.mark.parametrize("limits", [{}, {"BLOCK_BYTES": 2000}, {"HOT_BYTES": 1500}, {"LONGEST_SEGMENT": 50, "PIECE": 1000}])
def test_tables_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(repeats, name, value)
    rows = list(enumerate(corpus(7))) + [(900, None), (901, ""), (None, corpus(7)[2]), (3, corpus(7)[3]), (3, corpus(7)[3])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, name string").repartition(5)
    want = [(i, *e) for (i, _), e in zip(rows, expected([(t or "").encode() for _, t in rows], repeats.LENGTH), strict=True)]
    assert found(df) == sorted(want, key=repr)


@pytest.mark.parametrize("limits", [{}, {"HOT_BYTES": 900}, {"LONGEST_SEGMENT": 50, "PIECE": 700, "BLOCK_BYTES": 2000}])
@pytest.mark.parametrize("words", [0, 50])
def test_first_copies_stay(spark, monkeypatch, limits, words):
    for name, value in limits.items():
        monkeypatch.setattr(repeats, name, value)
    texts = corpus(8)
    random.Random(4).shuffle(texts)
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (6, texts[3]), (-5, texts[10]), (7, texts[9] + " " + texts[12])]
    df = spark.createDataFrame([(i, t, None if t is None else len(t), "x") for i, t in rows], "doc_id long, text string, n_chars int, k1 string").repartition(5)
    got = repeats.cleaned(df, length=200, words=words)
    assert got.columns == df.columns and dict(got.dtypes) == dict(df.dtypes)
    data = [(i, (t or "").encode()) for i, t in rows]
    want = []
    for (i, t), cover in zip(data, earlier(data, 200), strict=True):
        spans = [(a, b) for a, b in runs(cover) if not words or whole(t, a, b) >= words]
        edges = [0, *[x for s in spans for x in s], len(t)]
        kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore")
        want.append((i, kept, len(kept), "x"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(not t for _, t, _, _ in want) < 10


def test_passages_of_51_words_go_but_one(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short = prose(51), prose(44)
    rows = [(i, f"{prose(80)} {passage} {prose(60)}") for i in range(30)] + [(100 + i, f"{prose(50)} {short} {prose(50)}") for i in range(5)] + [(200, f"{(own := prose(70))} {own}"), (201, passage)]
    got = {r["doc_id"]: r["text"] for r in repeats.cleaned(spark.createDataFrame(rows, "doc_id long, text string"), length=200, words=50).collect()}
    assert [i for i, t in got.items() if passage in t] == [0]
    assert all(got[i] == t for i, t in rows if i >= 100 and i != 201) and got[201] == ""


@pytest.mark.parametrize("limits", [{}, {"HOT_BYTES": 900}, {"LONGEST_SEGMENT": 50, "PIECE": 700, "BLOCK_BYTES": 2000}])
def test_both_rules_against_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(repeats, name, value)
    texts = corpus(9)
    random.Random(5).shuffle(texts)
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (6, texts[3]), (6, texts[3]), (-5, texts[10]), (7, texts[9] + " " + texts[12])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_shared int, k1 string").repartition(5)
    got = repeats.removed_beside_cleaned(df, short=200).collect()
    data = [(i, (t or "").encode()) for i, t in rows]
    want = []
    for (i, t), long, cover in zip(data, expected([t for _, t in data], 400), earlier(data, 200), strict=True):
        spans = [(a, b) for a, b in runs(cover) if whole(t, a, b) >= 50]
        edges = [0, *[x for s in spans for x in s], len(t)]
        kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        want.append((i, *long, len(t) - len(kept), len(spans), kept.decode("utf-8", "ignore")))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest(), r["n_shared"], r["n_passages"], r["text"]) for r in got) == sorted(want)
    assert sum(w[2] > 0 for w in want) > 5 and sum(w[5] > 0 for w in want) > 5


def test_query_catches_shared_passages_under_400_bytes(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(52)
    rows = [(i, f"{prose(80)} {passage} {prose(60)}") for i in range(8)] + [(100 + i, prose(150)) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op6_run_length_index(spark, str(tmp_path)).collect()}
    assert len(passage) < 398 and all(r["n_removed"] == 0 and r["n_kept"] == r["n_bytes"] for r in got.values())
    assert [i for i, r in got.items() if passage in r["text"]] == [0]
    assert all(got[i]["text"] == t and got[i]["n_shared"] == 0 for i, t in rows if i == 0 or i >= 100)
    assert all(got[i]["n_passages"] == 1 and got[i]["n_shared"] >= len(passage) for i in range(1, 8))


def test_very_long_texts(spark):
    """Texts of many pieces: periodic, without repeats, and two that share a passage across a piece's edge."""
    rng = np.random.default_rng(5)
    own = [rng.integers(97, 123, 3 << 20, dtype=np.uint8).tobytes().decode() for _ in range(2)]
    shared, at = own[0][1000:3000], repeats.PIECE - 700
    rows = [(1, "ab" * (3 << 19)), (2, own[0]), (3, own[1][:at] + shared + own[1][at:])]
    got = {r["doc_id"]: r for r in repeats.removed(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed", "n_spans").collect()}
    assert [tuple(got[i])[1:] for i in (1, 2, 3)] == [(3 << 20, 1), (2000, 1), (2000, 1)]
    kept = {r["doc_id"]: r["n"] for r in repeats.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "length(text) AS n").collect()}
    assert kept == {1: 3 << 20, 2: 3 << 20, 3: 3 << 20}


def test_equal_windows_have_equal_names():
    rng = random.Random(3)
    shared = bytes(rng.randrange(97, 123) for _ in range(400))
    names = []
    for _ in range(30):
        data = bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 500))) + shared + bytes(rng.randrange(97, 123) for _ in range(rng.randint(0, 500)))
        at = data.index(shared)
        name, _, start, size, _ = repeats.segments(np.frombuffer(data, np.uint8))
        names.append([int(n) for n, s, z in zip(name, start, size, strict=True) if s <= at and at + 400 <= s + z])
    assert all(len(n) == 1 for n in names) and len({n[0] for n in names}) == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.removed(df).count() == 0


def test_query_on_a_table(spark):
    docs = [(r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    want = {i: e for (i, _), e in zip(docs, expected([t for _, t in docs], 400), strict=True)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op6_run_length_index(spark, f"{DATA}/sf0.001").collect()}
    assert got == want

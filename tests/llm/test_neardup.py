import random
from collections import Counter

import numpy as np
import pytest
from conftest import DATA

from lodestone.llm import neardup, queries


def weights(text):
    words = text.lower().split()
    if not words:
        return None
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def j_p(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys) for i in keys if i in a and i in b)


def brute(rows):
    """Least id per component of links at 0.8 over all pairs."""
    docs = [(i, weights(t or "")) for i, t in rows if i is not None]
    root = {i: i for i, _ in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(docs):
        for j, b in docs[:k]:
            if a and b and (set(a) & set(b) or a == b) and j_p(a, b) >= 0.8:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: top(i) for i, _ in docs}


def test_similarity_is_the_definition():
    rng = random.Random(1)
    for _ in range(50):
        a = Counter(rng.choices(range(12), k=rng.randint(1, 30)))
        b = Counter(rng.choices(range(4, 16), k=rng.randint(1, 30)))
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)], float)) for x in (a, b)]
        assert neardup.similarity(*arrays) == pytest.approx(j_p(a, b))
    assert neardup.similarity(arrays[0], arrays[0]) == pytest.approx(1)


def test_registers_agree_with_the_probability_jaccard_similarity():
    rng = np.random.default_rng(2)
    elements = rng.integers(1, 2**63, 90).astype(np.uint64)
    a = {int(e): float(rng.integers(1, 5)) for e in elements[:70]}
    b = {int(e): float(rng.integers(1, 5)) for e in elements[20:]}
    row = np.repeat([0, 1], [len(a), len(b)])
    sig = neardup.signatures(row, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, 20_000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(j_p(a, b), abs=0.015)


def corpus(seed, family):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    source = [word() for _ in range(220)]

    def variant(words, k):
        out = list(words)
        for i in rng.sample(range(len(out)), k):
            out[i] = word()
        return " ".join(out)

    texts = [" ".join(source)] + [variant(source, rng.randint(1, 6)) for _ in range(family)]
    texts += [" ".join(source)] * 5 + [" ".join(source).upper().replace(" ", "\n ")]
    texts += [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(60)]
    chain = [word() for _ in range(150)]
    for _ in range(12):  # each link is close to the next one only
        texts.append(" ".join(chain))
        chain = [*chain[10:], *[word() for _ in range(10)]]
    shared = [word() for _ in range(80)]
    texts += [" ".join([*shared, *[word() for _ in range(rng.randint(40, 90))]]) for _ in range(20)]
    texts += ["one two three", "One  two three ", "one two", "", " ", "line of words here again\n" * 40, "line of words here again\n" * 44]
    return texts


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 5)])
def test_classes_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = corpus(seed, 60)
    random.Random(seed).shuffle(texts)
    rows = list(enumerate(texts)) + [(5000, None), (5001, None)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in [*rows, (None, texts[0]), (3, texts[3])]], "doc_id long, text string, class_id int, node string").repartition(4)
    got = neardup.classes(df).collect()
    assert len(got) == len(rows) + 2
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == brute(rows)
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [None]
    if seed > 1:
        return
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    want = {i for i, c in brute(rows).items() if i == c}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*want, None])


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30)) and got[201] == got[202] == 200
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_and_clean_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(df).count() == 0 and neardup.deduplicated(df).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n")], "doc_id long, text string")
    assert sorted(map(tuple, neardup.classes(df).select("doc_id", "class_id").collect())) == [(1, 1), (2, 2)]


def test_query_on_a_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op3_probminhash(spark, f"{DATA}/sf0.001").collect()}
    assert got == brute(rows)


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200_000)]
    near = list(words)
    for i in range(0, len(near), 300):
        near[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1])), (4, "tiny"), (5, "")]
    df = spark.createDataFrame([(i, t, 0, 1, "x", b"s") for i, t in rows], "doc_id long, text string, key long, k1 long, bands string, sketch binary")
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]

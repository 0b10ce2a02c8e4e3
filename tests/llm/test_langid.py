import math
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from conftest import DATA

from lodestone.llm import langid, queries


def by_hand(runs, order=langid.ORDER):
    """Interpolated Kneser-Ney by its definition: (context, symbol) -> probability, unknown mass shared evenly."""
    letters = len({c for r in runs for c in r}) + 2
    raw = Counter()
    for run, k in runs.items():
        s = "\2" + run + "\3"
        for i in range(1, len(s)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    raw[s[i - n + 1 : i + 1]] += k
    tables = []
    for n in range(1, order + 1):
        grams = [g for g in raw if len(g) == n]
        count = {}
        for g in grams:
            left = len({x[0] for x in raw if len(x) == n + 1 and x[1:] == g}) if n < order else 0
            count[g] = left if n < order and not g.startswith("\2") and left else raw[g]
        ones, twos = sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
        d = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
        tables.append((count, d))

    def p(context, symbol):
        value = 1 / letters
        for n, (count, d) in enumerate(tables, 1):
            if len(context) < n - 1:
                break
            h = context[len(context) - n + 1 :]
            seen = {g: c for g, c in count.items() if g[:-1] == h}
            if seen:
                total = sum(seen.values())
                value = max(seen.get(h + symbol, 0) - d, 0) / total + sum(min(c, d) for c in seen.values()) / total * value
        return value

    return p


def test_probabilities_are_those_of_the_definition():
    runs = Counter({"banana": 3, "ban": 2, "nab": 1, "band": 1, "a": 4})
    model = langid.Model(["x"], [langid.Counts(runs)], len({c for r in runs for c in r}))
    p = by_hand(runs)
    for word in ["banana", "ban", "dab", "zzz", "a", "bandana"]:
        s = "\2" + word + "\3"
        want = sum(-math.log2(p(s[max(0, i - 4) : i], s[i])) for i in range(1, len(s)))
        bits, symbols = model.score([word, "ban"])
        assert symbols[0] == len(word) + 1 and bits[0, 0] == pytest.approx(want, rel=1e-5)


def test_probabilities_sum_to_one():
    runs = Counter({"abab": 2, "ba": 1, "b": 5})
    p = by_hand(runs)
    model = langid.Model(["x"], [langid.Counts(runs)], 2)
    total = sum(p("\2ab", s) for s in "ab\2\3")
    assert total == pytest.approx(1) and model.uniform == pytest.approx(1 / 4)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 0.5, "q") for i, t, g in rows], "doc_id long, text string, lang string, score double, runs string")


def test_nulls_blanks_and_rejection(spark):
    english = ["the cat sat on the mat and the dog ran after the cat " * 5, "a dog and a cat are on the mat and then they ran " * 5]
    german = ["der hund und die katze sind auf der matte und der hund lief " * 5, "die katze lief nach der matte und der hund sass auf ihr " * 5]
    rows = [(i, english[i % 2], "en") for i in range(20)] + [(100 + i, german[i % 2], "de") for i in range(20)]
    train = docs(spark, [*rows, (None, "no id", "en"), (900, None, "en"), (901, "1234", "de"), (902, "no label", None)])
    model = langid.train(train)
    assert model.languages == ["de", "en"]
    asked = docs(spark, [(1, "The dog!", None), (2, "und der hund", "en"), (3, None, "en"), (4, "123 \n ...", None), (5, "", None), (6, "жил был кот на свете и ходил " * 20, None), (None, "the mat", None), (7, "the cat " * 200_000, None), (1, "The dog!", None)])
    got = sorted(((r["doc_id"], r["lang_pred"], r["accepted"]) for r in langid.identify(asked, model).collect()), key=repr)
    want = [(1, "en", True), (1, "en", True), (2, "de", True), (3, "und", False), (4, "und", False), (5, "und", False), (7, "en", True), (None, "en", True)]
    assert [x for x in got if x[0] != 6] == sorted(want, key=repr) and [x[2] for x in got if x[0] == 6] == [False]
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (r["score"] == 0) for r in langid.identify(asked, model).collect())
    kept = langid.accepted(train)  # which has columns named score and runs
    assert kept.columns == train.columns and {r["score"] for r in kept.collect()} == {0.5} and {r["lang"] for r in kept.collect()} == {"de", "en"}
    nothing = langid.train(train.limit(0))
    assert {r["lang_pred"] for r in langid.identify(asked, nothing).collect()} == {"und"}
    assert langid.identify(asked.limit(0), model).count() == 0


def test_full_caches_change_nothing(monkeypatch):
    runs = Counter({"banana": 3, "ban": 2, "nab": 1})
    model = langid.Model(["x", "y"], [langid.Counts(runs), langid.Counts(Counter({"nana": 2}))], 3)
    column = pa.array([["banana", "", "nab"], [], ["zz"], None, ["ban"]], pa.list_(pa.string()))
    before = model.texts(column)
    monkeypatch.setattr(langid, "CACHED_RUNS", 1)
    monkeypatch.setattr(langid, "SYMBOLS_AT_ONCE", 4)
    model.forget()
    after = model.texts(column)
    assert (before[0] == after[0]).all() and before[1].tolist() == [11, 0, 3, 0, 4]


def test_held_out_accuracy_on_a_table(spark):
    got = queries.op5_kneser_ney(spark, f"{DATA}/sf0.01").collect()
    there = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    assert len(got) == len(there)
    right = total = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["held_out"]:
            total += 1
            right += r["lang_pred"] == there[r["doc_id"]]["lang"]
    assert right / total >= 0.98


def test_clean_documents_are_accepted(spark):
    docs_ = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    assert langid.identify(docs_, langid.train(docs_)).where("NOT accepted").count() == 0

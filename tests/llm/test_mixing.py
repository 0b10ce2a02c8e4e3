import re
from collections import Counter, defaultdict

import pytest
from conftest import DATA, same_as_duckdb

from lodestone.llm import mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int"


def by_hand(rows):
    """Targets by sharing and resharing, one round after another."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left = {}, sum(sizes.values())
    open_ = set(names)
    while True:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * sizes[s] <= weight[s] * left / w} if w else set()
        if not over:
            return sizes, out | {s: weight[s] * left / w for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= over


def test_matches_sql_on_a_table(spark):
    assert same_as_duckdb(queries.op9_golden_mix(spark, f"{DATA}/sf0.01"), queries.OP9_SQL, f"{DATA}/sf0.01") == 1000


@pytest.mark.parametrize("block", [1000, 7])
def test_targets_caps_nulls_and_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK", block)
    rows = [(i, "w " * (i % 40 + 1), f"s{i % 4}") for i in range(200)] + [(900, "one two three", "tiny"), (901, None, "void"), (902, " \t", "void"), (903, "a b c", None), (None, "q r s", "s1")] + [(7, "same text here", "s2")] * 6
    df = spark.createDataFrame([(i, t, "en", s, 0, 1) for i, t, s in rows], SCHEMA)
    got = mixing.mixed_counts(df).collect()
    sizes, target = by_hand(rows)
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, _, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    again = mixing.mixed_counts(df.repartition(3)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    out = mixing.mix(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_slots_follow_the_weights_all_along(spark):
    df = spark.createDataFrame([(i, "w " * 1000, "en", "abc"[i % 3], 0, 1) for i in range(300)], SCHEMA)
    _, sources, slots = mixing.planned(df, "doc_id", "text", "source")
    order = [r["place_no"] for r in slots.where("slot IS NOT NULL").orderBy("slot").collect()]
    share = {r["place_no"]: r["target"] for r in sources.collect()}
    total = sum(share.values())
    for n in (10, 50, 150, len(order)):
        assert all(abs(order[:n].count(s) - n * share[s] / total) <= 4 for s in share)


def test_many_sources(spark):
    """Thousands of small sources beside a large one: each point finds its owner, and targets hold."""
    rows = [(i, "w " * (i % 5 + 1), "en", f"s{i % 3000}", 0, 1) for i in range(6000)] + [(10_000 + i, "w " * 2000, "en", "big", 0, 1) for i in range(20)]
    got = mixing.mixed_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_clashing_names_and_long_texts(spark):
    df = spark.createDataFrame([(i, "word " * n, "abc"[i % 3], "x", 5) for i, n in enumerate([3, 400_000, 7, 0, 12, 90])], "doc_id long, text string, source string, place string, slot int")
    out = mixing.mix(df)
    assert out.columns == df.columns and {(r["place"], r["slot"]) for r in out.collect()} == {("x", 5)}
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(r["taken"] for r in mixing.mixed_counts(df).collect())


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed_counts(df).count() == 0 and mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a", 0, 1)], SCHEMA)
    assert [r["taken"] for r in mixing.mixed_counts(blank).collect()] == [0]

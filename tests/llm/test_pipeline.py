import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
from conftest import DATA

import __spark_entry__
import corpus_pipeline
from lodestone.llm import bpe, common
from test_mixing import by_hand
from test_neardup import brute as classes
from test_repeats import earlier, runs, whole

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    """Documents of the small table with planted nulls, blanks, foreign script, copies and a shared passage."""
    rng = random.Random(3)
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = [r for r in rows if len(r[1]) < 3000][:90]
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(70))
    more = [(1000, None, None, "src0", None), (1001, "", "en", None, 0), (1002, "12345 ... !!", "en", "src1", 12), (1003, "жил был старый кот на белом свете и ходил он один " * 10, None, "src1", 480), (1004, rows[0][1], "fr", "src9", 1)]
    more += [(1010 + i, f"{rows[10 + i][1]} {passage} {rows[20 + i][1]}", "en", "src2", 1) for i in range(4)]
    return rows + more


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_stages_against_brute_force(spark):
    docs = spark.createDataFrame(corpus(spark), COLUMNS)
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language ID", "MinHash near-dedup", "suffix-array dedup", "mixing to target weights", "byte-level BPE"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.stored(stage(spark, docs, DATA), "test")
        out[name] = (before, docs)
        if name != "byte-level BPE":
            assert docs.dtypes == [tuple(c.split()) for c in COLUMNS.replace("long", "bigint").split(", ")]

    before, after = out["language ID"]
    assert {r[0] for r in rows_of(before)} - {r[0] for r in rows_of(after)} == {1000, 1001, 1002, 1003}

    before, after = out["MinHash near-dedup"]
    root = classes([r[:2] for r in rows_of(before)])
    assert Counter(r[0] for r in rows_of(after)) == Counter(i for i, c in root.items() if i == c)

    before, after = out["suffix-array dedup"]
    source = rows_of(before)
    data = [(i, t.encode()) for i, t, _ in source]
    want = {}
    for (i, t), cover in zip(data, earlier(data, corpus_pipeline.PASSAGE_BYTES), strict=True):
        edges = [0, *[x for a, b in runs(cover) if whole(t, a, b) >= corpus_pipeline.PASSAGE_WORDS for x in (a, b)], len(t)]
        want[i] = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore")
    assert {r[0]: r[1] for r in rows_of(after)} == want and want != {i: t for i, t, _ in source}
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())

    before, after = out["mixing to target weights"]
    _, target = by_hand(rows_of(before))
    words = Counter()
    for _, t, s in rows_of(after):
        words[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert all(abs(words[s] - target[s]) <= 0.5 for s in target)

    before, after = out["byte-level BPE"]
    own = bpe.Tokenizer(P.path(corpus_pipeline.TOKENIZER), P.PATTERN)
    source = rows_of(before)
    want = Counter((i, tuple(ids.tolist()), hashlib.sha256(t.encode()).hexdigest()) for (i, t, _), ids in zip(source, own.encode([t for _, t, _ in source]), strict=True))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in after.collect()) == want


def test_registered_and_run(spark):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()
    assert [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)] == [n for n in __spark_entry__.queries() if n.startswith("op")] and len([n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]) == 10


def test_empty_tables(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA), "test")
        assert docs.count() == 0


def test_stages_with_long_texts_nulls_repeats_and_clashing_columns(spark):
    base = corpus(spark)[:40]
    long = " ".join(t for _, t, *_ in base) * 12
    rows = [*base, (5000, long, "en", "src0", 1), (5001, None, None, None, None), (5001, None, None, None, None), (None, base[3][1], "en", "src1", 1), base[0], base[0]]
    extra = "place string, slot int, k1 long, found string, row string, node long, marks string"
    docs = spark.createDataFrame([(*r, "p", 7, 8, "f", "r", 9, "m") for r in rows], f"{COLUMNS}, {extra}")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA), "test")
        if name != "byte-level BPE":
            assert docs.columns == names and {tuple(r) for r in docs.select(*names[5:]).collect()} == {("p", 7, 8, "f", "r", 9, "m")}
    assert docs.where("doc_id = 5000").count() >= 1 and docs.where("doc_id = 5001").count() == 0

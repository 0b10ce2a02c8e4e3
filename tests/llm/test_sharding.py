import zlib
from collections import Counter

import numpy as np
from conftest import DATA

from lodestone.llm import queries, sharding


def test_matrix_has_its_sums_and_the_hypergeometric_mean():
    rows, shards = [100, 0, 57, 3], [40] * 4
    total = np.zeros((4, 4))
    for seed in range(400):
        m = sharding.communication_matrix(rows, shards, seed)
        assert list(m.sum(1)) == rows and list(m.sum(0)) == shards and (m >= 0).all()
        total += m
    assert np.allclose(total[0] / 400, 25, atol=1) and np.allclose(total[2] / 400, 57 / 4, atol=1)


def test_large_populations_draw_from_the_same_law():
    rng = np.random.default_rng(1)
    got = np.array([sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10_000) for _ in range(4000)])
    assert abs(got.mean() - 3000) < 4 and abs(got.std() - np.sqrt(2100)) < 2


def check(rows, got, n):
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by.get(j, [])) for j in range(n)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1


def test_query_on_a_table(spark):
    df = queries.op4_hypergeometric_shards(spark, f"{DATA}/sf0.01")
    got = df.collect()
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    check(docs, got, 40)
    assert all(r["size"] == len(docs[r["doc_id"]]) + 16 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]]) and r["law"] == "rows" and r["grown_shard"] is None for r in got)
    again = queries.op4_hypergeometric_shards(spark, f"{DATA}/sf0.01").collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_nulls_repeats_and_small_tables(spark):
    rows = [(None, None, "a")] * 5 + [(1, "x", None)] * 30 + [(i, f"t{i}", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    got = sharding.shard_rows(df, ["doc_id", "text"], 7).collect()
    check(rows, got, 7)
    assert Counter((r["doc_id"], r["text"], r["other"]) for r in got) == Counter(rows)
    assert sharding.shard_rows(df.limit(0), ["doc_id"], 7).count() == 0
    check(rows[:2], sharding.shard_rows(df.limit(2), ["doc_id", "text"], 7).collect(), 7)
    moved = sharding.shard_rows(df.repartition(5), ["doc_id", "text"], 7).collect()
    assert sorted(map(tuple, moved), key=repr) == sorted(map(tuple, got), key=repr)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, "t", 9, "a", -1, "r") for i in range(50)], "doc_id long, b string, shard int, slot string, bucket int, row string")
    got = sharding.shard_rows(df, ["doc_id", "b"], 7)
    assert got.columns == ["doc_id", "b", "bucket", "row", "shard", "slot"]
    check(range(50), rows := got.collect(), 7)
    assert {(r["b"], r["bucket"], r["row"]) for r in rows} == {("t", -1, "r")} and {r["doc_id"] for r in rows} == set(range(50))

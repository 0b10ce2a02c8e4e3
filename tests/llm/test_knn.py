import numpy as np
import pytest
from conftest import DATA, same_as_duckdb

from lodestone.llm import knn, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string, query_id int"


def brute(rows, asked, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in dict((i, v) for i, v in ok if i in asked).items():
        scored = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(qv))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_matches_sql_on_a_table(spark):
    assert same_as_duckdb(queries.op1_pivot_topk(spark, f"{DATA}/sf0.01"), queries.OP1_SQL, f"{DATA}/sf0.01") == 50


@pytest.mark.parametrize("seed", [1, 2])
def test_nulls_ties_copies_and_clashing_columns(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # a group of copies: ties go to the smaller id
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0]), (2002, [float("nan")] * 4), (2003, [float("inf")] * 4), (None, [1.0] * 4), (2004, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)
    asked = {0, 50, 100, 1000, 2000, 2004}
    got = knn.top_k(df, df.where(df.vec_id.isin(list(asked))), 5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, asked)


def test_more_query_blocks_and_empty_tables(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(90)]
    df = spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows], SCHEMA)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 10)
    assert sorted(tuple(r) for r in knn.top_k(df, df, 4).collect()) == brute(rows, set(range(90)), 4)
    assert knn.top_k(df.limit(0), df.limit(0)).count() == 0
    assert knn.top_k(df.limit(1), df.limit(1)).count() == 0


def test_queries_that_share_an_id_count_once(spark):
    rows = [(i, [float(i), 1.0]) for i in range(20)]
    df = spark.createDataFrame([(i, v, 0, "", 0) for i, v in rows], SCHEMA)
    twice = spark.createDataFrame([(3, [5.0, 1.0], 0, "", 0), (3, [-2.0, 1.0], 0, "", 0), (3, [-2.0, 1.0], 0, "", 0)], SCHEMA)
    got = sorted(tuple(r) for r in knn.top_k(df, twice, 2).collect())
    assert [(q, r, i) for q, r, i, _ in got] == [(3, 1, 0), (3, 2, 1)]

from conftest import DATA, same_as_duckdb

from lodestone.llm import licenses, queries


def test_matches_sql_on_a_table(spark):
    assert same_as_duckdb(queries.op8_license_digests(spark, f"{DATA}/sf0.01"), queries.license_sql(), f"{DATA}/sf0.01") == 1000


def test_typography_spelling_and_copyright_lines(spark):
    mit = "  Copyright (c) 2020-2024  Some One\n© Another\n\n" + licenses.MIT.upper().replace(",", " ,\n").replace('"', "“")
    rows = [(1, mit), (2, licenses.MIT + " And more."), (3, licenses.ZLIB.replace("acknowledgment", "acknowledgement")), (4, None), (5, ""), (6, "released under the mit licence"), (7, licenses.MIT.replace("Software", "Hardware", 1)), (None, licenses.UNLICENSE), (1, mit), (8, "word " * 300_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    assert sorted({(r["doc_id"], r["license"]) for r in got}, key=repr) == sorted({(1, "MIT"), (2, None), (3, "Zlib"), (4, None), (5, None), (6, None), (7, None), (None, "Unlicense"), (8, None)}, key=repr)
    assert {r["canonical_sha256"] for r in got if r["doc_id"] == 4} == {None}
    assert licenses.scan(df.limit(0)).count() == 0


def test_both_normalisers_agree(spark):
    df = spark.createDataFrame([(str(i), t) for i, (_, t) in enumerate(licenses.KNOWN)], "i string, text string")
    for r in df.select("text", licenses.canonical(df["text"]).alias("c")).collect():
        assert r["c"] == licenses.canonical_text(r["text"])


def test_known_digests_are_distinct_per_licence():
    found = licenses.digest_list(licenses.KNOWN)
    assert len({d for d, _ in found}) == len(found)
    assert {n for _, n in found} == {n for n, _ in licenses.KNOWN}

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.functions import fixed, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("raw", ["ﬁrst ofﬁce  x", "a b c", "a​b﻿", "naïve café", "  \t\r\n x  ", None])
def test_corpus_normalised(spark, raw):
    want = None if raw is None else re.sub("[ \t\r\n  -   　]+", " ", re.sub("[​-‍﻿]", "", unicodedata.normalize("NFKC", raw))).strip(" ")
    assert one(spark, text.corpus_normalised, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("a\r\nb\rc", "a\nb\nc"), ("a\n\n\n\nb", "a\n\nb"), ("soft­hyphen \t x", "softhyphen x"), ("​ ﬁ \n", "fi")])
def test_workspace_normalised(spark, raw, want):
    assert one(spark, text.workspace_normalised, raw) == want


def test_tokens_keep_numbers_and_drop_function_words(spark):
    assert one(spark, text.tokens, "The Article 51 of sub-lease, NOT the 2007 law") == ["article", "51", "sub", "lease", "not", "2007", "law"]
    assert one(spark, text.keywords, "How long is the notice, and the notice period?") == ["notice", "period"]


@pytest.mark.parametrize(("raw", "want"), [("Federal Decree-Law No. 33 of 2021", ("federaldecreelaw", 33, 2021)), ("law no (26) of 2007 Regulating", ("law", 26, 2007)), ("Article 4", None)])
def test_instrument_key(spark, raw, want):
    got = one(spark, text.instrument_key, raw)
    assert (None if got is None else tuple(got)) == want


def test_labels_slugs_and_ids(spark):
    assert one(spark, text.folded_label, "Law 26/2007 (Dubai)") == "law262007dubai"
    assert one(spark, text.slug, " -- The Law: No. 2! ") == "the-law-no-2" and one(spark, text.slug, "؟") == "part"
    assert len(one(spark, text.slug, "x" * 90)) == 60
    digest = hashlib.sha256(b"a:b:a1:0:0").digest()
    assert one(spark, text.point_id, "a:b:a1:0:0") == int.from_bytes(digest[:8], "big") >> 1
    got = spark.range(1).select(text.chunk_id(F.lit("law"), F.lit("p"), F.lit(7), F.lit(0), F.lit("é")).alias("x")).first()[0]
    assert got == "law:p:a7:0:" + hashlib.sha256("é".encode()).hexdigest()[:10]


def test_json_objects(spark):
    read = lambda c: text.json_object(c, "decision string, query string")
    assert tuple(one(spark, read, '```json\n{"decision": "allow", "query": "q"}\n```')) == ("allow", "q")
    assert one(spark, read, "no object here") is None


def test_headings_numbers_and_costs(spark):
    assert one(spark, text.heading_number, "24") == 24 and one(spark, text.heading_number, "1.2") is None and one(spark, text.heading_number, "IV") is None
    row = spark.range(1).select(text.article_header(F.lit("Law"), F.lit(3), F.lit("Leave"), F.lit("S")).alias("a"), text.article_header(F.lit("Law"), F.lit(3), F.lit(""), F.lit("S")).alias("b"), text.article_header(F.lit("Law"), F.lit(3), F.lit(None).cast("string"), F.lit("")).alias("c"), text.probability(F.lit(0.0)).alias("p"), text.cost_usd(F.lit(10), F.lit(10), F.lit(None).cast("double"), F.lit(1.0)).alias("usd")).first()
    assert tuple(row) == ("Law - Article 3: Leave", "Law - Article 3 (S)", "Law - Article 3", 0.5, pytest.approx(40e-6))


def test_clauses_equal_a_zero_width_split(spark):
    for raw in ["1. one a. two (b) three (12) four", "no clause", "x a. a. b", "(a) first", ""]:
        assert one(spark, text.clauses, raw) == [p for p in re.split(fixed.CLAUSE_SPLIT_JAVA, raw) if p.strip()]


@pytest.mark.parametrize("bad", [{"chunk_overlap_tokens": 600}, {"chunk_overlap_tokens": -1}, {"rrf_k": 0}, {"source_profile": "other"}])
def test_settings_are_validated(bad):
    with pytest.raises(ValueError):
        EngineConfig(**bad)
    assert EngineConfig(chunk_target_tokens=1000).effective_chunk_tokens == 512 and EngineConfig().for_workspace().refusal_score_floor == -8.0

"""Adapters of real models, with a fixed vocabulary of four words and sessions that compute by hand."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.operators import models, packing, rerank


@pytest.fixture
def words(tmp_path):
    """A tokenizer of whole words: unknown ones are one token too."""
    tokenizers = pytest.importorskip("tokenizers")
    tool = tokenizers.Tokenizer(tokenizers.models.WordLevel({"[UNK]": 0, "aa": 1, "bb": 2, "cc": 3}, unk_token="[UNK]"))
    tool.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    path = str(tmp_path / "words.json")
    tool.save(path)
    return path


class Session:
    """States are one-hot of the ids; a pair's logit is the number of its tokens."""

    def get_inputs(self):
        return [SimpleNamespace(name=n) for n in ("input_ids", "attention_mask")]

    def run(self, _, inputs):
        return [np.eye(4)[inputs["input_ids"]]]


class Scores(Session):
    def run(self, _, inputs):
        return [inputs["attention_mask"].sum(1)[:, None]]


def test_counts_and_cuts(words):
    count = models.SubwordCounter(words)
    assert count("aa bb, zz") == 4 and count("") == 0
    assert count.cut("aa bb, zz", 2) == "aa bb" and count.cut("aa bb", 9) == "aa bb" and count.cut("aa", 0) == ""
    chunks = packing.article_chunks("aa", ["aa " * 50], 25, 0, count)
    assert all(count(c) <= 25 for c in chunks) and sum(count(c) - 1 for c in chunks) == 50
    assert models.tokenizer(words) is models.tokenizer(words)


def test_encoder_and_cross_encoder(words, monkeypatch):
    monkeypatch.setattr(models, "session", lambda path: Session() if path == "encoder" else Scores())
    model = models.OnnxEmbedder("encoder", words, 4, most_tokens=3)
    out = model.embed(["aa bb", "cc", "aa aa aa bb bb", ""])
    assert np.allclose(np.linalg.norm(out[:3], axis=1), 1) and np.allclose(out[0], [0, 0.5**0.5, 0.5**0.5, 0]) and np.allclose(out[2], [0, 1, 0, 0])
    assert np.allclose(models.OnnxEmbedder("encoder", words, 4, first=True).embed(["bb aa"])[0], [0, 0, 1, 0])
    with pytest.raises(ValueError, match="4 dimensions"):
        models.OnnxEmbedder("encoder", words, 5).embed(["aa"])
    assert models.OnnxPairScorer("pairs", words).score("aa", ["bb", "bb cc"]) == [2.0, 3.0]


def test_reranking_cuts_by_the_models_tokens(spark, words):
    rows = spark.createDataFrame([(1, "aa", "c1", "bb cc aa"), (1, "aa", "c2", "aa bb")], "qid long, question string, chunk_id string, text string")
    got = {r["chunk_id"]: r["rerank_score"] for r in rerank.rerank(rows, EngineConfig(rerank_max_tokens=2), cut=models.SubwordCounter(words).cut).collect()}
    assert got == {"c1": -6.0, "c2": 6.0}
    assert rerank.rerank(rows.withColumn("text", F.lit(None).cast("string")), cut=models.SubwordCounter(words).cut).count() == 2

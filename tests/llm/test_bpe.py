import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest import DATA

from lodestone.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", " ", "a", "Hello, world's  end\n\n\tdone ", "é" * 70, "naïve 12345 ½ ² Ⅷ ٣ 你好 мир 🙂🙂", "x" * 3000 + " " + "ab" * 900, "     z", "\x1c\x85​", "don't I'LL we're'd", "aaaábbb" * 30, "<|endoftext|> as text"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(PATH, P.PATTERN)


def random_texts(n):
    rng = random.Random(5)
    alphabet = "aeiou stn rl.,'\n\t" + "éßüñ0123456789" + "мир你🙂́ "
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(n)]


def test_ids_are_the_librarys(own, library):
    texts = TEXTS + random_texts(500)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids.astype(np.int64)).tobytes() == text.encode()


def test_small_rounds_long_pieces_and_a_full_cache(own, library, monkeypatch):
    texts = TEXTS + random_texts(60)
    for name, value in (("PIECES_AT_ONCE", 7), ("CACHED_PIECES", 20), ("LONG", 4), ("BUCKETS", (2, 4)), ("MATRIX_CELLS", 8)):
        monkeypatch.setattr(bpe, name, value)
    own.forget()
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    own.forget()


def test_vocabularies_with_unreachable_pieces():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cde": 259, b"abcd": 260}
    path = "/tmp/lodestone-test.tiktoken"
    with open(path, "w") as f:
        f.writelines(f"{base64.b64encode(k).decode()} {v}\n" for k, v in ranks.items())
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Tokenizer(path, P.PATTERN)
    texts = ["cde", "abcde", "abcabc", "bcbc", "xcde", "ababcd"]
    assert [x.tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_rows_nulls_and_clashing_columns(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (50, None), (0, "")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, decoded int")
    got = bpe.digests(bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := library.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(df.limit(0), PATH, P.PATTERN), PATH, P.PATTERN).count() == 0


def test_query_on_a_table(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    got = queries.op7_byte_bpe(spark, f"{DATA}/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest())

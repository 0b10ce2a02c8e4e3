"""Fetching, OCR tiers, PDF spans, stored indexes and parsing, with stand-ins for the network and the PDF library."""

import json
import sys
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.operators import dense, sparse
from lodestone.plans.index import build_index, index_of, load_index
from lodestone.plans.parse import parse_corpus
from lodestone.sources import files, manifest, pdf, scratch, tables, web


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # stand-ins go to the workers by value

class Net:
    """Pages and addresses by host."""

    def __init__(self, pages, hosts):
        self.pages, self.hosts = pages, hosts

    def resolve(self, host, port):
        return self.hosts.get(host, [])

    def get(self, url, address, limit):
        status, headers, body = self.pages[url]
        return web.Response(status, headers, body[: limit + 1])


PAGES = {
    "http://a.org/x": (302, {"location": "/y"}, b""), "http://a.org/y": (200, {"content-type": "Text/HTML; charset=utf-8"}, b"<p>hello</p>"),
    "http://a.org/in": (301, {"location": "http://inside.org/"}, b""), "http://a.org/loop": (301, {"location": "/loop"}, b""), "http://a.org/big": (200, {}, b"x" * 50),
    "http://a.org/no": (404, {}, b""), "http://a.org/lost": (302, {}, b""), "http://both.org/": (200, {}, b"x"), "http://a.org/t?q=1": (200, {"content-type": "text/plain"}, b"plain"),
}
HOSTS = {"a.org": ["8.8.8.8"], "inside.org": ["10.0.0.9"], "both.org": ["8.8.8.8", "192.168.1.1"], "v6.org": ["::ffff:127.0.0.1"]}


@pytest.mark.parametrize(("url", "problem"), [
    ("http://a.org/in", "not a public address"), ("http://a.org/loop", "too many redirects"), ("http://a.org/big", "too large"), ("http://a.org/no", "404"), ("http://a.org/lost", "without a target"),
    ("http://both.org/", "not a public address"), ("http://v6.org/", "not a public address"), ("http://nowhere.org/", "no address"), ("ftp://a.org/", "only http"), ("http://127.0.0.1/", "not a public address"), ("", "only http"), ("http://224.0.0.1/", "not a public address"),
])
def test_unfit_urls(url, problem):
    with pytest.raises(ValueError, match=problem):
        web.fetch(url, Net(PAGES, HOSTS), EngineConfig(workspace_max_bytes=40))


def test_fetched_pages_are_extracted(spark):
    urls = spark.createDataFrame([("http://a.org/x",), ("http://a.org/t?q=1",), ("http://a.org/no",), (None,)], "url string")
    found = web.fetched(urls, Net(PAGES, HOSTS))
    rows = {r["url"]: r for r in found.collect()}
    assert rows["http://a.org/x"]["path"] == "y.html" and rows["http://a.org/t?q=1"]["path"] == "t.txt" and rows["http://a.org/no"]["problem"] == "the server answered 404" and rows[None]["problem"]
    texts = {r["path"]: r["text"] for r in files.extract(found.where("problem IS NULL").select("path", "content", "content_type")).collect()}
    assert texts == {"y.html": "hello", "t.txt": "plain"}


def test_downloads_take_the_first_whole_pdf(spark):
    whole = b"%PDF-" + b"x" * 9000
    served = {"https://o/a": whole, "https://o/b": b"<html>", "https://m/b": whole, "https://o/c": b"%PDF-1", "https://m/c": b"%PDF-2"}

    def get(url):
        if url not in served:
            raise OSError("down")
        return served[url]

    assert manifest.download(["https://o/b", "https://m/b"], get) == ("https://m/b", whole, None)
    assert manifest.download(["http://o/a", None], get)[2] == "http://o/a: not https"
    assert manifest.download(["https://o/c", "https://m/c"], get)[2].count("too small") == 2 and manifest.download([None, None], get)[2] == "no URL is declared"
    rows = spark.createDataFrame([("a.pdf", "https://o/a", None), ("z.pdf", "https://o/z", "https://m/b")], "filename string, official_url string, mirror_url string")
    found = {r["filename"]: (r["retrieved_from"], len(r["content"])) for r in manifest.downloaded(rows, get).collect()}
    assert found == {"a.pdf": ("https://o/a", 9005), "z.pdf": ("https://m/b", 9005)}


def test_ocr_tiers():
    def broken(image):
        raise RuntimeError("offline")

    tiers = [("vision", broken), ("blank", lambda i: "NO_TEXT"), ("local", lambda i: f"read {len(i)}")]
    assert files.read_image(b"123", tiers) == ("read 3", "local")
    with pytest.raises(ValueError, match="vision: offline"):
        files.read_image(b"1", tiers[:2])
    with pytest.raises(ValueError, match="no OCR engine"):
        files.read_image(b"1", [])


class Page:
    rect = SimpleNamespace(width=600.0)

    def __init__(self, lines, image=b""):
        self.lines, self.image = lines, image

    def get_text(self, kind):
        if kind == "text":
            return "\n".join(t for t, *_ in self.lines)
        glyphs = lambda t, x, s: [{"c": c, "bbox": (x + s * i * 0.5, 0, x + s * (i + 0.5) * 0.5, 0)} for i, c in enumerate(t)]
        return {"blocks": [{"type": 1}] + [{"lines": [{"spans": [{"chars": glyphs(t, x, s), "bbox": (x, y, x + w, y + s), "size": s, "flags": 16 if b else 0, "font": "Serif"}]}]} for t, x, y, w, s, b in self.lines]}

    def get_pixmap(self, dpi):
        assert dpi == 200
        return SimpleNamespace(tobytes=lambda kind: self.image)


class Document(list):
    needs_pass = False

    @property
    def page_count(self):
        return len(self)

    def __enter__(self):
        return self

    def __exit__(self, *rest):
        pass


def opener(pages):
    return lambda stream, filetype: Document(pages)


def test_scans_are_read_page_by_page():
    pages = opener([Page([], b"one"), Page([], b""), Page([], b"three")])
    tiers = [("local", lambda image: image.decode() or None)]
    assert files.read_scan(b"", EngineConfig(), tiers, pages) == (["one", "", "three"], "local")
    assert files.read_scan(b"", EngineConfig(workspace_max_pages=1), tiers, pages) == (["one"], "local")
    with pytest.raises(ValueError, match="no readable text"):
        files.read_scan(b"", EngineConfig(), [("none", lambda image: "NO_TEXT")], pages)
    assert pdf.page_texts(b"", 2, pages) == (["", ""], True)
    locked = Document([])
    locked.needs_pass = True
    with pytest.raises(ValueError, match="password"):
        pdf.page_texts(b"", 2, lambda stream, filetype: locked)


def law_pages():
    line = lambda t, y, x=50.0, w=200.0, s=10.0, b=False: (t, x, y, w, s, b)
    return [
        Page([line("Contents", 10.0, s=14.0), line("Article (1)", 30.0), line("Definitions", 31.0, 260.0, 150.0), line("Article (2)", 50.0), line("Scope", 50.0, 260.0, 150.0), line("Article (9)", 70.0), line("Missing one", 70.0, 260.0, 150.0)]),
        Page([line("Article (1)", 30.0, b=True), line("In this law words mean what they say.", 60.0, w=500.0), line("Article (2)", 90.0, b=True), line("This law applies to all of it.", 120.0, w=500.0), line("page 2 of 9", 780.0)]),
    ]


def test_spans_become_articles(spark):
    rows = list(pdf.page_spans("law", b"", opener(law_pages())))
    assert {r[1] for r in rows} == {1, 2} and rows[0][10] == 14.0 and any(r[11] for r in rows)
    spans = spark.createDataFrame([(*r[:6], "".join(c["c"] for c in r[6]), *r[7:]) for r in rows], "doc_id string, page int, page_width double, block_id int, line_id int, span_id int, text string, x0 double, y0 double, x1 double, size double, bold boolean")
    declared = spark.createDataFrame([("law", "Law", "Law No. (5) of 2020", "x")], "law_id string, label string, title string, notes string")
    articles, told = parse_corpus(spans, declared)
    assert sorted((r["law_label"], r["article_no"], r["title"], r["section"], r["text"]) for r in articles.collect()) == [
        ("Law", 1, "Definitions", "Definitions", "In this law words mean what they say."), ("Law", 2, "Scope", "Scope", "This law applies to all of it."),
    ]
    (d,) = told.collect()
    assert (d["articles"], d["contents_entries_seen"], d["contents_missing_in_body"], d["contents_check_passed"], d["furniture_lines_dropped"]) == (2, 3, 1, False, 1)
    lost = parse_corpus(spans, declared.unionByName(declared.withColumn("law_id", F.lit("other"))))[1]
    with pytest.raises(Exception, match="no articles were extracted from other"):
        lost.collect()


def test_stored_index_is_what_search_reads(spark, tmp_path):
    rows = [(f"c{i}", f"law{i % 2}", " ".join(f"w{(i * k) % 97}" for k in range(1, 9))) for i in range(40)]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "chunk_id string, law_id string, text string").write.parquet(path)
    chunks = spark.read.parquet(path)
    asked = spark.createDataFrame([(1, "w6 w12"), (2, "w35 w35 nothing"), (3, "")], "qid long, question string")
    index = index_of(chunks, path, dense.HashingEmbedder(8))
    want = sorted(map(tuple, sparse.search(chunks, asked, 10).collect()))
    assert want and sorted(map(tuple, sparse.search(index.sparse, asked, 10).collect())) == want
    base = scratch.shared_dir(spark)
    before = scratch.fingerprint(spark, path)
    again = index_of(chunks, path, dense.HashingEmbedder(8))
    assert again.sparse.n == 40 and scratch.exists(spark, f"{base}/index-{before}/weights/_SUCCESS") and again.vectors.count() == 40
    chunks.limit(1).write.mode("append").parquet(path)
    assert scratch.fingerprint(spark, path) != before and index_of(spark.read.parquet(path), path).sparse.n == 41
    plan = sparse.search(index.sparse, asked, 10)._jdf.queryExecution().executedPlan().toString()
    assert "w6" not in plan and "regexp_extract_all(lower(text" not in plan
    with pytest.raises(ValueError, match="no passages"):
        tables.write_sparse_index(chunks.limit(0), str(tmp_path / "none"))


def test_vectors_are_upserted_and_kept_by_law(spark, tmp_path):
    path = str(tmp_path / "vectors")
    row = lambda i, v: (f"c{i}", [float(v), 1.0])
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    tables.recreate(spark, path)
    first = frame([row(1, 1), row(2, 2)])
    tables.upsert(path, first.select("chunk_id"), first, 2)
    second = frame([row(2, 5), row(3, 3)])
    tables.upsert(path, second.select("chunk_id"), second, 2)
    held = {r["chunk_id"]: r["embedding"][0] for r in spark.read.parquet(path).collect()}
    assert held == {"c1": 1.0, "c2": 5.0, "c3": 3.0}
    with pytest.raises(ValueError, match="differ in number"):
        tables.upsert(path, second.select("chunk_id").limit(1), second, 2)
    chunks = spark.createDataFrame([("c1", "a"), ("c2", "a"), ("c3", "b")], "chunk_id string, law_id string")
    tables.vectors_by_law(spark.read.parquet(path), chunks, str(tmp_path / "by_law"))
    one = spark.read.parquet(str(tmp_path / "by_law")).where("law_id = 'b'")
    assert [r["chunk_id"] for r in one.collect()] == ["c3"] and "PartitionFilters: [isnotnull(law_id" in one._jdf.queryExecution().executedPlan().toString()


def test_build_then_load(spark, tmp_path):
    article = "law_id string, law_label string, law_title string, part_id string, part_title string, article_no int, title string, section string, text string, page_start int, page_end int"
    rows = [("l", "Law", "The Law", "p", "P", i, "Leave", "", t, 1, 1) for i, t in enumerate(["one two three", "four five"], 1)]
    path = str(tmp_path / "index")
    build_index(spark.createDataFrame(rows, article), path, EngineConfig(embedding_dim=8))
    index = load_index(spark, path)
    hits = sparse.search(index.sparse, spark.createDataFrame([(1, "four")], "qid long, question string"), 5).collect()
    assert index.sparse.n == 2 and index.vectors.count() == 2 and len(hits) <= 1
    assert json.loads(index.chunks.limit(1).toJSON().first())["law_id"] == "l" and np.isfinite(index.sparse.avgdl)

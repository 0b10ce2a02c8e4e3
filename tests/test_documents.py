import io
import random
import re
import zipfile
from collections import Counter

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.functions import fixed
from lodestone.operators import chunking, layout, packing, sections
from lodestone.plans import documents_queries
from lodestone.plans.index import build_index
from lodestone.sources import files, manifest, tables

PAGE = "doc_id string, title string, source string, page_no int, text string"


def pages(spark, rows):
    return spark.createDataFrame([(d, "T", "s", p, t) for d, p, t in rows], PAGE)


@pytest.mark.parametrize(("line", "label", "number"), [
    ("## Scope of work", "Scope of work", None), ("1.2 General Rules", "1.2 General Rules", None), ("24 Notice periods", "24 Notice periods", 24), ("Article 24 — Leave", "24 Leave", 24), ("CLAUSE IV", "Clause IV", None),
    ("FINAL PROVISIONS", "FINAL PROVISIONS", None), ("24 hours later it ended.", None, None), ("plain text", None, None), ("", None, None), ("# " + "x" * 150, None, None),
])
def test_headings(spark, line, label, number):
    found = sections.matched_heading(F.col("line"))
    row = spark.createDataFrame([(line,)], "line string").select(*[c.alias(n) for c, n in zip(found, "abc", strict=True)]).first()
    assert (row["b"], row["c"]) == (label, number) and bool(row["a"]) == (label is not None)


def by_hand(texts):
    """Sections of one document by a plain state machine over its pages."""
    heads = [(fixed.HEADING_MARKDOWN, None, 1), (fixed.HEADING_NUMBERED, 1, 2), (fixed.HEADING_UNIT, 1, 2), (fixed.HEADING_CAPITALS, None, 1)]
    out, open_ = [], {"title": "", "start": 1, "lines": []}

    def close(page):
        body = "\n".join(open_["lines"]).strip()
        if body and (len(body) >= 40 or not out):
            out.append([open_["title"], body, open_["start"], page])
        elif body:
            out[-1][1] += "\n" + body
            out[-1][3] = max(out[-1][3], page)

    for page, text in enumerate(texts, 1):
        for line in text.split("\n"):
            bare = line.strip()
            hit = next(((p, n, t) for p, n, t in heads if bare and len(bare) <= 140 and re.match(p, bare)), None)
            if hit:
                m = re.match(hit[0], bare)
                num, title = (m[hit[1]] if hit[1] else ""), m[hit[2]].strip(" -—:.")
                close(page)
                open_ = {"title": f"{num} {title}" if num and title else title or (f"Clause {num}" if num else bare), "start": page, "lines": [bare]}
            else:
                open_["lines"].append(line)
    close(len(texts))
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_sections_equal_a_state_machine(spark, seed):
    rng = random.Random(seed)
    lines = ["# One", "2. Second Part", "Article 7", "ALL CAPS HERE", "short", "a line that is long enough to stand alone as a section body", "", "  "]
    docs = [["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 3))] for _ in range(12)]
    df = pages(spark, [(str(d), p, t) for d, ps in enumerate(docs) for p, t in enumerate(ps, 1)])
    got = {}
    for r in sections.split_sections(df).orderBy("doc_id", "section_no").collect():
        got.setdefault(r["doc_id"], []).append((r["title"], r["text"], r["page_start"], r["page_end"]))
    # A section that opens before the first heading starts on the document's first page.
    for d, ps in enumerate(docs):
        assert [x[:2] for x in got.get(str(d), [])] == [x[:2] for x in by_hand(ps)], ps
        assert [x[2] for x in got.get(str(d), [])] == [x[2] for x in by_hand(ps)]


def test_numbers_are_unique_and_printed_ones_win(spark):
    rows = [("d", 1, 1), ("d", 2, 24), ("d", 3, 1), ("d", 4, None), ("d", 5, 2), ("e", 1, None)]
    got = sections.assigned_numbers(spark.createDataFrame(rows, "doc_id string, section_no int, number int")).orderBy("doc_id", "section_no").collect()
    assert [r["resolved"] for r in got] == [25, 24, 26, 27, 2, 1]


def test_packing_keeps_every_word_and_the_budget():
    rng = random.Random(1)
    for _ in range(100):
        paragraphs = [" ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 8))]
        out = packing.paragraph_chunks(paragraphs, 12)
        assert Counter(" ".join(out).split()) == Counter(" ".join(paragraphs).split())
        assert all(packing.cost(p) <= 12 for p in out)


def test_document_chunks_cover_their_text(spark):
    df = pages(spark, [("a", 1, "# Intro\n" + "word " * 700 + "\n\nlast words here"), ("a", 2, "12 Second Heading\nmore text that goes on for a good while, surely"), ("b", 1, "no structure at all in this one page of text"), ("c", 1, "")])
    chunks = sections.chunk_documents(df)
    rows = chunks.collect()
    assert {r["unit_label"] for r in rows if r["law_id"] == "a"} == {"Section"} and {r["unit_label"] for r in rows if r["law_id"] == "b"} == {"Page"}
    assert len({r["chunk_id"] for r in rows}) == len(rows) and all(r["seq"] < r["seq_total"] for r in rows)
    whole = df.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    cover = {r["doc_id"]: r["coverage"] for r in sections.coverage(whole, chunks.select(F.col("law_id").alias("doc_id"), "text")).collect()}
    assert cover == {"a": 1.0, "b": 1.0, "c": 1.0}


ARTICLE = "law_id string, law_label string, law_title string, part_id string, part_title string, article_no int, title string, section string, text string, page_start int, page_end int"


def articles(spark, texts):
    return spark.createDataFrame([("l", "Law", "The Law", "p", "P", i, "Leave", "", t, 1, 1) for i, t in enumerate(texts, 1)], ARTICLE)


def test_article_chunks(spark):
    long = " ".join(f"{i}. clause {'word ' * 30}end." for i in range(1, 40))
    df = articles(spark, [long, "short", "", "x" * 10 + " " + "word, " * 900])
    chunks = chunking.chunk_articles(df)
    rows = chunks.orderBy("article_no", "seq").collect()
    assert all(r["text"].startswith(f"Law - Article {r['article_no']}: Leave") and r["token_count"] <= 512 for r in rows)
    assert [r["text"] for r in rows if r["article_no"] == 3] == ["Law - Article 3: Leave"]
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    assert {r["chunk_id"] for r in chunking.chunk_articles(df.repartition(3)).collect()} == {r["chunk_id"] for r in rows}
    first, second = (r["text"].split("\n")[1] for r in rows[:2])
    assert any(second.startswith(f"{i}. clause") and f" {i}. clause" in first for i in range(2, 40)), "a chunk repeats whole trailing segments"
    stats = {(r["target"], r["capped"]): r for r in chunking.size_experiment(df).collect()}
    assert stats[300, True]["chunks"] > stats[600, True]["chunks"] and stats[1000, False]["over_window"] > 0 and stats[1000, True]["over_window"] == 0
    with pytest.raises(Exception, match="exceeds the window"):
        chunking.checked(chunking.chunk_articles(df, target=1000, capped=False)).collect()


def line(page, block, text, y, x0=50.0, x1=250.0, size=10.0, bold=False, width=600.0, doc="d"):
    return (doc, page, width, block, text, float(x0), float(y), float(x1), size, bold)


LINE = "doc_id string, page int, page_width double, block_id int, text string, x0 double, y0 double, x1 double, size double, bold boolean"


def test_articles_of_a_small_law(spark):
    body = lambda p, b, t, y: line(p, b, t, y, 50.0, 550.0)
    rows = [
        line(1, 1, "Contents", 10, size=14.0), line(1, 2, "Article (1)", 30), line(1, 3, "Definitions of terms", 31, 300, 500), line(1, 4, "3", 30, 560, 570), line(1, 5, "Article (2-4)", 50), line(1, 6, "Scope 4-5", 50, 300, 500),
        line(2, 1, "Law No. (5) of 2020", 10, size=14.0), line(2, 2, "Article (1)", 30, bold=True), line(2, 3, "►Definitions", 45, bold=True), body(2, 4, "In this law the term", 60), line(2, 5, ":", 61, 255, 259), body(2, 6, "means what it says in accordance with Article (9).", 75),
        line(2, 7, "►Scope", 90, bold=True), body(2, 8, "This law applies to all.", 105), line(2, 9, "page 2 of 9", 780), line(2, 10, "tiny note", 770, size=6.0), line(2, 11, "► ●", 110),
        line(3, 1, "Article (3)", 10, bold=True), body(3, 2, "Third text.", 30), line(3, 3, "Article (3)", 50, bold=True), body(3, 4, "Restated third.", 70), line(3, 5, "Cabinet Resolution No. (1) of 2022", 90, size=12.0), line(3, 6, "Article (1)", 110, bold=True), body(3, 7, "Resolved.", 130),
    ]
    lines = spark.createDataFrame(rows, LINE)
    found = layout.articles(lines, spark.createDataFrame([("d", "Law No. (5) of 2020")], "doc_id string, doc_title string")).orderBy("part_ordinal", "article_no").collect()
    assert [(r["part_ordinal"], r["article_no"], r["title"], r["text"], r["inferred"]) for r in found] == [
        (1, 1, "Definitions", "In this law the term: means what it says in accordance with Article (9).", False), (1, 2, "Scope", "This law applies to all.", True), (1, 3, "", "Third text.", False),
        (2, 3, "", "Restated third.", False), (3, 1, "Cabinet Resolution No. (1) of 2022", "Resolved.", False),
    ]
    assert found[0]["part_id"] == "law-no-5-of-2020-1" and found[-1]["part_id"] == "cabinet-resolution-no-1-of-2022-3"
    shape = layout.body_layout(lines)
    contents = lines.join(layout.contents_pages(lines, shape), ["doc_id", "page"], "left_semi").withColumn("side", F.lit(0))
    entries = layout.contents_entries(layout.grouped_rows(contents))
    assert sorted((r["article_no"], r["title"]) for r in entries.collect()) == [(1, "Definitions of terms"), (2, "Scope"), (3, "Scope"), (4, "Scope")]
    titled, differences = layout.reconciled(spark.createDataFrame(found), entries)
    assert {(r["part_ordinal"], r["article_no"]): r["title"] for r in titled.collect()}[1, 1] == "Definitions of terms"
    assert [tuple(r)[1:] for r in differences.collect()] == [(1, 4, "missing in body")]
    d = layout.require_articles(layout.parse_diagnostics(lines, spark.createDataFrame(found), entries, differences)).first()
    assert (d["articles"], d["parts_detected"], d["inferred_headings"], d["duplicate_article_splits"], d["contents_pages_skipped"], d["contents_entries_seen"], d["contents_missing_in_body"], d["contents_check_passed"]) == (5, 3, 1, 1, 1, 4, 1, False)
    assert d["furniture_lines_dropped"] == 3
    with pytest.raises(Exception, match="no articles were extracted"):
        layout.require_articles(spark.createDataFrame([("e", 0)], "doc_id string, articles long")).collect()
    carried = layout.with_sections(titled).orderBy("part_ordinal", "article_no").collect()
    assert [r["section"] for r in carried] == ["Definitions of terms", "Scope", "Scope", "", "Cabinet Resolution No. (1) of 2022"]


def test_columns_rows_and_glyphs(spark):
    two = [line(1, i, f"left {i}", 10.0 * i, 40, 250) for i in (1, 2)] + [line(1, i + 2, f"right {i}", 10.0 * i, 320, 540) for i in (1, 2)]
    one = [(*r[:1], 2, *r[2:]) for r in two] + [line(2, 9, "across the page", 5, 100, 500)]
    order = layout.reading_order(spark.createDataFrame(two + one, LINE)).orderBy("page", "pos").collect()
    assert [r["text"] for r in order if r["page"] == 1] == ["left 1", "left 2", "right 1", "right 2"]
    assert [r["text"] for r in order if r["page"] == 2] == ["across the page", "left 1", "right 1", "left 2", "right 2"]
    rows = spark.createDataFrame([("d", 1, 0, float(y), 0.0, str(y)) for y in (0, 2, 3, 4, 6.5, 7, 10.5)], "doc_id string, page int, side int, y0 double, x0 double, text string")
    assert [r["row_no"] for r in layout.grouped_rows(rows).orderBy("y0").collect()] == [1, 1, 1, 2, 2, 2, 3]
    glyphs = [("T", 0.0, 5.0 + i * 0.01, 10.0) for i in range(6)] + [("T", 0.0, 9.0, 10.0)] * 4 + [("a", 0.0, 5.0, 10.0)] * 20 + [("1", 0.0, float(i), 10.0) for i in range(20)]
    (f,) = layout.glyph_findings(spark.createDataFrame(glyphs, "char string, x0 double, x1 double, size double")).collect()
    assert (f["char"], f["narrow_n"], f["wide_n"]) == ("T", 6, 4)
    span = spark.createDataFrame([([("T", 0.0, 9.0), ("e", 9.0, 14.0), ("T", 0.0, 6.0)], 10.0)], "chars array<struct<c:string,x0:double,x1:double>>, size double")
    assert span.select(layout.repaired_text(F.col("chars"), F.col("size"))).first()[0] == "TheT"


def docx(paragraphs, rows=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s: f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c, '')}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(p(*x) for x in paragraphs)}{table}</w:body></w:document>")
    return out.getvalue()


def test_extraction(spark):
    rows = [
        ("f/a.docx", docx([("Heading", "Heading2"), ("Body text", "")], [("x", "y")]), None), ("f/b.txt", "ﬁle​ text".encode(), None), ("f/c.html", b"<head><title>T &amp; U</title><style>x</style></head><p>a<br>b<script>no</script>", None),
        ("f/d.txt", b"%PDF-1.4", None), ("f/e.exe", b"MZ", None), ("f/f.txt", b"", None), ("f/g.png", b"\x89PNG", None), ("f/h", b"no suffix", None), ("f/i.txt", b"x" * 3000, None), ("f/j.txt", b" \n ", None), ("f/k.bin", b"z", "image/png"), ("f/l.docx", b"PK\x03\x04broken", None),
    ]
    df = spark.createDataFrame([(p, bytearray(c), t) for p, c, t in rows], "path string, content binary, content_type string")
    got = {r["path"][2:]: r for r in files.extract(df, EngineConfig(workspace_max_bytes=2000)).collect()}
    assert got["a.docx"]["text"] == "## Heading\n\nBody text\n\nx | y" and got["b.txt"]["text"] == "file text" and got["h"]["text"] == "no suffix"
    assert got["c.html"]["title"] == "T & U" and got["c.html"]["text"] == "a\nb"
    assert {k for k, r in got.items() if r["problem"]} == {"d.txt", "e.exe", "f.txt", "g.png", "i.txt", "j.txt", "k.bin", "l.docx"}
    assert got["d.txt"]["kind"] == "pdf" and got["k.bin"]["kind"] == "image"


def test_html_depth_rules():
    assert files.read_html("<nav>a<p>b</nav>c") == ("", "\nc")
    assert files.read_html("<nav>a<script>b")[1] == "" and files.read_html("</nav>x")[1] == "x"


def test_urls():
    assert all(files.url_problem(u) for u in ["http://127.0.0.1/", "http://10.0.0.1", "http://169.254.169.254/x", "http://[::1]/", "file:///etc/passwd", "ftp://a.b", "http://localhost", "http:///x"])
    assert files.url_problem("https://example.org/a") is None and files.url_problem("http://8.8.8.8") is None


def test_manifest(spark, tmp_path):
    (tmp_path / "sources.json").write_text('{"documents": [{"law_id": "a", "filename": "a.pdf", "sha256": "' + "0" * 64 + '"}, {"law_id": "b", "filename": "b.pdf", "sha256": "ff"}, {"law_id": "c", "filename": "c.pdf", "sha256": "00"}]}')
    docs = manifest.load_documents(spark, str(tmp_path / "sources.json"))
    found = spark.createDataFrame([("x/a.pdf", bytearray(b"1")), ("x/b.pdf", bytearray(b"2"))], "path string, content binary")
    assert sorted(map(tuple, manifest.digest_problems(found, docs).collect())) == [("b.pdf", "digest differs"), ("c.pdf", "missing")]
    pinned = manifest.pinned(docs, found)
    assert [r["filename"] for r in manifest.digest_problems(found, pinned).collect()] == ["c.pdf"]
    manifest.write_manifest(pinned, str(tmp_path / "m"))
    assert manifest.load_manifest(spark, str(tmp_path / "m")).count() == 3
    (tmp_path / "none.json").write_text('{"documents": []}')
    with pytest.raises(ValueError):
        manifest.load_documents(spark, str(tmp_path / "none.json"))


def test_index_build_is_repeatable_and_notices_stale_vectors(spark, tmp_path):
    df, path, config = articles(spark, ["one two three", "four five"]), str(tmp_path / "index"), EngineConfig(embedding_dim=8)
    report = build_index(df, path, config).collect()
    assert [(r["law_id"], r["chunks"], r["articles"]) for r in report] == [("l", 2, 2)]
    chunks = tables.load_chunks(spark, f"{path}/chunks")
    vectors = tables.load_vectors(spark, f"{path}/vectors", chunks, 8)
    assert vectors.count() == 2 and tables.load_vectors(spark, f"{path}/vectors", chunks, 9) is None and tables.load_vectors(spark, f"{path}/no", chunks, 8) is None
    ids = {r["chunk_id"] for r in chunks.collect()}
    build_index(articles(spark, ["one two three", "four five", "six"]), path, config)
    grown = tables.load_chunks(spark, f"{path}/chunks")
    assert ids < {r["chunk_id"] for r in grown.collect()} and tables.load_vectors(spark, f"{path}/vectors", grown, 8).count() == 3
    with pytest.raises(Exception, match="wrong length"):
        tables.write_vectors(tables.load_vectors(spark, f"{path}/vectors", grown, 8), str(tmp_path / "v"), 4)
    tables.write_chunks(grown, str(tmp_path / "j"), "json")
    assert tables.load_chunks(spark, str(tmp_path / "j"), "json").count() == 3
    assert tables.upserted(grown, grown.limit(1)).count() == 3


def test_contents_query_on_events_of_five_digits(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT event_id * 7 + 9000 AS event_id, * EXCLUDE event_id FROM '{DATA}/sf0.001/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    want = duckdb.sql(documents_queries.CONTENTS_SQL.replace("FROM events", f"FROM '{tmp_path}/events.parquet'")).fetchall()
    got = [tuple(r) for r in documents_queries.contents_entries(spark, str(tmp_path)).collect()]
    assert max(int(t.split()[-1]) for _, _, t in want if t != "Title of") > 9999 and sorted(got) == sorted(want)


def test_html_references_without_a_semicolon(spark):
    pages = spark.createDataFrame([(1, "<title>a&ampb &amp</title><p>x &lt;b&gt; &ampy &#65 &#66; &</p>tail &amp")], "page_id long, html string")
    read = lambda **how: tuple(pages.select(files.html_text(F.col("html"), **how).alias("r")).first()["r"])
    assert read(closed_only=True) == ("a&ampb &amp", "x <b> &ampy &#65 B &\ntail &amp")
    assert read() == ("a&b &", "x <b> &y A B &\ntail &")

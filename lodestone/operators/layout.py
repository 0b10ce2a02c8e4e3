"""From laid-out lines to articles: reading order, contents pages, segmentation, reconciliation.

Lines are (doc_id, page, page_width, block_id, text, x0, y0, x1, size, bold). All that is local to a line, block or page is
SQL; the article state machine runs per document, its natural unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions.text import corpus_normalised, has_letters_or_digits, slug


def repaired_text(chars: Column, size: Column) -> Column:
    """The text of a span's glyphs (array of struct c, x0, x1); a glyph that is too wide for its letter was a ligature."""
    wide = lambda c: (size > 0) & ((c["x1"] - c["x0"]) / size > fixed.WIDE_GLYPH_RATIO)
    repair = lambda c: F.when((c["c"] == "T") & wide(c), F.lit(fixed.LIGATURES["T"])).otherwise(c["c"])
    return F.array_join(F.transform(chars, repair), "")


def lines_of(spans: DataFrame) -> DataFrame:
    """Lines from spans (doc_id, page, page_width, block_id, line_id, span_id, text, x0, y0, x1, size, bold): joined, normalised, no empty ones."""
    key = ["doc_id", "page", "page_width", "block_id", "line_id"]
    joined = spans.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_id", "text"))), lambda s: s["text"]), "").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("size").alias("size"), F.max("bold").alias("bold"))
    return joined.withColumn("text", corpus_normalised(F.col("text"))).where("text <> ''").drop("line_id")


def band(y: Column) -> Column:
    return F.floor(y / fixed.ROW_QUANTUM)


def blocks(lines: DataFrame) -> DataFrame:
    """One row per block: its outer edges."""
    return lines.groupBy("doc_id", "page", "page_width", "block_id").agg(F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"))


def two_column_pages(lines: DataFrame) -> DataFrame:
    """(doc_id, page, two_columns): four narrow blocks at least, none across the gutter, some wholly on each side."""
    mid, margin = F.col("page_width") / 2, F.col("page_width") * fixed.GUTTER_RATIO
    narrow = (F.col("bx1") - F.col("bx0")) < F.col("page_width") * fixed.FULL_WIDTH_RATIO
    crossing = narrow & (F.col("bx0") < mid - margin) & (F.col("bx1") > mid + margin)
    per = blocks(lines).groupBy("doc_id", "page").agg(F.count_if(narrow).alias("n"), F.max(crossing).alias("x"), F.max(narrow & (F.col("bx1") <= mid)).alias("l"), F.max(narrow & (F.col("bx0") >= mid)).alias("r"))
    return per.select("doc_id", "page", ((F.col("n") >= fixed.MIN_COLUMN_BLOCKS) & ~F.col("x") & F.col("l") & F.col("r")).alias("two_columns"))


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines with ``pos`` from 1 on each page: by side where there are two columns, then row band, then left edge; lines within a block alike."""
    page = two_column_pages(lines)
    placed = lines.join(blocks(lines), ["doc_id", "page", "page_width", "block_id"]).join(page, ["doc_id", "page"])
    side = F.when(F.col("two_columns") & ((F.col("bx0") + F.col("bx1")) / 2 >= F.col("page_width") / 2), 1).otherwise(0)
    order = Window.partitionBy("doc_id", "page").orderBy("side", band(F.col("by0")), "bx0", "block_id", band(F.col("y0")), "x0")
    return placed.withColumn("side", side).withColumn("pos", F.row_number().over(order)).drop("bx0", "by0", "bx1", "side")


def body_layout(lines: DataFrame) -> DataFrame:
    """(doc_id, body_size, body_width): the size with most characters (the smaller on a tie), and the nearest-rank width of its lines."""
    size = F.round("size", 1)
    weight = lines.groupBy("doc_id", size.alias("s")).agg(F.sum(F.length("text")).alias("chars"))
    body = weight.groupBy("doc_id").agg(F.max_by("s", F.struct("chars", -F.col("s"))).alias("body_size"))
    own = lines.join(body, "doc_id").where(size == F.col("body_size")).withColumn("w", F.col("x1") - F.col("x0"))
    order, doc = Window.partitionBy("doc_id").orderBy("w"), Window.partitionBy("doc_id")
    own = own.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(doc))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * fixed.BODY_WIDTH_PERCENTILE))
    return own.groupBy("doc_id", "body_size").agg(F.max(F.when(F.col("i") == at, F.col("w"))).alias("body_width"))


def contents_pages(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """(doc_id, page) of pages with a contents heading in body size or larger."""
    return lines.join(layout, "doc_id").where(F.col("text").rlike(fixed.CONTENTS_HEADING) & (F.col("size") >= F.col("body_size"))).select("doc_id", "page").distinct()


def with_sides(lines: DataFrame) -> DataFrame:
    """Contents lines with ``side``: 1 for those right of the middle on a page where no line crosses the gutter and both sides have whole lines."""
    mid, margin, page = F.col("page_width") / 2, F.col("page_width") * fixed.GUTTER_RATIO, Window.partitionBy("doc_id", "page")
    crossing = F.max((F.col("x0") < mid - margin) & (F.col("x1") > mid + margin)).over(page)
    both = F.max(F.col("x1") <= mid).over(page) & F.max(F.col("x0") >= mid).over(page)
    return lines.withColumn("side", F.when(~crossing & both & ((F.col("x0") + F.col("x1")) / 2 >= mid), 1).otherwise(0))


def grouped_rows(lines: DataFrame) -> DataFrame:
    """Lines with ``row_no``: a line joins a row if its top is within 3 points of the row's first line.

    The rule looks back to an anchor, not to the neighbour, so it is a fold over a column's sorted lines. Lines hold doc_id, page, side.
    """
    item = F.struct("y0", "x0", "text")
    column = lines.groupBy("doc_id", "page", "side").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(-1e18).alias("anchor"), F.lit(0).alias("row"), F.array().cast("array<struct<row:int,x0:double,y0:double,text:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        same = F.abs(acc["anchor"] - x["y0"]) <= fixed.ROW_TOLERANCE
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        placed = F.struct(row.cast("int").alias("row"), x["x0"].cast("double").alias("x0"), x["y0"].cast("double").alias("y0"), x["text"].alias("text"))
        return F.struct(F.when(same, acc["anchor"]).otherwise(x["y0"].cast("double")).alias("anchor"), row.cast("int").alias("row"), F.array_append(acc["out"], placed).alias("out"))

    folded = column.withColumn("out", F.aggregate("items", start, step)["out"])
    return folded.select("doc_id", "page", "side", F.explode("out").alias("o")).select("doc_id", "page", "side", F.col("o.row").alias("row_no"), F.col("o.x0").alias("x0"), F.col("o.y0").alias("y0"), F.col("o.text").alias("text"))


def contents_entries(rows: DataFrame) -> DataFrame:
    """(doc_id, page, article_no, title) of contents rows; a span ``Article (58-64)`` gives an entry for each number."""
    cells = rows.groupBy("doc_id", "page", "side", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: F.trim(x["text"])).alias("cells"))
    is_label = lambda t: t.rlike(fixed.CONTENTS_ENTRY)
    labels = F.filter("cells", is_label)
    cells = cells.withColumn("label", F.try_element_at(labels, F.lit(1))).where("label IS NOT NULL")
    place = F.array_position("cells", F.col("label"))
    rest = F.filter(F.slice("cells", (place + 1).cast("int"), F.size("cells")), lambda t: ~t.rlike(fixed.PAGE_FURNITURE) & ~t.rlike(fixed.CONTENTS_PAGE_CELL) & ~is_label(t))
    bare = F.filter(F.transform(rest, lambda t: F.trim(F.regexp_replace(t, f"^[{fixed.TITLE_MARKERS}]+", ""))), lambda t: t != "")
    title = corpus_normalised(F.array_join(bare, " "))
    cut = F.trim(F.regexp_replace(title, fixed.CONTENTS_TRAILING_PAGE, ""))
    first = F.regexp_extract("label", fixed.CONTENTS_ENTRY, 1).cast("int")
    last = F.coalesce(F.nullif(F.regexp_extract("label", fixed.CONTENTS_ENTRY, 2), F.lit("")).cast("int"), first)
    rows = cells.select("doc_id", "page", F.when(cut.rlike(r"\p{L}"), cut).otherwise(title).alias("title"), first.alias("first"), last.alias("last"))
    rows = rows.where(f"last >= first AND last - first <= {fixed.MAX_CONTENTS_SPAN}")
    return rows.select("doc_id", "page", F.explode(F.sequence("first", "last")).alias("article_no"), "title")


def looks_like_title(text: Column, x0: Column, x1: Column, size: Column, bold: Column, page_width: Column, body_size: Column, body_width: Column) -> Column:
    """A short line that names the article beside it: not justified, and bold, larger, marked, or centred and narrow."""
    bare, width = F.trim(F.regexp_replace(F.trim(text), f"^[{fixed.TITLE_MARKERS}]+", "")), x1 - x0
    fits = (bare != "") & (F.length(bare) <= fixed.MAX_TITLE_CHARS) & ~bare.rlike("[.;:,]$") & ~bare.rlike(fixed.ARTICLE_HEADING) & ~bare.rlike(fixed.PAGE_FURNITURE) & has_letters_or_digits(bare) & (width < body_width * fixed.JUSTIFIED_RATIO)
    centred = (F.abs((x0 + x1) / 2 - page_width / 2) < page_width * fixed.CENTRED_RATIO) & (width < body_width * fixed.CENTRED_WIDTH_RATIO)
    return fits & (bold | (size > body_size) | text.rlike(f"^[{fixed.TITLE_MARKERS}]") | centred)


def classified(ordered: DataFrame, layout: DataFrame) -> DataFrame:
    """Ordered lines with ``kind``: furniture, joiner, noise, heading, instrument or body; heading_no; is_title; title_after and title_before.

    The kinds are tested in this order. Titles of neighbours, and the next heading on the page, are looked up by windows.
    """
    rows = ordered.join(layout, "doc_id")
    bare, size = F.trim("text"), F.col("size")
    furniture = (size < F.col("body_size") * fixed.FURNITURE_RATIO) | bare.rlike(fixed.PAGE_FURNITURE)
    kind = (
        F.when(furniture, "furniture").when(bare.rlike("^[:;]$"), "joiner").when(~has_letters_or_digits(bare), "noise").when(bare.rlike(fixed.ARTICLE_HEADING), "heading")
        .when(bare.rlike(fixed.INSTRUMENT_TITLE) & (size >= F.col("body_size")), "instrument").otherwise("body")
    )
    number = F.regexp_extract(bare, fixed.ARTICLE_HEADING, 1).try_cast("int")
    title = looks_like_title(F.col("text"), F.col("x0"), F.col("x1"), size, F.col("bold"), F.col("page_width"), F.col("body_size"), F.col("body_width")) & (size >= F.col("body_size") * fixed.FURNITURE_RATIO)
    rows = rows.withColumn("kind", kind).withColumn("heading_no", number).withColumn("is_title", title)
    rows = rows.withColumn("bare", F.trim(F.regexp_replace(bare, f"^[{fixed.TITLE_MARKERS}]+", ""))).withColumn("marked", F.col("text").rlike(f"^[{fixed.TITLE_MARKERS}]"))
    page = Window.partitionBy("doc_id", "page").orderBy("pos")
    named = F.when(F.col("is_title"), F.col("bare"))
    rows = rows.withColumn("near_title", F.coalesce(F.lead(named).over(page), F.lag(named).over(page), F.lit("")))
    return rows.withColumn("next_heading", F.first("heading_no", ignorenulls=True).over(page.rowsBetween(1, Window.unboundedFollowing)))


ARTICLES = "doc_id string, part_ordinal int, part_title string, article_no int, title string, text string, page_start int, page_end int, inferred boolean"


def instrument_of(text: str) -> tuple | None:
    found = re.search(fixed.INSTRUMENT_KEY.removeprefix("(?i)"), text, re.IGNORECASE)
    return found and (re.sub(r"[\s-]+", "", found[1]).lower(), int(found[2]), int(found[3]))


class PartState:
    """Which part of a document is open: a new instrument, or a number that the part already has, opens the next."""

    def __init__(self, title: str):
        self.title, self.key, self.ordinal, self.open_key, self.seen = title, instrument_of(title), 0, (), set()

    def enter(self, number: int) -> None:
        if self.ordinal == 0 or self.open_key != self.key or number in self.seen:
            self.ordinal, self.open_key, self.open_title, self.seen = self.ordinal + 1, self.key, self.title, set()
        self.seen.add(number)


def segmented(doc_title: str, rows: Iterator[tuple]) -> list[dict]:
    """Articles of one document's classified lines, (page, kind, text, bare, heading_no, near_title, marked, is_title, next_heading) in order."""
    out: list[dict] = []
    parts, article = PartState(doc_title), None

    def start(number: int, title: str, page: int, inferred: bool) -> dict:
        parts.enter(number)
        out.append({"part_ordinal": parts.ordinal, "part_title": parts.open_title, "article_no": number, "title": title, "body": [], "page_start": page, "page_end": page, "inferred": inferred})
        return out[-1]

    for page, kind, text, bare, number, near, marked, is_title, following in rows:
        if kind == "joiner":
            if article and article["body"]:
                article["body"][-1] += text.strip()
        elif kind == "heading":
            article = start(int(number), near, page, False)
        elif kind == "instrument":
            key = instrument_of(text.strip())
            if key and key != parts.key:
                article, parts.key, parts.title = None, key, text.strip()
        elif kind == "body" and article is not None:
            if article["title"] and not article["body"] and bare == article["title"]:
                continue
            ahead = article["article_no"] + 1
            if article["body"] and marked and is_title and ahead not in parts.seen and (pd.isna(following) or following > ahead):
                article = start(ahead, bare, page, True)
            else:
                article["body"].append(text)
                article["page_end"] = max(article["page_end"], page)
    for a in out:
        a["text"] = re.sub(r"\s{2,}", " ", " ".join(a.pop("body"))).strip()
    return [a for a in out if a["text"]]


def articles(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Articles of all documents; ``titles`` is (doc_id, doc_title). Contents pages are left out; part_id is slug and ordinal."""
    layout = body_layout(lines)
    ordered = reading_order(lines).join(contents_pages(lines, layout), ["doc_id", "page"], "left_anti")
    rows = classified(ordered, layout).where("kind NOT IN ('furniture', 'noise')").join(titles, "doc_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "pos"])
        names = ["page", "kind", "text", "bare", "heading_no", "near_title", "marked", "is_title", "next_heading"]
        found = segmented(pdf["doc_title"].iloc[0], pdf[names].itertuples(index=False, name=None))
        return pd.DataFrame([{"doc_id": pdf["doc_id"].iloc[0], **a} for a in found], columns=[c.split()[0] for c in ARTICLES.split(", ")])

    out = rows.groupBy("doc_id").applyInPandas(run, ARTICLES)
    return out.withColumn("part_id", F.concat(slug(F.col("part_title")), F.lit("-"), F.col("part_ordinal").cast("string")))


def reconciled(found: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles with official titles, differences): the k-th contents page belongs to the k-th part.

    Differences are (doc_id, part_ordinal, article_no, problem): missing in the body, or extra there, for parts that have a contents page.
    """
    nth = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page")).alias("part_ordinal")
    listed = entries.select("doc_id", nth, "article_no", F.col("title").alias("official"))
    listed = listed.groupBy("doc_id", "part_ordinal", "article_no").agg(F.max(F.nullif(F.col("official"), F.lit(""))).alias("official"))
    key = ["doc_id", "part_ordinal", "article_no"]
    titled = found.join(listed, key, "left").withColumn("title", F.coalesce("official", "title")).drop("official")
    parts = listed.select("doc_id", "part_ordinal").distinct().join(found.select("doc_id", "part_ordinal").distinct(), ["doc_id", "part_ordinal"], "left_semi")
    own = lambda df: df.select(*key).join(parts, ["doc_id", "part_ordinal"], "left_semi")
    missing = own(listed).join(found, key, "left_anti").withColumn("problem", F.lit("missing in body"))
    extra = own(found).join(listed, key, "left_anti").withColumn("problem", F.lit("extra in body"))
    return titled, missing.unionByName(extra)


def with_sections(found: DataFrame, order: str = "article_no") -> DataFrame:
    """Articles with ``section``: the last title so far within their part."""
    part = Window.partitionBy("doc_id", "part_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("section", F.coalesce(F.last(F.nullif(F.col("title"), F.lit("")), ignorenulls=True).over(part), F.lit("")))


def glyph_findings(glyphs: DataFrame) -> DataFrame:
    """(char, narrow_n, low, wide_n, high, gap): letters whose width over size falls into two distant clusters."""
    ratio = (F.col("x1") - F.col("x0")) / F.when(F.col("size") == 0, 1.0).otherwise(F.col("size"))
    rows = glyphs.where(F.col("char").rlike(r"^\p{L}$")).select("char", ratio.alias("r"))
    order = Window.partitionBy("char").orderBy("r")
    rows = rows.withColumn("before", F.lag("r").over(order)).withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("char")))
    steps = rows.where("before IS NOT NULL").groupBy("char", "n").agg(F.max(F.struct((F.col("r") - F.col("before")).alias("gap"), F.col("before").alias("low"), F.col("r").alias("high"), F.col("i").alias("i"))).alias("m"))
    out = steps.select("char", (F.col("m.i") - 1).cast("long").alias("narrow_n"), "m.low", (F.col("n") - F.col("m.i") + 1).cast("long").alias("wide_n"), "m.high", "m.gap", "n")
    return out.where((F.col("n") >= fixed.GLYPH_SAMPLES) & (F.col("gap") >= fixed.GLYPH_GAP) & (F.col("narrow_n") >= fixed.GLYPH_CLUSTER) & (F.col("wide_n") >= fixed.GLYPH_CLUSTER)).drop("n")


def parse_diagnostics(lines: DataFrame, found: DataFrame, entries: DataFrame, differences: DataFrame) -> DataFrame:
    """Per document: lines dropped, contents pages and entries, parts, duplicate splits, inferred headings, differences, and whether the contents check passed."""
    layout = body_layout(lines)
    pages = contents_pages(lines, layout)
    body = lines.join(pages, ["doc_id", "page"], "left_anti")
    dropped = classified(reading_order(body), layout).where("kind IN ('furniture', 'noise')").groupBy("doc_id").agg(F.count("*").alias("furniture_lines_dropped"))
    parts = found.groupBy("doc_id").agg(F.count_distinct("part_id").alias("parts_detected"), F.count_if("inferred").alias("inferred_headings"), F.count("*").alias("articles"))
    # A part that begins with the title of the one before it was opened by a repeated number.
    one = found.select("doc_id", "part_ordinal", "part_title").distinct()
    before = F.lag("part_title").over(Window.partitionBy("doc_id").orderBy("part_ordinal"))
    splits = one.withColumn("again", F.coalesce(before == F.col("part_title"), F.lit(False))).groupBy("doc_id").agg(F.count_if("again").alias("duplicate_article_splits"))
    skipped = pages.groupBy("doc_id").agg(F.count("*").alias("contents_pages_skipped"))
    seen = entries.groupBy("doc_id").agg(F.count_distinct("page", "article_no").alias("contents_entries_seen"))
    wrong = differences.groupBy("doc_id").agg(F.count_if(F.col("problem") == "missing in body").alias("contents_missing_in_body"), F.count_if(F.col("problem") == "extra in body").alias("contents_extra_in_body"))
    out = lines.select("doc_id").distinct()
    for part in (dropped, parts, splits, skipped, seen, wrong):
        out = out.join(part, "doc_id", "left")
    out = out.na.fill(0)
    return out.withColumn("contents_check_passed", (F.col("contents_missing_in_body") == 0) & (F.col("contents_extra_in_body") == 0))


def require_articles(diagnostics: DataFrame) -> DataFrame:
    """``diagnostics``, with a failure at run time for a document that gave no article: its layout no longer fits the rules."""
    some = F.col("articles") > 0
    return diagnostics.where(F.when(some, True).otherwise(F.raise_error(F.concat(F.lit("no articles were extracted from "), F.col("doc_id").cast("string"))).cast("boolean")))

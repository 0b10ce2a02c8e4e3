"""From laid-out files to the articles that the index build takes: layout, segmentation, contents, sections, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import layout
from lodestone.sources.scratch import stored


def parse_corpus(spans: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles for ``build_index``, diagnostics per document) of the files that the manifest declares.

    Spans are those of ``sources.pdf.spans`` with the law_id as doc_id; the manifest holds law_id, label and title. A declared file without spans,
    and one that gives no article, fail at run time: a layout that no longer fits the rules must not pass as an empty law.
    """
    declared = manifest.select(F.col("law_id").alias("doc_id"), F.col("label").alias("law_label"), F.col("title").alias("law_title"))
    own = spans.join(declared.select("doc_id"), "doc_id", "left_semi")
    lines = stored(layout.lines_of(own), "lines")
    found = stored(layout.articles(lines, declared.select("doc_id", F.col("law_title").alias("doc_title"))), "articles")
    contents = lines.join(layout.contents_pages(lines, layout.body_layout(lines)), ["doc_id", "page"], "left_semi")
    entries = layout.contents_entries(layout.grouped_rows(layout.with_sides(contents)))
    titled, differences = layout.reconciled(found, entries)
    told = layout.parse_diagnostics(lines, found, entries, differences)
    told = declared.select("doc_id").join(told, "doc_id", "left").na.fill(0).withColumn("contents_check_passed", F.coalesce("contents_check_passed", F.lit(False)))
    ready = layout.with_sections(titled).join(declared, "doc_id").select(
        F.col("doc_id").alias("law_id"), "law_label", "law_title", "part_id", "part_title", "article_no", "title", "section", "text", "page_start", "page_end"
    )
    return ready, layout.require_articles(told)

"""Laid-out spans and page images of PDF files, behind the optional library ``fitz``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import corpus_normalised
from lodestone.operators.layout import repaired_text

OCR_DPI = 200
BOLD_FLAG = 16
SPAN = "doc_id string, page int, page_width double, block_id int, line_id int, span_id int, chars array<struct<c:string,x0:double,x1:double>>, x0 double, y0 double, x1 double, size double, bold boolean"


def library() -> Any:
    try:
        import fitz
    except ImportError as e:
        raise ValueError("no PDF library is installed") from e
    return fitz


def opened(data: bytes, open_: Callable | None = None) -> Any:
    document = (open_ or library().open)(stream=data, filetype="pdf")
    if document.needs_pass:
        raise ValueError("the PDF is password protected")
    return document


def page_texts(data: bytes, most: int, open_: Callable | None = None) -> tuple[list[str], bool]:
    """(texts of the first ``most`` pages, whether there are more)."""
    with opened(data, open_) as document:
        n = min(document.page_count, most)
        return [document[i].get_text("text") for i in range(n)], document.page_count > n


def page_images(data: bytes, most: int, open_: Callable | None = None) -> Iterator[bytes]:
    """The first ``most`` pages as PNG images, one at a time, for OCR."""
    with opened(data, open_) as document:
        for i in range(min(document.page_count, most)):
            yield document[i].get_pixmap(dpi=OCR_DPI).tobytes("png")


def page_spans(doc_id: str, data: bytes, open_: Callable | None = None) -> Iterator[tuple]:
    """The rows of ``SPAN``: each span of the text blocks with its glyphs and geometry."""
    with opened(data, open_) as document:
        for number in range(document.page_count):
            page = document[number]
            blocks = [b for b in page.get_text("rawdict")["blocks"] if b.get("type", 0) == 0]
            for b, block in enumerate(blocks):
                for k, line in enumerate(block["lines"]):
                    for s, span in enumerate(line["spans"]):
                        glyphs = [{"c": c["c"], "x0": float(c["bbox"][0]), "x1": float(c["bbox"][2])} for c in span["chars"]]
                        x0, y0, x1 = (float(v) for v in span["bbox"][:3])
                        bold = bool(span["flags"] & BOLD_FLAG) or "bold" in span["font"].lower()
                        yield doc_id, number + 1, float(page.rect.width), b, k, s, glyphs, x0, y0, x1, float(span["size"]), bold


def spans(files: DataFrame) -> DataFrame:
    """Spans of (doc_id, content) PDF files, ready for ``layout.lines_of``: ligatures repaired, texts normalised. A file that can't be read fails the job."""
    names = [c.split()[0] for c in SPAN.split(", ")]
    glyph = pa.list_(pa.struct([("c", pa.string()), ("x0", pa.float64()), ("x1", pa.float64())]))
    types = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), glyph, *[pa.float64()] * 4, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(page_spans(doc_id, data))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    found = files.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, SPAN)
    return found.withColumn("text", corpus_normalised(repaired_text(F.col("chars"), F.col("size")))).drop("chars")

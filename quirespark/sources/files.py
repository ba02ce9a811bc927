"""Files as rows, and their documents parsed into element tables inside Python workers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_kind

#: One wide table for all that a document yields; `kind` tells which columns count:
#: text, path, image, shading (elements), page (w, h, rot), info and outline (text, level), note (text), error (text).
POINTS = "array<struct<pts:array<struct<x:double,y:double>>,curves:boolean,closed:boolean,is_rect:boolean,n_ctrl:int>>"
PATTERN = "struct<kind:string,stops:array<struct<t:double,color:string>>>"
ELEMENTS = f"""doc_id string, page_no int, seq long, kind string, x0 double, y0 double, x1 double, y1 double, hidden boolean, invisible boolean, clip_x0 double, clip_y0 double, clip_x1 double, clip_y1 double,
  text string, size double, rot double, font string, bold boolean, italic boolean, color string, alpha double, bad int, font_top double, font_bottom double,
  subpaths {POINTS}, fill string, stroke string, pattern {PATTERN}, line_width double, dash boolean, fill_alpha double, stroke_alpha double, blend string, soft_mask boolean,
  pix_w int, pix_h int, format string, mask boolean, resource string, annotation string, w double, h double, level int, name string"""


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), kind and content of files; images beside documents are their assets."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), file_kind("path").alias("kind"), "length", "content")


#: What damaged files can raise in a parser.
DAMAGE = (ValueError, TypeError, IndexError, KeyError, AttributeError, ZeroDivisionError, OverflowError, RecursionError, LookupError)


def pdf_rows(doc_id: str, data: bytes, annotations: bool = True) -> Iterator[dict]:
    """All rows of one PDF; what can't be read of it is an error row, and the rest is there."""
    from . import pdf, pdfpage

    try:
        doc = pdf.Document(data)
        pages = doc.pages()
    except DAMAGE as e:
        yield {"doc_id": doc_id, "kind": "error", "text": str(e) or type(e).__name__}
        return
    if not pages:
        yield {"doc_id": doc_id, "kind": "error", "text": "no pages"}
    fonts: dict = {}
    for n, page in enumerate(pages, 1):
        try:
            reader = pdfpage.Page(doc, page, fonts, annotations)
            rows = [{"doc_id": doc_id, "page_no": n, "kind": "page"} | reader.run()]
        except DAMAGE as e:
            yield {"doc_id": doc_id, "page_no": n, "kind": "error", "text": f"page {n}: {type(e).__name__}"}
            continue
        yield from rows
        for row in reader.rows:
            clip = row.pop("clip")
            yield row | {"doc_id": doc_id, "page_no": n, "clip_x0": clip[0], "clip_y0": clip[1], "clip_x1": clip[2], "clip_y1": clip[3]}
    try:
        about = [{"kind": "info", "name": k, "text": v} for k, v in doc.info().items() if v] + [{"kind": "outline", "seq": i, "level": level, "text": title} for i, (level, title) in enumerate(doc.outline())]
    except DAMAGE as e:
        about = [{"kind": "error", "text": f"outline: {type(e).__name__}"}]
    yield from ({"doc_id": doc_id} | row for row in about)
    for i, note in enumerate(doc.notes):
        yield {"doc_id": doc_id, "kind": "note", "seq": i, "text": note}


def _batched(rows: Iterator[dict], size: int = 5000) -> Iterator[pd.DataFrame]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield frame(held, ELEMENTS)
            held = []
    if held:
        yield frame(held, ELEMENTS)


def frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """rows with the columns of a schema's text; what a row lacks is null."""
    while "<" in schema:
        schema = re.sub(r"<[^<>]*>", "", schema)
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in (part.split()[0] for part in schema.split(","))})


def pdf_elements(files: DataFrame, annotations: bool = True) -> DataFrame:
    """ELEMENTS of files(doc_id, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                yield from _batched(pdf_rows(doc_id, bytes(content), annotations) if content is not None else iter([{"doc_id": doc_id, "kind": "error", "text": "no content"}]))

    return files.select("doc_id", "content").mapInPandas(parse, ELEMENTS)

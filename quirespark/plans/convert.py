"""Files of mixed kinds to structured text: dispatch by extension, a row for each file, errors as text. Also a command line."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cut import cut
from ..sources import files, mail, pptx
from . import html, pdf
from . import pptx as deck


def convert(inputs: DataFrame, opt: pdf.Options = pdf.Options()) -> DataFrame:  # noqa: B008
    """doc_id and text of inputs(doc_id, kind, content); images are assets of the HTML files, by name."""
    pdfs = pdf.document_text(cut(files.pdf_elements(inputs.where("kind = 'pdf'")), "pdf-elements"), opt)
    decks = deck.document_text(cut(pptx.deck_elements(inputs.where("kind = 'pptx'")), "deck-elements"))
    read = cut(mail.mails(inputs.where("kind = 'html'")), "mails")
    own = read.select("doc_id", F.explode("assets").alias("a")).select("doc_id", "a.key", "a.data_url")
    beside = inputs.where("kind = 'image'").select(F.regexp_extract("doc_id", r"^(.*/)", 1).alias("folder"), F.regexp_extract("doc_id", r"([^/]*)$", 1).alias("key"), F.concat(F.lit("data:image/"), F.lower(F.regexp_extract("doc_id", r"\.([^.]*)$", 1)), F.lit(";base64,"), F.base64("content")).alias("data_url"))
    near = read.select("doc_id", F.regexp_extract("doc_id", r"^(.*/)", 1).alias("folder")).join(beside, "folder").select("doc_id", "key", "data_url")
    pages = html.document_text(read.where("error is null").select("doc_id", "html", "subject", "sender"), own.unionByName(near))
    failed = read.where("error is not null").select("doc_id", F.concat(F.lit("错误: "), "error").alias("text"))
    other = inputs.where("kind in ('ppt-unsupported', 'other')").select("doc_id", F.concat(F.lit("错误: 不支持的格式 "), "kind").alias("text"))
    return pdfs.unionByName(decks).unionByName(pages).unionByName(failed).unionByName(other)


def main(args: list[str]) -> int:
    """python -m quirespark.plans.convert INPUT_FOLDER OUTPUT_FOLDER: a table of texts; 1 if a file failed."""
    spark = SparkSession.builder.appName("convert").getOrCreate()
    out = convert(files.read_files(spark, args[0]))
    out.write.mode("overwrite").parquet(args[1])
    return int(not spark.read.parquet(args[1]).where(F.col("text").startswith("错误: ")).isEmpty())


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

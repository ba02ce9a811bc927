"""HTML and mail to structured text: read, sanitize, resolve, walk, classify tables, write.

Boxes would need a browser; elements come in document order instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import html as ops
from ..operators.cut import cut
from ..sources import mail


def neutralize(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """pages(doc_id, html) with image sources from assets(doc_id, key, data_url), others out of reach (data-blocked), style urls emptied; and blocked, resolved, missing counted."""
    source = r"(?is)<img\b[^>]*?\ssrc\s*=\s*[\"']([^\"']*)[\"']"
    urls = pages.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(source), F.lit(1)))).alias("url"))
    found = ops.resolve(urls, assets)
    per = found.groupBy("doc_id").agg(F.collect_list(F.struct("url", "data_url")).alias("_urls"), *[F.count_if(F.col("status") == s).alias(s) for s in ("blocked", "resolved", "missing")])  # those of one page
    out = pages.join(per, "doc_id", "left")
    src = lambda u: F.concat(F.lit(' src="'), u, F.lit('"'))
    swapped = F.aggregate(
        F.coalesce("_urls", F.array().cast("array<struct<url:string,data_url:string>>")), F.col("html"),
        lambda h, u: F.replace(F.replace(h, F.concat(F.lit(" src='"), u["url"], F.lit("'")), src(u["url"])), src(u["url"]), F.when(u["data_url"].isNotNull(), src(F.coalesce(u["data_url"], F.lit("")))).otherwise(F.concat(F.lit(' data-blocked="'), u["url"], F.lit('"')))),
    )
    html = F.regexp_replace(swapped, r"(?i)url\(\s*(?!data:)[^)]*\)", "none")
    return out.withColumn("html", html).drop("_urls").fillna(0, ["blocked", "resolved", "missing"])


def document_text(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """doc_id and text of pages(doc_id, html, subject, sender)."""
    clean = cut(neutralize(ops.sanitize(pages), assets), "clean-pages")
    items = cut(mail.structure(clean), "items")
    cells = items.where("kind = 'cell'")
    data = ops.classify_tables(cells.select("doc_id", "table_id", "row", "text", "is_header", "bordered", "nested")).where("is_data")
    row = cells.join(data.select("doc_id", "table_id", "confidence"), ["doc_id", "table_id"]).groupBy("doc_id", "table_id", "confidence", "row").agg(F.min("seq").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: F.concat(F.lit('"'), x["text"], F.lit('"'))), " | ").alias("t"))
    tables = row.groupBy("doc_id", "table_id", "confidence").agg(F.min("seq").alias("seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "t"))), lambda x: F.concat(F.lit("  第"), (x["row"] + 1).cast("string"), F.lit("行: "), x["t"])), "\n").alias("body"))
    tables = tables.select("doc_id", "seq", F.concat(F.lit("表格 [推断 置信度"), F.format_number("confidence", 2), F.lit("]\n"), "body").alias("t"))
    runs = F.array_join(F.transform("runs", lambda r: F.concat(F.lit('  · "'), r["text"], F.lit('"'), F.when(r["bold"], " 粗体").otherwise(""), F.when(r["italic"], " 斜体").otherwise(""), F.coalesce(F.concat(F.lit(" 链接 "), r["href"]), F.lit("")))), "\n")
    paras = items.where("kind = 'paragraph'").select("doc_id", "seq", F.concat(F.lit("文本块 ("), "tag", F.lit(")\n"), runs).alias("t"))
    images = items.where("kind = 'image'").select("doc_id", "seq", F.concat(F.lit("图片"), F.when(F.col("blocked"), "（外部资源，已阻止）").otherwise("")).alias("t"))
    all_ = paras.unionByName(tables).unionByName(images)
    body = all_.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x, i: F.concat(F.lit("### ["), (i + 1).cast("string"), F.lit("] "), x["t"])), "\n\n").alias("body"))
    head = F.concat_ws("\n", F.concat(F.lit("# HTML 结构化描述："), "doc_id"), F.concat(F.lit("主题: "), F.nullif("subject", F.lit(""))), F.concat(F.lit("发件人: "), F.nullif("sender", F.lit(""))), F.when(F.col("blocked") > 0, F.concat(F.lit("已阻止外部资源: "), F.col("blocked").cast("string"))))
    return clean.join(body, "doc_id", "left").select("doc_id", F.concat_ws("\n", head, F.lit(""), "body").alias("text"))

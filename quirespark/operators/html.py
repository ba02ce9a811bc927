"""HTML sanitizing, in the order in which its rules depend on each other, with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that go with what is in them, tags that go alone, prefixes of office markup.
PAIRED = ["script", "noscript", "iframe", "frame", "frameset", "object", "embed", "applet", "form"]
SINGLE = ["script", "iframe", "object", "embed", "applet", "link", "base", "meta"]
OFFICE = r"(?i)</?(?:v|o|w|m|x|st1):[a-z0-9_-]+\b[^>]*>"
REVEAL = [r"(?is)<!--\[if[^\]]*\]>\s*<!-->", r"(?is)<!--\s*<!\[endif\]-->"]
CONDITIONAL = r"(?is)<!--\[if.*?<!\[endif\]-->"
PAIRED_PATTERN = r"(?is)<(" + "|".join(PAIRED) + r")\b.*?</\1\s*>"
SINGLE_PATTERN = r"(?is)<(" + "|".join(SINGLE) + r")\b[^>]*>"
ON_ATTRIBUTE = r"(?is)\son[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)"
SCRIPT_LINK = r"(?is)\s(?:href|action)\s*=\s*([\"'])\s*javascript:.*?\1"
SRCSET = r"(?is)\ssrcset\s*=\s*([\"']).*?\1"
IMPORT = r"(?is)@import[^;]+;"


def sanitize(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `html` cleaned and mso_blocks, blocked_scripts, office_tags, blocked_imports counted.

    Markers that reveal their content to other readers are unwrapped first; else the conditional
    rule would take the content with it. An unclosed script tag only loses its tag.
    """
    out = pages
    for pattern in REVEAL:
        out = out.withColumn(html, F.regexp_replace(html, pattern, ""))
    out = out.withColumn("mso_blocks", F.regexp_count(html, F.lit(CONDITIONAL)).cast("long")).withColumn(html, F.regexp_replace(html, CONDITIONAL, ""))
    out = out.withColumn("blocked_scripts", F.regexp_count(html, F.lit(PAIRED_PATTERN)).cast("long")).withColumn(html, F.regexp_replace(html, PAIRED_PATTERN, ""))
    out = out.withColumn("blocked_scripts", F.col("blocked_scripts") + F.regexp_count(html, F.lit(SINGLE_PATTERN))).withColumn(html, F.regexp_replace(html, SINGLE_PATTERN, ""))
    for pattern in (ON_ATTRIBUTE, SCRIPT_LINK):
        out = out.withColumn(html, F.regexp_replace(html, pattern, ""))
    out = out.withColumn("office_tags", F.regexp_count(html, F.lit(OFFICE)).cast("long")).withColumn(html, F.regexp_replace(html, OFFICE, ""))
    out = out.withColumn(html, F.regexp_replace(html, SRCSET, ""))
    return out.withColumn("blocked_imports", F.regexp_count(html, F.lit(IMPORT)).cast("long")).withColumn(html, F.regexp_replace(html, IMPORT, ""))


def resolve(urls: DataFrame, assets: DataFrame) -> DataFrame:
    """urls(doc_id, url) with data_url and status (data, resolved, blocked, missing).

    assets(doc_id, key, data_url) are met exactly, then as cid:, then by base name; what isn't met and is remote is blocked.
    """
    raw = F.regexp_replace(F.trim("url"), "^[\"']|[\"']$", "")
    bare = F.regexp_replace(F.col("raw"), r"(?i)^cid:", "")
    keyed = urls.withColumn("raw", raw).withColumn("cid", F.concat(F.lit("cid:"), bare)).withColumn("base", F.regexp_extract(F.regexp_replace(bare, r"\?.*$", ""), r"([^/\\]*)$", 1))
    unique = assets.groupBy("doc_id", "key").agg(F.min("data_url").alias("data_url"))
    for name in ("raw", "cid", "base"):
        keyed = keyed.join(unique.select("doc_id", F.col("key").alias(name), F.col("data_url").alias(f"by_{name}")), ["doc_id", name], "left")
    given = F.when(F.rlike("raw", F.lit("(?i)^data:")), F.col("raw"))
    found = F.coalesce("by_raw", "by_cid", "by_base")
    status = F.when(given.isNotNull(), "data").when(found.isNotNull(), "resolved").when(F.rlike("raw", F.lit("(?i)^(https?:|//)")), "blocked").otherwise("missing")
    return keyed.select(*urls.columns, F.coalesce(given, found).alias("data_url"), status.alias("status"))


def classify_tables(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, is_data, confidence from cells(doc_id, table_id, row, text, is_header, bordered, nested)."""
    per_row = cells.groupBy("doc_id", "table_id", "row").agg(F.count("*").alias("n"))
    size = per_row.groupBy("doc_id", "table_id").agg(F.count("*").alias("n_rows"), F.max("n").alias("n_cols"))
    signs = cells.groupBy("doc_id", "table_id").agg(F.max(F.col("is_header").cast("int")).alias("th"), F.max(F.col("nested").cast("int")).alias("nested"), F.avg(F.col("bordered").cast("double")).alias("bordered"), F.avg((F.length(F.trim("text")) > 120).cast("double")).alias("long"))
    small = (F.col("n_rows") < 2) | (F.col("n_cols") < 2) | (F.col("nested") == 1)
    confidence: Column = F.when(small, 0.0).when(F.col("th") == 1, 0.9).when((F.col("bordered") > 0.5) & (F.col("long") < 0.2), 0.8).when((F.col("long") < 0.1) & (F.col("n_rows") >= 3), 0.6).otherwise(0.0)
    return size.join(signs, ["doc_id", "table_id"]).select("doc_id", "table_id", "n_rows", "n_cols", (confidence > 0).alias("is_data"), confidence.alias("confidence"))


def paginate(items: DataFrame, width: float, ratio: float = 9 / 16) -> DataFrame:
    """items(doc_id, y, h) with page_no (by top, never split) and spans_page; page heights follow the width, 80 at least."""
    height = max(80.0, width * ratio)
    page = F.greatest(F.lit(0), F.floor(F.col("y") / height)).cast("long")
    return items.withColumn("page_no", page + 1).withColumn("spans_page", F.col("y") + F.col("h") > (page + 1) * height)


def preferred_size(tag) -> tuple[Column, Column]:
    """Width and height that an image element's attributes name, null where they don't."""
    of = lambda name: F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']?(\d+)", 1).try_cast("int")
    return of("width"), of("height")


def is_shown(display, visibility, opacity) -> Column:
    """Whether an element of these computed styles is shown."""
    return (display != "none") & (visibility != "hidden") & (opacity > 0.05)


def decoration(boxes: DataFrame, page_width: float) -> DataFrame:
    """boxes(w, h, background, bordered) that are drawn: two pixels or more, with a background or a border, but not a plain white one of the page's width."""
    white = F.coalesce(F.col("background") == "#FFFFFF", F.lit(False)) & (F.col("w") >= page_width) & ~F.col("bordered")
    return boxes.where((F.col("w") >= 2) & (F.col("h") >= 2) & (F.col("background").isNotNull() | F.col("bordered")) & ~white)

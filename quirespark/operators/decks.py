"""Deck operators: which slides use a layout, what a structured text holds, layouts by name, children of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def layout_usage(rows: DataFrame) -> DataFrame:
    """doc_id, part, layout (name) and pages (numbers, sorted) of each layout that slides of a deck's rows use."""
    pages = rows.where("kind = 'page'")
    used = pages.where("role = 'slide'").groupBy("doc_id", F.col("parent").alias("part")).agg(F.array_sort(F.collect_list("page_no")).alias("pages"))  # at most a deck's slides
    return used.join(pages.where("role = 'layout'").select("doc_id", "part", F.col("name").alias("layout")), ["doc_id", "part"]).select("doc_id", "part", "layout", "pages")


def text_counts(texts: DataFrame) -> DataFrame:
    """doc_id, n_slides, n_shapes, n_texts, n_tables of structured texts(doc_id, text): texts are shapes with a run, tables such with a row."""
    lines = texts.select("doc_id", F.split("text", "\n").alias("l"))
    of = lambda pattern: F.size(F.filter("l", lambda x: F.rlike(x, F.lit(pattern))))
    shapes = F.split(F.array_join("l", "\n"), r"\n\s*### ")
    holds = lambda pattern: F.size(F.filter(F.slice(shapes, 2, F.greatest(F.size(shapes) - 1, F.lit(0))), lambda x: F.rlike(x, F.lit(pattern))))
    return lines.select("doc_id", of(r"^##\s*(?:第\s*\d+\s*页|幻灯片\s*\d+)").alias("n_slides"), of(r"^\s*### \[\d+\]").alias("n_shapes"), holds(r'\n\s*· "').alias("n_texts"), holds(r"\n\s*第\d+行:").alias("n_tables"))


def layout_index(slides: DataFrame, layouts: DataFrame) -> DataFrame:
    """slides(doc_id, layout, ...) with layout_index: the first of layouts(doc_id, name, place) of that name, 0 where there is none."""
    first = layouts.groupBy("doc_id", F.col("name").alias("layout")).agg(F.min("place").alias("layout_index"))
    return slides.join(first, ["doc_id", "layout"], "left").withColumn("layout_index", F.coalesce("layout_index", F.lit(0)))


def nearest_group(shapes: DataFrame, keys: list[str], order: str, indent: str, is_group: str) -> DataFrame:
    """shapes with group_at: the order of the nearest group before them of a smaller indent, null at the top.

    A group is open for what follows it until something of its indent or less comes: of the last groups of each
    smaller indent, the latest counts that nothing closed. Indents are at most 8 levels.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = shapes
    for level in range(8):
        opened = F.last(F.when((F.col(indent) == level) & F.col(is_group), F.col(order)), ignorenulls=True).over(w)
        closed = F.last(F.when((F.col(indent) <= level) & ~((F.col(indent) == level) & F.col(is_group)), F.col(order)), ignorenulls=True).over(w)
        out = out.withColumn(f"_g{level}", F.when((opened > F.coalesce(closed, F.lit(-1))) & (F.col(indent) > level), opened))
    return out.withColumn("group_at", F.greatest(*[F.col(f"_g{i}") for i in range(8)])).drop(*[f"_g{i}" for i in range(8)])


def elided_formats(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """rows with shown: the format where it differs from the last one shown before it, null where it is the same."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("shown", F.when(~F.col(text).eqNullSafe(F.last(text, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))), F.col(text)))


def without_empty_placeholders(shapes: DataFrame) -> DataFrame:
    """shapes but for placeholders without text, fill and line of their own."""
    bare = F.col("ph_type").isNotNull() & (F.coalesce(F.trim("text"), F.lit("")) == "") & F.col("fill").isNull() & F.col("line").isNull()
    return shapes.where(~bare)

"""PDF to structured text: scan, visibility, lines, shapes, tables, charts, blocks, roles, orders, text.

One shuffle by (doc_id, page_no) after the scan; roles need all pages of a document and shuffle on it once more.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import layout, shapes
from ..operators.cut import cut
from ..operators.layout import PAGE

#: The words of the structured text, which its reader knows again.
ROLE = {"header": "页眉", "footer": "页脚"}
SHAPE = {"background": "背景", "h-line": "水平线", "v-line": "垂直线", "oblique": "斜线", "square": "正方形", "rectangle": "矩形", "triangle": "三角形", "quadrilateral": "四边形", "polyline": "折线", "circle": "圆形", "ellipse": "椭圆", "rounded-rectangle": "圆角矩形", "curve": "曲线", "freeform": "自由形状", "rectangles": "矩形组", "compound": "复合路径"}
GRADIENT = {"axial": "线性渐变", "radial": "径向渐变", "function": "函数渐变", "mesh": "网格渐变"}
CHART = {"bars-vertical": "柱形图（垂直柱）", "bars-horizontal": "柱形图（水平条）", "pie": "饼图/环形图", "pie-few": "饼图/环形图（扇区偏少，可能是图标）", "line": "折线图（数据系列）"}


class Options(NamedTuple):
    unit: str = "cm"
    merge_paragraphs: bool = True
    columns: bool = True
    header_footer: bool = True
    tables: bool = True
    charts: bool = True
    shapes: bool = True
    target: str = "raw"


class Parts(NamedTuple):
    """The tables of analyzed documents."""

    pages: DataFrame
    dropped: DataFrame
    lines: DataFrame
    blocks: DataFrame
    tables: DataFrame
    cells: DataFrame
    shapes: DataFrame
    charts: DataFrame
    images: DataFrame
    columns: DataFrame
    rotated: DataFrame
    shadings: DataFrame


def analyze(elements: DataFrame, opt: Options = Options()) -> Parts:  # noqa: B008
    """elements: of sources.files.pdf_elements(), best read back from a written table, since several parts use them."""
    pages = elements.where("kind = 'page'").select(*PAGE, "w", "h", "rot")
    drawn = elements.where("kind in ('text', 'path', 'image', 'shading')")
    seen = layout.visible(drawn)
    written = seen.where("kind = 'text' and length(trim(text)) > 0")
    flat = F.coalesce(layout.is_flat(), F.lit(False))
    rotated = written.where(~flat).select(*PAGE, "seq", "x0", "y0", "text", "size", "rot", X.font_name("font").alias("font"), "color")
    texts = written.where(flat).select(*PAGE, "seq", "x0", "y0", "x1", "y1", "text", "size", "rot", X.font_name("font").alias("font"), "bold", "italic", "color", "bad")
    parts = cut(layout.gaps(layout.assign_lines(texts)), "parts")
    lines = cut(layout.summarize_lines(parts), "lines")
    drawings = cut(shapes.classify(seen.where("kind = 'path'").select(*PAGE, "seq", "x0", "y0", "x1", "y1", "fill", "stroke", "line_width", "subpaths"), pages), "drawings")
    rules = shapes.rules(drawings)
    frames = cut(shapes.table_frames(rules), "frames")
    placed = cut(shapes.place_in_cells(parts, frames), "placed")
    cells = cut(shapes.cells(placed), "cells")
    ruled = cut(shapes.ruled_tables(frames, cells), "ruled")
    kept = placed.join(ruled.select(*PAGE), PAGE, "left_semi")
    in_ruled = kept.select(*PAGE, "line_id").distinct()
    if opt.tables:
        rest = lines.join(ruled.select(*PAGE), PAGE, "left_anti")
        free = cut(shapes.unruled_tables(rest, cut(shapes.segments(parts, rest), "segments")), "free")
        in_free = lines.join(free.select(*PAGE, F.col("y0").alias("ty0"), F.col("y1").alias("ty1")), PAGE).where("top >= ty0 - 0.01 and bottom <= ty1 + 0.01").select(*PAGE, "line_id").distinct()
        tables = ruled.join(kept.groupBy(*PAGE).agg(F.min("seq").alias("seq")), PAGE).select(*PAGE, F.lit(True).alias("ruled"), "seq", "x0", "y0", "x1", "y1", "n_rows", "n_cols", "confidence", "col_xs", "row_ys")
        tables = tables.unionByName(free.select(*PAGE, F.lit(False).alias("ruled"), "seq", "x0", "y0", "x1", "y1", "n_rows", "n_cols", "confidence"), allowMissingColumns=True)
        outside = lines.join(in_ruled.unionByName(in_free), [*PAGE, "line_id"], "left_anti")
    else:
        tables = ruled.where("false").select(*PAGE, F.lit(True).alias("ruled"), F.lit(0).cast("long").alias("seq"), "x0", "y0", "x1", "y1", "n_rows", "n_cols", "confidence", "col_xs", "row_ys")
        outside = lines
    paras = layout.summarize_paragraphs(cut(layout.assign_paragraphs(outside, opt.merge_paragraphs), "paragraphs"))
    with_block = cut(layout.assign_blocks(paras), "blocks")
    blocks = layout.summarize_blocks(with_block)
    detail = with_block.groupBy(*PAGE, "block_id").agg(F.array_sort(F.collect_list(F.struct("top", "para_id", "flow_text", "size", "all_bold", "color", "n_lines", "line_gap"))).alias("paras"))
    blocks = cut(blocks.join(detail, [*PAGE, "block_id"]), "block-details")
    found = cut(layout.columns(blocks, pages), "columns") if opt.columns else pages.select(*PAGE, F.lit(1).cast("long").alias("n_columns"), F.lit(None).cast("array<struct<x0:double,x1:double>>").alias("gutters"), F.lit(None).cast("array<double>").alias("bounds"), F.lit(0.0).alias("confidence"))
    blocks = layout.roles(blocks, pages) if opt.header_footer else blocks.withColumns({"role": F.lit(None).cast("string"), "role_confidence": F.lit(None).cast("double"), "is_page_number": F.lit(False)})
    blocks = cut(layout.reading_order(blocks, found), "ordered")
    bars = shapes.bar_charts(drawings, pages)
    charts = bars.unionByName(shapes.pie_charts(drawings), allowMissingColumns=True).unionByName(shapes.line_charts(drawings, pages), allowMissingColumns=True)
    charts = charts if opt.charts else charts.where("false")
    charts = shapes.suppress(cut(charts.withColumn("id", F.col("seq")), "chart-candidates")).withColumn("chart_id", F.col("id"))
    charts = cut(shapes.near_labels(charts, lines).drop("chart_id"), "charts")
    used = rules.join(ruled.select(*PAGE), PAGE, "left_semi").select(*PAGE, "seq").distinct()
    decor = cut(shapes.drop_specks(drawings.where("shape <> 'background'").join(used, [*PAGE, "seq"], "left_anti"), pages), "decor-candidates")
    inside = charts.select(*PAGE, F.col("x0").alias("cx0"), F.col("y0").alias("cy0"), F.col("x1").alias("cx1"), F.col("y1").alias("cy1"))
    members = decor.join(inside, PAGE).where("fill is not null and x0 >= cx0 and y0 >= cy0 and x1 <= cx1 and y1 <= cy1").select(*PAGE, "seq").distinct()
    decor = cut(decor.join(members, [*PAGE, "seq"], "left_anti"), "decor")
    return Parts(pages, layout.dropped_counts(drawn), lines, blocks, tables, cells, decor if opt.shapes else decor.where("false"), charts, seen.where("kind = 'image'"), found, rotated, seen.where("kind = 'shading'"))


def _spot(opt: Options, y0: str = "y0", y1: str = "y1") -> Column:
    u = lambda c: G.shown(G.to_unit(c, opt.unit))
    return F.concat(F.lit("位置: x="), u("x0"), F.lit(" y="), u(y0), F.lit(" 宽="), u(F.col("x1") - F.col("x0")), F.lit(" 高="), u(F.col(y1) - F.col(y0)), F.lit(f" {opt.unit}"))


def _sure(c: str) -> Column:
    return F.concat(F.lit(" [推断 置信度"), F.format_number(F.col(c), 2), F.lit("]"))


def _named(values: dict[str, str], c: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(c)), F.regexp_replace(c, "-gon$", "边形"))


def element_text(p: Parts, opt: Options = Options()) -> DataFrame:  # noqa: B008
    """doc_id, page_no, z and text of every element, in drawing order."""
    para = lambda x, i: F.concat(F.lit("段落"), (i + 1).cast("string"), F.when(x["n_lines"] > 1, F.concat(F.lit(" ["), x["n_lines"].cast("string"), F.lit(" 行]"))).otherwise(""), F.lit(':\n  · "'), x["flow_text"], F.lit('"  — '), G.shown(G.round_half_up(x["size"], 1)), F.lit("pt"), F.when(x["all_bold"], " 粗体").otherwise(""), F.coalesce(F.concat(F.lit(" "), x["color"]), F.lit("")))
    role = F.when(F.col("role").isNotNull(), F.concat(F.lit("（"), _named(ROLE, "role"), _sure("role_confidence"), F.lit("）"))).otherwise("")
    order = F.when(F.col("read_index").isNotNull(), F.concat(F.lit("  阅读顺序 "), F.col("read_index").cast("string"))).otherwise("")
    column = F.when(F.col("column") > 0, F.concat(F.lit("  第"), (F.col("column") + 1).cast("string"), F.lit("栏"))).otherwise("")
    blocks = p.blocks.select(*PAGE, "seq", F.lit("text").alias("kind"), F.col("block_id").alias("id"), F.concat(F.lit("文本块"), role, order, column).alias("head"), F.concat_ws("\n", _spot(opt, "top", "bottom"), F.array_join(F.transform("paras", para), "\n")).alias("body"))
    row = F.array_sort(F.collect_list(F.struct("r", "c", "text")))
    grid = p.cells.groupBy(*PAGE).agg(row.alias("grid"))
    tables = p.tables.join(grid.withColumn("ruled", F.lit(True)), [*PAGE, "ruled"], "left")
    cell = lambda r, c: F.coalesce(F.get(F.filter("grid", lambda g: (g["r"] == r) & (g["c"] == c)), F.lit(0))["text"], F.lit(""))
    line = lambda r: F.concat(F.lit("  第"), (r + 1).cast("string"), F.lit("行: "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_cols").cast("int") - 1), lambda c: F.concat(F.lit('"'), F.replace(cell(r, c), F.lit("\n"), F.lit("⏎")), F.lit('"'))), " | "))
    rows = F.when(F.col("grid").isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_rows").cast("int") - 1), line), "\n"))
    tables = tables.select(*PAGE, "seq", F.lit("table").alias("kind"), F.col("seq").alias("id"), F.concat(F.lit("表格 "), F.when(F.col("ruled"), "").otherwise("（无框线）"), _sure("confidence")).alias("head"), F.concat_ws("\n", _spot(opt), F.concat(F.col("n_rows").cast("string"), F.lit(" 行 × "), F.col("n_cols").cast("string"), F.lit(" 列")), rows).alias("body"))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("区域内及周边文字（可能是坐标轴标签/数据标签/图例，工具无法确定归属）:\n  "), F.array_join(F.transform("labels", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), "  ")))
    charts = p.charts.select(*PAGE, "seq", F.lit("chart").alias("kind"), "id", F.concat(F.lit("疑似图表："), _named(CHART, "guess"), _sure("confidence")).alias("head"), F.concat_ws("\n", _spot(opt), _bars(opt), labels).alias("body"))
    fill, stroke = F.concat(F.lit("填充: "), "fill"), F.concat(F.lit("边框: "), "stroke", F.lit(" 粗细 "), G.shown(G.round_half_up("line_width", 2)), F.lit("pt"))
    drawn = p.shapes.select(*PAGE, "seq", F.lit("shape").alias("kind"), F.col("seq").alias("id"), F.concat(_named(SHAPE, "shape"), F.when(F.col("shape_confidence") < 0.8, _sure("shape_confidence")).otherwise("")).alias("head"), F.concat_ws("\n", _spot(opt), fill, stroke).alias("body"))
    images = p.images.select(*PAGE, "seq", F.lit("image").alias("kind"), F.col("seq").alias("id"), F.lit("图片").alias("head"), F.concat_ws("\n", _spot(opt), F.concat(F.lit("像素尺寸: "), F.col("pix_w").cast("string"), F.lit(" × "), F.col("pix_h").cast("string"), F.lit("　格式: "), "format")).alias("body"))
    stops = F.when(F.size("pattern.stops") > 0, F.concat(F.lit(" 色标 "), F.array_join(F.transform("pattern.stops", lambda x: F.concat(G.shown(G.round_half_up(x["t"] * 100)), F.lit("%→"), x["color"])), " ")))
    shadings = p.shadings.select(*PAGE, "seq", F.lit("shading").alias("kind"), F.col("seq").alias("id"), F.lit("渐变填充区域").alias("head"), F.concat_ws("\n", _spot(opt), F.concat(_named(GRADIENT, "pattern.kind"), F.coalesce(stops, F.lit("")))).alias("body"))
    all_ = layout.z_order(blocks.unionByName(tables).unionByName(charts).unionByName(drawn).unionByName(images).unionByName(shadings))
    return all_.select(*PAGE, "z", "kind", F.concat(F.lit("### ["), F.col("z").cast("string"), F.lit("] "), "head", F.lit("\n"), "body").alias("text"))


def _bars(opt: Options) -> Column:
    """Each bar of a chart from the left, and how their lengths relate to the shortest; null for other charts."""
    u = lambda c: G.shown(G.to_unit(c, opt.unit))
    wide = lambda s: F.when(F.col("guess") == "bars-horizontal", s["len"]).otherwise(F.col("bar_width"))
    bar = lambda s, i: F.concat(F.lit("  柱"), (i + 1).cast("string"), F.lit(": 长度 "), u(s["len"]), F.lit(f"{opt.unit}  x="), u(s["x0"]), F.lit("~"), u(s["x0"] + wide(s)), F.lit("  "), F.coalesce(s["color"], F.lit("")))
    least = F.array_min(F.transform("series", lambda s: s["len"]))
    ratios = F.array_join(F.transform("series", lambda s: F.format_string("%.2f", s["len"] / least)), " : ")
    ratio = F.when(least > 0, F.concat(F.lit("  长度比值（若坐标轴从 0 起，这就是数据比值）: "), ratios)).otherwise("  长度比值: 无法确定（存在零长度柱）")
    return F.when(F.size("series") > 0, F.concat(F.lit("各柱几何（按 x 从左到右）:\n"), F.array_join(F.transform("series", bar), "\n"), F.lit("\n"), ratio))


def rotated_text(p: Parts, opt: Options = Options()) -> DataFrame:  # noqa: B008
    """doc_id, page_no and text of the section of vertical and turned texts, all of them, in the order they are drawn."""
    u = lambda c: G.shown(G.to_unit(c, opt.unit))
    line = F.concat(F.lit('  · "'), "text", F.lit('"'), F.coalesce(F.concat(F.lit("  旋转 "), G.shown(G.round_half_up("rot")), F.lit("°")), F.lit("")), F.lit("  "), F.concat_ws(" ", F.concat(G.shown(G.round_half_up("size", 1)), F.lit("pt")), "font", "color"), F.coalesce(F.concat(F.lit("  位置 x="), u("x0"), F.lit(" y="), u("y0"), F.lit(opt.unit)), F.lit("")))
    listed = p.rotated.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))).alias("all"))
    return listed.select(*PAGE, F.concat(F.lit("### 旋转/竖排文字（"), F.size("all").cast("string"), F.lit(" 段，未参与段落归并）\n"), F.array_join(F.transform("all", lambda x: x["t"]), "\n")).alias("turned"))


def document_text(elements: DataFrame, opt: Options = Options()) -> DataFrame:  # noqa: B008
    """doc_id and text: the structured description of each document; documents that can't be read have their error as text."""
    p = analyze(elements, opt)
    drawn = cut(element_text(p, opt), "element-text").groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "text"))), lambda x: x["text"]), "\n\n").alias("body"), F.count("*").alias("n"))
    total = F.count("*").over(Window.partitionBy("doc_id"))
    fmt = lambda c: G.shown(G.to_unit(c, opt.unit))
    heads = p.pages.withColumn("n_pages", total).join(p.columns.select(*PAGE, "n_columns"), PAGE, "left").join(drawn, PAGE, "left").join(rotated_text(p, opt), PAGE, "left")
    column = F.when(F.col("n_columns") > 1, F.concat(F.lit("分栏: "), F.col("n_columns").cast("string"), F.lit(" 栏")))
    page = F.concat_ws("\n", F.concat(F.lit("## 第 "), F.col("page_no").cast("string"), F.lit(" 页 / 共 "), F.col("n_pages").cast("string"), F.lit(" 页")), F.when(F.col("rot") != 0, F.concat(F.lit("页面旋转: "), F.col("rot").cast("int").cast("string"), F.lit("°"))), column, F.lit(""), F.col("body"), F.concat(F.lit("\n"), "turned"), F.lit(""), F.concat(F.lit("（本页共 "), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit(" 个元素）")), F.lit(""), F.lit("---"))
    pages = heads.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", page.alias("t")))), lambda x: x["t"]), "\n\n").alias("body"), F.min_by("w", "page_no").alias("w"), F.min_by("h", "page_no").alias("h"), F.max("n_pages").alias("n_pages"))
    about = elements.where("kind in ('info', 'note', 'outline', 'error')").groupBy("doc_id").agg(
        F.max(F.when(F.col("name") == "title", F.col("text"))).alias("title"), F.max(F.when(F.col("name") == "author", F.col("text"))).alias("author"), F.max(F.when(F.col("name") == "creator", F.col("text"))).alias("creator"), F.max(F.when(F.col("name") == "producer", F.col("text"))).alias("producer"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "note", F.struct("seq", "text")))).alias("notes"), F.array_sort(F.collect_list(F.when(F.col("kind") == "outline", F.struct("seq", "level", "text")))).alias("outline"), F.max(F.when(F.col("kind") == "error", F.col("text"))).alias("error"),
    )
    joined = elements.select("doc_id").distinct().join(pages, "doc_id", "left").join(about, "doc_id", "left")
    weights = p.shapes.select("doc_id", F.col("fill").alias("color"), F.greatest(F.lit(1.0), F.col("area")).alias("weight")).unionAll(p.shapes.select("doc_id", "stroke", 0.15 * F.greatest(F.lit(1.0), F.col("area"))))
    weights = weights.unionAll(p.blocks.select("doc_id", F.explode("paras").alias("x"), ((F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top")) * 3).alias("weight")).select("doc_id", "x.color", "weight"))
    colors = layout.palette(weights).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "color", "share"))), lambda x: F.concat(x["color"], F.lit("("), G.shown(G.round_half_up(x["share"] * 100)), F.lit("%)"))), " ").alias("palette"))
    joined = joined.join(colors, "doc_id", "left")
    size = F.concat(F.lit("页面尺寸: "), fmt("w"), F.lit(" × "), fmt("h"), F.lit(f" {opt.unit}"), F.coalesce(F.concat(F.lit("　("), G.paper("w", "h"), F.lit(")")), F.lit("")))
    some = lambda c: F.when(F.size(c) > 0, F.array_join(c, "\n"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("# PDF 结构化描述："), F.regexp_extract("doc_id", r"([^/]*)$", 1)), F.lit(""), size, F.concat(F.lit("页数: "), F.col("n_pages").cast("string")),
        F.concat(F.lit("生成工具: "), F.nullif(F.concat_ws(" / ", "creator", "producer"), F.lit(""))), F.concat(F.lit("文档标题: "), "title"), F.concat(F.lit("作者: "), "author"), F.concat(F.lit("主色板（按覆盖面积）: "), "palette"),
        some(F.transform("outline", lambda o: F.concat(F.repeat(F.lit("  "), o["level"]), F.lit("- "), o["text"]))), some(F.transform("notes", lambda n: F.concat(F.lit("- "), n["text"]))), F.lit(""), F.lit("---"), F.lit(""), F.col("body"),
    )
    return joined.select("doc_id", F.when(F.col("error").isNotNull() & F.col("body").isNull(), F.concat(F.lit("错误: "), "error")).otherwise(text).alias("text"))

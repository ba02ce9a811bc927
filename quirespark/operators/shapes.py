"""Rules, tables, shapes and charts from paths and text parts.

paths: doc_id, page_no, seq, x0, y0, x1, y1, fill, stroke, line_width, subpaths (array of struct of
pts (array of struct x, y), curves, closed, is_rect, n_ctrl). parts: as in layout.py, with line_id and baseline.
pages: doc_id, page_no, w, h.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap
from .layout import PAGE, cluster_1d

#: How far two coordinates may be apart to be on one axis.
AXIS = 0.8


def rules(paths: DataFrame) -> DataFrame:
    """orient (h, v), pos, lo, hi, len, thick, color, seq: long thin strokes and long thin filled rectangles, by subpath."""
    sub = paths.select(*PAGE, "seq", "fill", "stroke", F.coalesce("line_width", F.lit(1.0)).alias("lw"), F.explode("subpaths").alias("s"))
    x, y = F.transform("s.pts", lambda p: p["x"]), F.transform("s.pts", lambda p: p["y"])
    sub = sub.select("*", F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1")).withColumn("w", F.col("x1") - F.col("x0")).withColumn("h", F.col("y1") - F.col("y0"))

    def kind(thin: Column) -> Column:
        return F.when((F.col("h") <= thin) & (F.col("w") > 6), "h").when((F.col("w") <= thin) & (F.col("h") > 6), "v")

    stroked = sub.where("stroke is not null").withColumn("orient", kind(F.greatest(F.lit(2.5), 1.6 * F.col("lw")))).withColumn("color", F.col("stroke")).withColumn("filled", F.lit(False))
    filled = sub.where("fill is not null and s.is_rect").withColumn("orient", kind(F.lit(3.2))).withColumn("color", F.col("fill")).withColumn("filled", F.lit(True))
    both = stroked.unionByName(filled).where("orient is not null")
    flat = F.col("orient") == "h"
    pick = lambda a, b: F.when(flat, a).otherwise(b)
    thickness = pick(F.col("h"), F.col("w"))
    return both.select(
        *PAGE, "orient", pick((F.col("y0") + F.col("y1")) / 2, (F.col("x0") + F.col("x1")) / 2).alias("pos"), pick(F.col("x0"), F.col("y0")).alias("lo"), pick(F.col("x1"), F.col("y1")).alias("hi"),
        pick(F.col("w"), F.col("h")).alias("len"), F.when(F.col("filled"), thickness).otherwise(F.greatest("lw", thickness)).alias("thick"), "color", "filled", "seq",
    )


#: Rules this near are one edge; share of the extent that an edge must have; most cells of a table; least share of filled cells.
EDGE, EXTENT, CELLS, FILLED = 3.0, 0.25, 2000, 0.25


def table_frames(found: DataFrame) -> DataFrame:
    """doc_id, page_no, col_xs, row_ys, x0, y0, x1, y1 of pages whose rules(orient, pos, len) make a grid of two rows and columns at least."""
    clustered = cluster_1d(found, "pos", EDGE, [*PAGE, "orient"])
    outer = clustered.groupBy(*PAGE).agg(*[f(F.when(F.col("orient") == o, F.col("center"))).alias(n) for o, f, n in (("v", F.min, "x0"), ("v", F.max, "x1"), ("h", F.min, "y0"), ("h", F.max, "y1"))], F.count_if(F.col("orient") == "h").alias("n_h"))
    outer = outer.where((F.col("n_h") >= 2) & (F.col("x1") - F.col("x0") >= 20) & (F.col("y1") - F.col("y0") >= 10))
    extent = F.when(F.col("orient") == "h", F.col("x1") - F.col("x0")).otherwise(F.col("y1") - F.col("y0"))
    edges = clustered.join(outer, PAGE).where((F.abs(F.col("pos") - F.col("center")) <= EDGE) & (F.col("len") > EXTENT * extent))
    of = lambda o: F.array_sort(F.collect_set(F.when(F.col("orient") == o, F.col("center"))))
    frames = edges.groupBy(*PAGE, "x0", "y0", "x1", "y1").agg(of("v").alias("col_xs"), of("h").alias("row_ys"))
    rows, cols = F.size("row_ys") - 1, F.size("col_xs") - 1
    return frames.where((rows >= 2) & (cols >= 2) & (rows * cols <= CELLS))


def place_in_cells(parts: DataFrame, frames: DataFrame) -> DataFrame:
    """parts(baseline) inside a frame with r and c: the first row and column whose edges, a point wider, hold the part's centre."""
    px = (F.least("x0", "x1") + F.greatest("x0", "x1")) / 2
    py = F.col("baseline") - 0.35 * F.col("size")
    placed = parts.join(frames.select(*PAGE, "col_xs", "row_ys"), PAGE).withColumn("_px", px).withColumn("_py", py)

    def first(edges: str, value: str) -> Column:
        inner = F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda e, i: F.when((F.col(value) >= e - 1) & (F.col(value) <= F.get(edges, i + 1) + 1), i))
        return F.array_min(inner)

    return placed.withColumn("r", first("row_ys", "_py")).withColumn("c", first("col_xs", "_px")).where("r is not null and c is not null").drop("_px", "_py")


def cells(placed: DataFrame) -> DataFrame:
    """A row for each cell with parts: text (lines by baseline), size, bold, align; placed: of place_in_cells()."""
    keys = [*PAGE, "r", "c"]
    by_line = Window.partitionBy(*keys, "_line").orderBy("x0", "seq")
    lined = placed.withColumn("_line", F.floor(2 * F.col("baseline") + 0.5))
    gap = F.least("x0", "x1") - F.lag(F.greatest("x0", "x1")).over(by_line)
    lined = lined.withColumn("_t", F.concat(F.when(gap > 0.2 * F.greatest("size", F.lag("size").over(by_line)), " ").otherwise(""), F.col("text")))
    line = lined.groupBy(*keys, "_line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq", "_t"))), lambda p: p["_t"]), "").alias("_text"))
    texts = line.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_line", "_text"))), lambda p: p["_text"]), "\n").alias("text"))
    left, right = F.min(F.least("x0", "x1")), F.max(F.greatest("x0", "x1"))
    signs = placed.groupBy(*keys).agg(F.median("size").alias("size"), F.bool_and("bold").alias("bold"), left.alias("_l"), right.alias("_r"), F.first(F.get("col_xs", F.col("c"))).alias("_x0"), F.first(F.get("col_xs", F.col("c") + 1)).alias("_x1"))
    return texts.join(signs.withColumn("align", alignment("_l", "_r", "_x0", "_x1")).drop("_l", "_r", "_x0", "_x1"), keys)


def alignment(left: str, right: str, x0: str, x1: str) -> Column:
    width = F.col(x1) - F.col(x0)
    before, after = (F.col(left) - F.col(x0)) / width, (F.col(x1) - F.col(right)) / width
    return F.when(width > 0, F.when(F.abs(before - after) < 0.1, "center").when(after < 0.5 * before, "right").otherwise("left"))


def ruled_tables(frames: DataFrame, found: DataFrame) -> DataFrame:
    """frames with n_rows, n_cols, n_filled and confidence, where enough cells(text) are filled."""
    filled = found.where(F.length(F.trim("text")) > 0).groupBy(*PAGE).agg(F.count("*").alias("n_filled"))
    out = frames.join(filled, PAGE).withColumn("n_rows", (F.size("row_ys") - 1).cast("long")).withColumn("n_cols", (F.size("col_xs") - 1).cast("long"))
    ratio = F.col("n_filled") / (F.col("n_rows") * F.col("n_cols"))
    return out.where(ratio >= FILLED).withColumn("confidence", F.least(F.lit(0.95), 0.55 + 0.4 * ratio))


def segments(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """Cells of each line: stretches of parts between gaps of over 1.6 sizes; doc_id, page_no, line_id, cell, text, x0, x1."""
    keys = [*PAGE, "line_id"]
    w = Window.partitionBy(*keys).orderBy("x0", "seq")
    sized = parts.join(lines.select(*keys, F.col("size").alias("_size")), keys)
    gap = F.least("x0", "x1") - F.lag(F.greatest("x0", "x1")).over(w)
    cut = sized.withColumn("_gap", gap).withColumn("_new", F.coalesce((F.col("_gap") > 1.6 * F.col("_size")).cast("int"), F.lit(0)))
    cut = cut.withColumn("cell", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.concat(F.when((F.col("_new") == 0) & (F.col("_gap") > 0.2 * F.col("_size")), " ").otherwise(""), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("x0", "seq", "_t")))
    return cut.groupBy(*keys, "cell").agg(F.trim(F.array_join(F.transform(ordered, lambda p: p["_t"]), "")).alias("text"), F.min(F.least("x0", "x1")).alias("x0"), F.max(F.greatest("x0", "x1")).alias("x1"))


def unruled_tables(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Runs of three or more neighbouring lines whose segments line up in columns: doc_id, page_no, table_id, n_rows, n_cols, box, confidence."""
    counted = found.groupBy(*PAGE, "line_id").agg(F.count("*").alias("n_cells"))
    w = Window.partitionBy(*PAGE).orderBy("top", "x0", "line_id")
    big = lines.join(lines.groupBy(*PAGE).agg(F.count("*").alias("_n")).where("_n >= 6"), PAGE).join(counted, [*PAGE, "line_id"])
    fits = (F.col("n_cells") >= 2) & (F.lag("n_cells").over(w) >= 2) & (F.col("top") - F.lag("bottom").over(w) < 1.6 * F.col("size"))
    runs = big.withColumn("_new", F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1)).withColumn("table_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("n_cells >= 2")
    keys = [*PAGE, "table_id"]
    modal = runs.groupBy(*keys, "n_cells").agg(F.count("*").alias("_c"), F.min(F.struct("top", "x0")).alias("_first")).groupBy(*keys).agg(F.min_by("n_cells", F.struct(-F.col("_c"), "_first")).alias("n_cols"), F.max("_c").alias("_c"), F.sum("_c").alias("n_rows"))
    modal = modal.where((F.col("n_rows") >= 3) & (F.col("_c") >= 0.7 * F.col("n_rows")))
    starts = found.join(runs.select(*keys, "line_id", F.col("size").alias("_size")), [*PAGE, "line_id"]).join(modal, keys).where(F.col("cell") < F.col("n_cols"))
    spread = starts.withColumn("_m", F.median("x0").over(Window.partitionBy(*keys, "cell"))).groupBy(*keys, "cell").agg(F.avg(F.abs(F.col("x0") - F.col("_m"))).alias("_j")).groupBy(*keys).agg(F.max("_j").alias("_j"))
    boxes = runs.groupBy(*keys).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("y0"), F.max("bottom").alias("y1"), F.median("size").alias("_size"), F.min("seq").alias("seq"))
    out = modal.join(spread, keys).join(boxes, keys).where(F.col("_j") < 1.2 * F.col("_size"))
    confidence = F.least(F.lit(0.75), 0.35 + 0.3 * F.col("_c") / F.col("n_rows") + F.when(F.col("n_rows") >= 5, 0.1).otherwise(0.0))
    return out.select(*keys, "n_rows", F.col("n_cols").cast("long").alias("n_cols"), "x0", "y0", "x1", "y1", "seq", confidence.alias("confidence"))


# -- shapes -----------------------------------------------------------------------------------


#: Points that tell every shape: no test asks for more than ten.
POINTS = 12


def _distinct_points(points: Column) -> Column:
    """Points without those within 0.05 of the one before, the first POINTS of them, and without a last one that closes on the first."""
    near = lambda p, q: (F.abs(p["x"] - q["x"]) <= 0.05) & (F.abs(p["y"] - q["y"]) <= 0.05)
    empty = F.filter(points, lambda p: F.lit(False))
    kept = F.aggregate(points, empty, lambda out, p: F.when((F.size(out) >= POINTS) | (F.size(out) > 0) & near(F.get(out, F.size(out) - 1), p), out).otherwise(F.concat(out, F.array(p))))
    closes = (F.size(kept) > 1) & near(F.get(kept, F.lit(0)), F.get(kept, F.size(kept) - 1))
    return F.when(closes, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)


def classify(paths: DataFrame, pages: DataFrame) -> DataFrame:
    """paths with shape, shape_confidence, area and corner_radius."""
    p = paths.join(pages.select(*PAGE, F.col("w").alias("_pw"), F.col("h").alias("_ph")), PAGE)
    p = p.withColumn("_w", F.col("x1") - F.col("x0")).withColumn("_h", F.col("y1") - F.col("y0")).withColumn("area", F.col("_w") * F.col("_h"))
    p = p.withColumn("_n", F.size("subpaths")).withColumn("_s", F.get("subpaths", F.lit(0)))
    p = p.withColumn("_pts", F.when(~F.col("_s.is_rect"), _distinct_points(F.col("_s.pts")))).withColumn("_k", F.size("_pts"))  # a rectangle's aren't asked for
    w, h, k = F.col("_w"), F.col("_h"), F.col("_k")
    one, curves, closed = F.col("_n") == 1, F.coalesce(F.col("_s.curves"), F.lit(False)), F.coalesce(F.col("_s.closed"), F.lit(False))
    square = F.try_divide(F.abs(w - h), F.greatest(w, h)) < 0.02
    axis = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.abs(F.get("_pts", i)["x"] - F.get("_pts", (i + 1) % 4)["x"]) <= AXIS) | (F.abs(F.get("_pts", i)["y"] - F.get("_pts", (i + 1) % 4)["y"]) <= AXIS))
    raw = F.col("_s.pts")
    rx, ry, cx, cy = w / 2, h / 2, (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    error = F.aggregate(raw, F.lit(0.0), lambda s, q: s + F.abs(F.pow(F.try_divide(q["x"] - cx, rx), F.lit(2.0)) + F.pow(F.try_divide(q["y"] - cy, ry), F.lit(2.0)) - 1)) / F.size(raw)
    ellipse = (rx >= 0.5) & (ry >= 0.5) & (F.size(raw) > 4) & (error < 0.12)
    inset = F.transform(raw, lambda q: F.least(F.abs(q["x"] - F.col("x0")), F.abs(q["x"] - F.col("x1")), F.abs(q["y"] - F.col("y0")), F.abs(q["y"] - F.col("y1"))))
    radius = F.coalesce(F.array_max(F.filter(inset, lambda d: d >= 0.6)), F.lit(0.0))
    rounded = (F.size(raw) >= 8) & (F.size(F.filter(inset, lambda d: d < 0.6)) / F.size(raw) >= 0.45) & (radius > 0.5) & (radius <= F.least(w, h) / 2 + 1)
    two = one & (F.size(raw) == 2)
    dx, dy = F.abs(F.get(raw, F.lit(1))["x"] - F.get(raw, F.lit(0))["x"]), F.abs(F.get(raw, F.lit(1))["y"] - F.get(raw, F.lit(0))["y"])
    ctrl = F.coalesce(F.col("_s.n_ctrl"), F.lit(0))
    wide = F.when(w >= h, "h-line").otherwise("v-line")
    kinds: list[tuple[Column, Column | str, float]] = [
        (F.col("fill").isNotNull() & (F.col("area") > 0.88 * F.col("_pw") * F.col("_ph")) & (w > 0.93 * F.col("_pw")) & (h > 0.93 * F.col("_ph")), "background", 0.9),
        ((F.least(w, h) <= 3.2) & (F.greatest(w, h) > 6), wide, 0.9),
        (two, F.when(dy < AXIS, "h-line").when(dx < AXIS, "v-line").otherwise("oblique"), 0.95),
        (one & F.col("_s.is_rect"), F.when(square, "square").otherwise("rectangle"), 0.95),
        (one & ~curves & (k == 4) & axis, F.when(square, "square").otherwise("rectangle"), 0.92),
        (one & ~curves & (k == 3), "triangle", 0.85),
        (one & ~curves & (k == 4), "quadrilateral", 0.75),
        (one & ~curves & k.between(5, 10) & closed, F.concat(k.cast("string"), F.lit("-gon")), 0.7),
        (one & ~curves & ~closed & (k > 3), "polyline", 0.8),
        (one & curves & (ctrl == 4) & closed & ellipse, F.when(F.try_divide(F.abs(w - h), F.greatest(w, h)) < 0.03, "circle").otherwise("ellipse"), 0.85),
        (one & curves & ctrl.between(2, 8) & closed & rounded, "rounded-rectangle", 0.8),
        (one & curves & ~closed, "curve", 0.75),
        (one & curves, "freeform", 0.6),
        (F.col("_n").between(2, 3) & F.forall("subpaths", lambda s: s["is_rect"]), "rectangles", 0.7),
    ]
    found = F.struct(F.lit("compound").alias("shape"), F.lit(0.5).alias("confidence"))
    for test, shape, confidence in reversed(kinds):  # the first that holds; what follows isn't evaluated
        found = F.when(test, F.struct((shape if isinstance(shape, Column) else F.lit(shape)).alias("shape"), F.lit(confidence).alias("confidence"))).otherwise(found)
    # A generator, past which the optimizer moves no filter: it would evaluate all this once more for each time a filter names the shape.
    p = p.select(*paths.columns, "area", "_s", "_w", "_h", F.explode(F.array(F.struct(found.alias("c"), radius.alias("r")))).alias("_c"))
    return p.select(*paths.columns, F.col("_c.c.shape").alias("shape"), F.col("_c.c.confidence").alias("shape_confidence"), "area", F.when(F.col("_c.c.shape") == "rounded-rectangle", F.col("_c.r")).alias("corner_radius"))


def background(shapes: DataFrame) -> DataFrame:
    """The first background of each page."""
    return shapes.where("shape = 'background'").withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("seq"))).where("_n = 1").drop("_n")


def drop_specks(shapes: DataFrame, pages: DataFrame) -> DataFrame:
    """Shapes but for those smaller than 0.00004 of the page that are no lines."""
    size = F.greatest(F.col("area"), F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0"))
    kept = (size >= 0.00004 * F.col("_pw") * F.col("_ph")) | F.col("shape").isin("h-line", "v-line")
    return shapes.join(pages.select(*PAGE, F.col("w").alias("_pw"), F.col("h").alias("_ph")), PAGE).where(kept).drop("_pw", "_ph")


# -- charts -----------------------------------------------------------------------------------


def bar_charts(shapes: DataFrame, pages: DataFrame) -> DataFrame:
    """Three or more filled rectangles of one width and base line with different lengths: guess, n, box, seq, confidence."""
    rects = shapes.join(pages.select(*PAGE, (F.col("w") * F.col("h")).alias("_page")), PAGE)
    rects = rects.where(F.col("shape").isin("rectangle", "square") & F.col("fill").isNotNull() & (F.col("area") > 4) & (F.col("area") < 0.5 * F.col("_page")))
    rects = rects.withColumn("bar_width", F.floor(2 * (F.col("x1") - F.col("x0")) + 0.5) / 2).where("bar_width >= 1")
    keys = [*PAGE, "bar_width"]

    w = Window.partitionBy(*keys)
    rects = rects.withColumn("_up", F.abs(F.col("y1") - F.median("y1").over(w)) < 1.5).withColumn("_across", F.abs(F.col("x0") - F.median("x0").over(w)) < 1.5)

    def along(on: str, length: Column) -> Column:
        only = lambda c: F.when(F.col(on), c)
        return F.struct(
            F.count_if(on).alias("n"), F.count_distinct(only(F.floor(length + 0.5))).alias("lens"), F.min(only(F.col("x0"))).alias("x0"), F.min(only(F.col("y0"))).alias("y0"), F.max(only(F.col("x1"))).alias("x1"), F.max(only(F.col("y1"))).alias("y1"),
            F.min(only(F.col("seq"))).alias("seq"), F.array_sort(F.collect_list(only(F.struct("x0", length.alias("len"), F.col("fill").alias("color"))))).alias("series"),
        )

    both = rects.groupBy(*keys).agg(along("_up", F.col("y1") - F.col("y0")).alias("_u"), along("_across", F.col("x1") - F.col("x0")).alias("_a"))
    fits = lambda s: (F.col(f"{s}.n") >= 3) & (F.col(f"{s}.lens") >= 2)
    best = both.where(fits("_u") | fits("_a")).select(*keys, F.when(fits("_u"), "bars-vertical").otherwise("bars-horizontal").alias("guess"), F.when(fits("_u"), F.col("_u")).otherwise(F.col("_a")).alias("_s"))
    return best.select(*keys, "guess", *[F.col(f"_s.{c}").alias(c) for c in ("n", "x0", "y0", "x1", "y1", "seq", "series")], F.least(F.lit(0.8), 0.4 + 0.05 * F.col("_s.n")).alias("confidence"))


def pie_charts(shapes: DataFrame) -> DataFrame:
    """Two or more closed curved fills around one centre, the vertex that each meets most often."""
    wedges = shapes.where(F.col("fill").isNotNull() & F.exists("subpaths", lambda s: s["curves"] & s["closed"]) & ~F.col("shape").isin("circle", "ellipse") & (F.col("area") > 20))
    points = wedges.select(*PAGE, "seq", F.posexplode(F.flatten(F.transform("subpaths", lambda s: s["pts"]))).alias("i", "p"))
    points = points.groupBy(*PAGE, "seq", F.floor(F.col("p.x") + 0.5).alias("cx"), F.floor(F.col("p.y") + 0.5).alias("cy")).agg(F.count("*").alias("hits"), F.min("i").alias("i"))
    center = points.groupBy(*PAGE, "seq").agg(F.min_by(F.struct("cx", "cy"), F.struct(-F.col("hits"), "i")).alias("c"))
    grouped = wedges.join(center, [*PAGE, "seq"]).withColumn("_x", F.floor(F.col("c.cx") / 6 + 0.5)).withColumn("_y", F.floor(F.col("c.cy") / 6 + 0.5)).groupBy(*PAGE, "_x", "_y").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("seq").alias("seq"))
    grouped = grouped.where("n >= 2 and x1 - x0 >= 15 and y1 - y0 >= 15")
    return grouped.drop("_x", "_y").withColumn("guess", F.when(F.col("n") >= 3, "pie").otherwise("pie-few")).withColumn("confidence", F.least(F.lit(0.7), 0.3 + 0.08 * F.col("n")))


def line_charts(shapes: DataFrame, pages: DataFrame) -> DataFrame:
    """Stroked polylines or curves of four or more points that span enough of the page."""
    found = shapes.join(pages.select(*PAGE, F.col("w").alias("_pw")), PAGE).where(F.col("shape").isin("polyline", "curve") & F.col("stroke").isNotNull() & F.exists("subpaths", lambda s: F.size(s["pts"]) >= 4))
    found = found.where((F.col("x1") - F.col("x0") >= 0.08 * F.col("_pw")) & (F.col("y1") - F.col("y0") >= 4))
    return found.select(*PAGE, "seq", "x0", "y0", "x1", "y1", F.aggregate("subpaths", F.lit(0), lambda n, s: n + F.size(s["pts"])).cast("long").alias("n"), F.lit("line").alias("guess"), F.lit(0.45).alias("confidence"))


#: How far around a chart its labels may be: left, up, right, down.
REACH = {"bars": (40, 25, 40, 30), "pie": (60, 30, 60, 30), "line": (45, 25, 45, 30)}


def near_labels(charts: DataFrame, lines: DataFrame) -> DataFrame:
    """charts(chart_id, guess, box) with labels: the text of lines(text, x0, top, x1, bottom) around them, from the top."""
    kind = F.regexp_extract("guess", r"^([a-z]+)", 1)
    reach = lambda i: reduce(lambda c, k: c.when(kind == k, REACH[k][i]), ("pie", "line"), F.when(kind == "bars", REACH["bars"][i]))
    wide = charts.select(*PAGE, "chart_id", (F.col("x0") - reach(0)).alias("cx0"), (F.col("y0") - reach(1)).alias("cy0"), (F.col("x1") + reach(2)).alias("cx1"), (F.col("y1") + reach(3)).alias("cy1"))
    met = wide.join(lines.where(F.length(F.trim("text")) > 0), PAGE).where(overlap(("x0", "top", "x1", "bottom"), ("cx0", "cy0", "cx1", "cy1")) > 0)
    labels = met.groupBy(*PAGE, "chart_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), lambda x: x["text"]).alias("labels"))
    return charts.join(labels, [*PAGE, "chart_id"], "left")


def suppress(charts: DataFrame, share: float = 0.6) -> DataFrame:
    """charts(confidence, box, id) without those that a kept, more confident one covers by more than `share` of the smaller.

    Greedy by nature: a fold over each page's charts, ordered by confidence and id. A page has few.
    """
    box = F.struct((-F.col("confidence")).alias("c"), "id", "x0", "y0", "x1", "y1")
    pages = charts.groupBy(*PAGE).agg(F.array_sort(F.collect_list(box)).alias("all"))

    def covers(k: Column, c: Column) -> Column:
        size = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
        return overlap((k["x0"], k["y0"], k["x1"], k["y1"]), (c["x0"], c["y0"], c["x1"], c["y1"])) > share * F.least(size(k), size(c))

    kept = F.aggregate("all", F.filter("all", lambda x: F.lit(False)), lambda out, c: F.when(F.exists(out, lambda k: covers(k, c)), out).otherwise(F.concat(out, F.array(c))))
    return charts.join(pages.select(*PAGE, F.explode(F.transform(kept, lambda x: x["id"])).alias("id")), [*PAGE, "id"])


def length_ratios(charts: DataFrame) -> DataFrame:
    """charts(series) with ratios: each bar's length as a multiple of the shortest, null where that is 0."""
    least = F.array_min(F.transform("series", lambda b: b["len"]))
    return charts.withColumn("ratios", F.transform("series", lambda b: F.when(least != 0, b["len"] / least)))


def without_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(seq) that are none of the rules."""
    return paths.join(rules.select(*PAGE, "seq").distinct(), [*PAGE, "seq"], "left_anti")

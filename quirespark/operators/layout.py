"""From positioned elements to lines, paragraphs, blocks, columns, roles and orders.

Tables are keyed by (doc_id, page_no) and shuffle on these two once: every later grouping by more
columns keeps that partitioning. Only three steps depend on the order in which elements are taken
(lines, paragraphs, blocks); they stream through Python page by page, all others are plain expressions.

items: doc_id, page_no, seq, kind (text, path, image, shading), x0, y0, x1, y1 (a text's y0 is its baseline).
text parts besides: text, size, rot, font, bold, italic, color, bad. Bigger y is further down.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap
from ..functions.text import PAGE_NUMBER, is_cjk, repeat_key

PAGE = ["doc_id", "page_no"]


def visibility(items: DataFrame) -> DataFrame:
    """items with `dropped`: hidden-layer, invisible, clipped (wholly outside clip_x0.. and not tiny) or null."""
    box = ("x0", "y0", "x1", "y1")
    outside = (overlap(box, ("clip_x0", "clip_y0", "clip_x1", "clip_y1")) <= 0) & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) > 0.5)
    return items.withColumn(
        "dropped",
        F.when(F.col("hidden"), "hidden-layer").when((F.col("kind") == "text") & F.col("invisible"), "invisible").when(F.col("clip_x0").isNotNull() & outside, "clipped"),
    )


def visible(items: DataFrame) -> DataFrame:
    return visibility(items).where("dropped is null").drop("dropped")


def dropped_counts(items: DataFrame) -> DataFrame:
    one = lambda reason, name: F.count_if(F.col("dropped") == reason).alias(name)
    return visibility(items).groupBy(*PAGE).agg(one("hidden-layer", "n_hidden_layer"), one("invisible", "n_invisible"), one("clipped", "n_clipped"))


def is_flat(rot: str = "rot") -> Column:
    """Within 3 degrees of horizontal."""
    turn = F.pmod(F.col(rot), F.lit(360.0))
    return (turn < 3) | (turn > 357)


def cluster_1d(values: DataFrame, value: str, tolerance: float, keys: list[str] = PAGE) -> DataFrame:
    """values with cluster (from 0) and center: a value joins while it is within tolerance of the last one."""
    w = Window.partitionBy(*keys).orderBy(value)
    new = F.coalesce((F.col(value) - F.lag(value).over(w) > tolerance).cast("int"), F.lit(0))
    numbered = values.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")
    return numbered.withColumn("center", F.avg(value).over(Window.partitionBy(*keys, "cluster")))


# -- lines ------------------------------------------------------------------------------------

#: How near baselines are, in sizes and points; how far sizes may differ; how many lines are looked back.
LINE_TOLERANCE, LINE_LEAST, SIZE_RATIO, LOOK_BACK, GIVE_UP = 0.32, 1.2, 0.45, 24, 3


def _by_page(df: DataFrame, order: list[str], uses: list[str], fold: Callable[[list[list]], list[list]], more: str) -> DataFrame:
    """df with the columns `more`, which fold makes from a page's `uses` (lists, in order).

    Pages stream through a task, sorted, many to a batch: a batch's last page waits for the next batch.
    """
    names = [c.split()[0] for c in more.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def folded(rows: pd.DataFrame) -> pd.DataFrame:
            keys = rows[PAGE]
            new = (keys != keys.shift()).any(axis=1).to_numpy()
            new[0] = True
            starts = [*np.flatnonzero(new).tolist(), len(rows)]
            columns = [rows[c].tolist() for c in uses]
            made: list[list] = [[] for _ in names]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                for held, values in zip(made, fold([c[i:j] for c in columns]), strict=True):
                    held += values
            return rows.assign(**dict(zip(names, made, strict=True)))

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[PAGE] == rows[PAGE].iloc[-1]).all(axis=1).to_numpy()
            cut = len(rows) if not last.any() else int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
            if cut:
                yield folded(rows.iloc[:cut].reset_index(drop=True))
            rest = rows.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield folded(rest)

    return df.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInPandas(run, _with(df, more))


def _fold_lines(columns: list[list]) -> list[list]:
    lines: list[list[float]] = []  # baseline, size, number of parts
    ids = []
    for y, size in zip(*columns, strict=True):
        hit = None
        for i in range(len(lines) - 1, max(-1, len(lines) - 1 - LOOK_BACK), -1):
            base, held, _ = lines[i]
            if abs(base - y) <= max(LINE_LEAST, LINE_TOLERANCE * size, LINE_TOLERANCE * held) and min(held, size) > SIZE_RATIO * max(held, size):
                hit = i
                break
            if base < y - GIVE_UP * size:
                break
        if hit is None:
            lines.append([y, size, 1])
            hit = len(lines) - 1
        else:
            base, held, n = lines[hit]
            lines[hit] = [(base * n + y) / (n + 1), max(held, size), n + 1]
        ids.append(hit)
    return [ids, [lines[i][0] for i in ids]]


def assign_lines(parts: DataFrame) -> DataFrame:
    """parts with line_id and baseline (mean of the line's): parts of about one baseline and size are one line."""
    return _by_page(parts, ["y0", "x0", "seq"], ["y0", "size"], _fold_lines, "line_id long, baseline double")


def gaps(parts: DataFrame) -> DataFrame:
    """parts(line_id) with sep, the blank that the gap before each stands for.

    A gap counts against the others of its line, so that spaced-out letters stay together: a blank stands for
    one over 1.8 medians (of three at least) and 0.2 em, or 0.45 em between characters of scripts without spaces.
    """
    line = Window.partitionBy(*PAGE, "line_id")
    by_x = line.orderBy("x0", "seq")
    left, right = F.least("x0", "x1"), F.greatest("x0", "x1")
    out = parts.withColumn("_gap", left - F.lag(right).over(by_x))
    wide = F.when(F.col("_gap") > 0.01, F.col("_gap"))
    out = out.withColumn("_median", F.when(F.count(wide).over(line) >= 3, F.median(wide).over(line)).otherwise(0.0))
    before = F.lag("text").over(by_x)
    out = out.withColumn("_em", F.greatest("size", F.lag("size").over(by_x))).withColumn("_cjk", is_cjk(F.substring(before, -1, 1)) & is_cjk(F.substring("text", 1, 1))).withColumn("_blank", F.coalesce(F.rlike(before, F.lit(r"\s$")), F.lit(False)))
    threshold = F.when(F.col("_cjk"), F.col("_em") * 0.45).otherwise(F.greatest(F.col("_em") * 0.2, F.col("_median") * 1.8))
    sep = F.when((F.col("_gap") > threshold) & ~F.col("_blank") & (F.length("text") > 0), " ").otherwise("")
    return out.withColumn("sep", sep).drop("_gap", "_median", "_em", "_cjk", "_blank")


def most_common(value: str, order: str, keys: list[str], rows: DataFrame) -> DataFrame:
    """keys with the value that most rows have, of equal ones the first."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), "_first", value)).alias(value))


def summarize_lines(parts: DataFrame) -> DataFrame:
    """A row for each line of parts(line_id, baseline, sep): text, box, sizes, formats, color, seq."""
    keys = [*PAGE, "line_id"]
    ordered = F.array_sort(F.collect_list(F.struct("x0", "seq", F.concat("sep", "text").alias("t"))))
    lines = parts.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda p: p["t"]), "").alias("text"),
        F.min(F.least("x0", "x1")).alias("x0"),
        F.max(F.greatest("x0", "x1")).alias("x1"),
        F.min(F.col("y0") - 0.78 * F.col("size")).alias("top"),
        F.max(F.col("y0") + 0.22 * F.col("size")).alias("bottom"),
        F.first("baseline").alias("baseline"),
        F.median("size").alias("size"),
        F.max("size").alias("max_size"),
        F.count_distinct(F.floor(F.col("size") * 10 + 0.5)).alias("n_sizes"),
        F.bool_or("bold").alias("bold"),
        F.bool_and("bold").alias("all_bold"),
        F.bool_or("italic").alias("italic"),
        F.min("seq").alias("seq"),
        F.count("*").alias("n_parts"),
    )
    return lines.join(most_common("color", "x0", keys, parts), keys, "left")


# -- paragraphs and blocks --------------------------------------------------------------------

#: What starts an item of a list, and what ends a sentence.
BULLET = re.compile(r"^\s*([•·▪◦‣∙●○■□◆◇\-–—*]|\(?\d{1,2}[.)、]|[a-zA-Z][.)]|[一二三四五六七八九十]+[、.])\s+")
SENTENCE_END = re.compile(r"[。．.！!？?；;：:]\s*$")


def _continues(above: dict, below: dict, left: float, right: float) -> bool:
    """Whether a line goes on with the paragraph that `above` ends; left and right: the paragraph's edges."""
    size, lead = max(above["size"], below["size"]), below["baseline"] - above["baseline"]
    if min(above["size"], below["size"]) < 0.85 * size or above["all_bold"] != below["all_bold"]:
        return False
    if not 0.4 * size <= lead <= 1.9 * size or below["top"] - above["bottom"] > 1.1 * size:
        return False
    shared = min(above["x1"], below["x1"]) - max(above["x0"], below["x0"])
    if shared < 0.5 * min(above["x1"] - above["x0"], below["x1"] - below["x0"]):
        return False
    ends_early = right - above["x1"] > 2.5 * size
    if ends_early and (SENTENCE_END.search(above["text"]) or below["x0"] - left > 1.2 * size):
        return False
    return not BULLET.match(below["text"])


_LINE = ["text", "size", "baseline", "all_bold", "top", "bottom", "x0", "x1"]


def _fold_paragraphs(columns: list[list]) -> list[list]:
    ids, last, n = [], None, -1
    left = right = 0.0
    for values in zip(*columns, strict=True):
        line = dict(zip(_LINE, values, strict=True))
        if last is None or not _continues(last, line, left, right):
            n, left, right = n + 1, line["x0"], line["x1"]
        left, right, last = min(left, line["x0"]), max(right, line["x1"]), line
        ids.append(n)
    return [ids]


def _with(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {more}"


def assign_paragraphs(lines: DataFrame, merge: bool = True) -> DataFrame:
    """lines with para_id; without merging every line is a paragraph."""
    if not merge:
        return lines.withColumn("para_id", F.row_number().over(Window.partitionBy(*PAGE).orderBy("top", "x0", "line_id")).cast("long") - 1)
    return _by_page(lines, ["top", "x0", "line_id"], _LINE, _fold_paragraphs, "para_id long")


def summarize_paragraphs(lines: DataFrame) -> DataFrame:
    keys = [*PAGE, "para_id"]
    w = Window.partitionBy(*keys).orderBy("top", "x0", "line_id")
    led = lines.withColumn("_lead", F.col("baseline") - F.lag("baseline").over(w))
    before = F.lag("text").over(w)
    glued = is_cjk(F.substring(before, -1, 1)) | is_cjk(F.substring("text", 1, 1)) | F.rlike(before, F.lit(r"[-\s]$"))
    led = led.withColumn("_flow", F.concat(F.when(before.isNull() | glued, "").otherwise(" "), F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("top", "x0", "line_id", "text", "_flow")))
    paras = led.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"),
        F.array_join(F.transform(ordered, lambda x: x["_flow"]), "").alias("flow_text"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
        F.median("size").alias("size"), F.bool_and("all_bold").alias("all_bold"), F.median("_lead").alias("line_gap"), F.count("*").alias("n_lines"), F.min("seq").alias("seq"),
    )
    return paras.join(most_common("color", "top", keys, lines), keys, "left")


_PARA = ["x0", "x1", "top", "bottom", "size"]


def _fold_blocks(columns: list[list]) -> list[list]:
    rows = [dict(zip(_PARA, values, strict=True)) for values in zip(*columns, strict=True)]
    ids = [-1] * len(rows)
    n = 0
    for i, first in enumerate(rows):
        if ids[i] >= 0:
            continue
        ids[i], last, bottom = n, first, first["bottom"]
        for j in range(i + 1, len(rows)):
            if ids[j] >= 0:
                continue
            p = rows[j]
            gap, size = p["top"] - bottom, max(last["size"], p["size"])
            if gap > 2.2 * size:
                break
            shared = min(last["x1"], p["x1"]) - max(last["x0"], p["x0"])
            if gap >= -1 and abs(p["x0"] - last["x0"]) < 1.6 * size and shared > 0.35 * min(last["x1"] - last["x0"], p["x1"] - p["x0"]):
                ids[j], last, bottom = n, p, max(bottom, p["bottom"])
        n += 1
    return [ids]


def assign_blocks(paras: DataFrame) -> DataFrame:
    """paras with block_id: aligned paragraphs that follow each other closely are one block."""
    return _by_page(paras, ["top", "para_id"], _PARA, _fold_blocks, "block_id long")


def summarize_blocks(paras: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("top", "para_id", "text")))
    return paras.groupBy(*PAGE, "block_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.median("size").alias("size"), F.min("seq").alias("seq"), F.count("*").alias("n_paras"),
    )


# -- columns, roles, orders -------------------------------------------------------------------

#: Bins over a page's content, share of its height under which a bin is empty, widths of gutters by page width.
BINS, EMPTY, GUTTER, GUTTER_KEPT, GUTTERS = 400, 0.02, 0.015, 0.02, 3


def columns(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_no, n_columns, gutters, bounds, confidence: vertical gaps that no block covers divide a page; pages(doc_id, page_no, w, h)."""
    wide = blocks.where(F.col("x1") - F.col("x0") > 2)
    span = wide.groupBy(*PAGE).agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"), (F.max("bottom") - F.min("top")).alias("span"), F.count("*").alias("n")).join(pages, PAGE)
    span = span.where((F.col("n") >= 4) & (F.col("hi") - F.col("lo") >= 0.3 * F.col("w")) & (F.col("span") > 0)).withColumn("step", (F.col("hi") - F.col("lo")) / BINS)
    binned = wide.join(span, PAGE).select(*PAGE, F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("x0") - F.col("lo")) / F.col("step"))).cast("int"), F.least(F.lit(BINS - 1), F.ceil((F.col("x1") - F.col("lo")) / F.col("step"))).cast("int"))).alias("bin"), (F.col("bottom") - F.col("top")).alias("height"))
    cover = binned.groupBy(*PAGE, "bin").agg(F.sum("height").alias("cover"))
    dense = span.select(*PAGE, "lo", "step", "span", "w", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin")).join(cover, [*PAGE, "bin"], "left")
    empty = dense.where(F.coalesce("cover", F.lit(0.0)) <= EMPTY * F.col("span"))
    island = F.col("bin") - F.row_number().over(Window.partitionBy(*PAGE).orderBy("bin"))
    runs = empty.withColumn("island", island).groupBy(*PAGE, "island").agg(F.min("bin").alias("a"), F.max("bin").alias("z"), F.first("lo").alias("lo"), F.first("step").alias("step"), F.first("w").alias("w"))
    runs = runs.withColumn("b", F.col("z") + 1).withColumn("width", (F.col("b") - F.col("a")) * F.col("step")).where((F.col("width") > GUTTER * F.col("w")) & (F.col("a") > 2) & (F.col("b") < BINS - 2))
    best = runs.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("width"), "a"))).where((F.col("place") <= GUTTERS) & (F.col("width") > GUTTER_KEPT * F.col("w")))
    edges = best.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct((F.col("lo") + F.col("a") * F.col("step")).alias("x0"), (F.col("lo") + F.col("b") * F.col("step")).alias("x1")))).alias("gutters"))
    held = span.join(edges, PAGE).withColumn("bounds", F.concat(F.array("lo"), F.transform("gutters", lambda g: (g["x0"] + g["x1"]) / 2), F.array("hi")))
    middle = (F.col("x0") + F.col("x1")) / 2
    inside = wide.join(held.select(*PAGE, "bounds", "gutters"), PAGE).withColumn("column", F.size(F.filter("bounds", lambda x: x <= middle)) - 1).where((middle >= F.get("bounds", F.lit(0))) & (middle < F.element_at("bounds", -1)))
    counts = inside.groupBy(*PAGE, "column").agg(F.count("*").alias("c")).groupBy(*PAGE).agg(F.count_if(F.col("c") >= 2).alias("valid"), F.min("c").alias("least"), F.count("*").alias("filled"))
    n = F.size("bounds") - 1
    found = held.join(counts, PAGE).where("valid >= 2").select(*PAGE, n.cast("long").alias("n_columns"), "gutters", "bounds", F.least(F.lit(0.95), 0.45 + 0.15 * F.least(n, F.lit(3)) + F.when((F.col("least") >= 3) & (F.col("filled") == n), 0.2).otherwise(0.0)).alias("confidence"))
    return pages.select(*PAGE).join(found, PAGE, "left").select(*PAGE, F.coalesce("n_columns", F.lit(1)).cast("long").alias("n_columns"), "gutters", "bounds", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


#: Bands at the top and bottom of a page, for repeated text and for page numbers.
BAND, NUMBER_BAND = 0.12, 0.10


def roles(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """blocks with role (header, footer), role_confidence and is_page_number: what the bands of half the pages, three at least, repeat."""
    sized = blocks.join(pages.select(*PAGE, "h"), PAGE).withColumn("_t", F.col("top") / F.col("h")).withColumn("_b", F.col("bottom") / F.col("h"))
    banded = sized.withColumn("_band", F.when(F.col("_t") <= BAND, "header").when(F.col("_b") >= 1 - BAND, "footer")).withColumn("_key", repeat_key("text"))
    n_pages = pages.groupBy("doc_id").agg(F.count_distinct("page_no").alias("_n"))
    hits = banded.where("_band is not null").groupBy("doc_id", "_band", "_key").agg(F.count_distinct("page_no").alias("_hits"))
    hits = hits.join(n_pages, "doc_id").where((F.col("_n") >= 3) & (F.col("_hits") >= F.greatest(F.lit(3), F.ceil(F.col("_n") / 2)))).select("doc_id", "_band", "_key", F.least(F.lit(0.95), F.col("_hits") / F.col("_n")).alias("_conf"))
    out = banded.join(hits, ["doc_id", "_band", "_key"], "left").join(n_pages.select("doc_id", "_n"), "doc_id")
    number = F.rlike(F.trim("text"), F.lit(PAGE_NUMBER)) & ((F.col("_t") <= NUMBER_BAND) | (F.col("_b") >= 1 - NUMBER_BAND)) & F.col("_conf").isNull() & (F.col("_n") >= 3)
    out = out.withColumn("is_page_number", F.coalesce(number, F.lit(False)))
    out = out.withColumn("role", F.when(F.col("_conf").isNotNull(), F.col("_band")).when(F.col("is_page_number"), F.when(F.col("_b") >= 1 - NUMBER_BAND, "footer").otherwise("header")))
    out = out.withColumn("role_confidence", F.when(F.col("_conf").isNotNull(), F.col("_conf")).when(F.col("is_page_number"), 0.8))
    return out.select(*blocks.columns, "role", "role_confidence", "is_page_number")


def reading_order(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """blocks(role) with column (from 0) and read_index (from 1; null for headers and footers); found: of columns()."""
    middle = (F.col("x0") + F.col("x1")) / 2
    out = blocks.join(found.select(*PAGE, "bounds"), PAGE, "left")
    column = F.when(F.col("bounds").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.size(F.filter("bounds", lambda x: x <= middle)), F.size("bounds") - 1) - 1))
    out = out.withColumn("column", column.cast("long")).drop("bounds")
    body = F.row_number().over(Window.partitionBy(*PAGE, F.col("role").isNull()).orderBy("column", "top", "x0", "block_id"))
    return out.withColumn("read_index", F.when(F.col("role").isNull(), body).cast("long"))


#: The order of kinds of equal seq.
KINDS = ["text", "table", "chart", "image", "shape", "shading"]


def z_order(elements: DataFrame) -> DataFrame:
    """elements(kind, seq, id) with z, their place in drawing order from 1."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return elements.withColumn("z", F.row_number().over(Window.partitionBy(*PAGE).orderBy("seq", rank, "id")).cast("long"))


def palette(colors: DataFrame, keys: list[str] = ["doc_id"], most: int = 12) -> DataFrame:  # noqa: B006
    """The `most` heaviest colors of colors(color, weight), with their share of all."""
    summed = colors.where("color is not null").groupBy(*keys, "color").agg(F.sum("weight").alias("weight"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "color"))
    return summed.withColumn("share", share).withColumn("place", place.cast("long")).where(F.col("place") <= most)


def coalesce_runs(runs: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Neighbours of equal format as one run: keys, run_id (from 0), same, text and n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce(~F.lag(F.struct(*same)).over(w).eqNullSafe(F.struct(*same)), F.lit(True)).cast("int")
    first = F.row_number().over(w) == 1
    marked = runs.withColumn("run_id", F.sum(F.when(first, 0).otherwise(changed)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return marked.groupBy(*keys, "run_id", *same).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"), F.count("*").alias("n"))


def reliability(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and reliability: the share of codes of texts(text, bad) that could be decoded, 1 without any."""
    return texts.groupBy(*keys).agg(F.coalesce(1 - F.sum("bad") / F.nullif(F.sum(F.length("text")), F.lit(0)), F.lit(1.0)).alias("reliability"))


def uniform_size(pages: DataFrame) -> DataFrame:
    """doc_id, n_sizes and uniform: whether all of pages(doc_id, w, h) have one size, in whole points."""
    size = F.struct(F.floor(F.col("w") + 0.5), F.floor(F.col("h") + 0.5))
    return pages.groupBy("doc_id").agg(F.count_distinct(size).alias("n_sizes")).withColumn("uniform", F.col("n_sizes") == 1)


def extent(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, right and bottom: how far items(x, y, w, h) reach."""
    return items.groupBy(*keys).agg(F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"))


def draw_order(texts: DataFrame, traced: DataFrame, page: list[str] = PAGE, default: int = 10_000_000) -> DataFrame:
    """texts(x0, y0) with draw_seq: that of the first of traced(x, y, seq) at the same origin, to a tenth of a point; `default` where there is none."""
    tenth = lambda c: F.floor(F.col(c) * 10 + 0.5)
    first = traced.groupBy(*page, tenth("x").alias("_x"), tenth("y").alias("_y")).agg(F.min("seq").alias("draw_seq"))
    out = texts.withColumn("_x", tenth("x0")).withColumn("_y", tenth("y0")).join(first, [*page, "_x", "_y"], "left")
    return out.withColumn("draw_seq", F.coalesce("draw_seq", F.lit(default))).drop("_x", "_y")


def bounds(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the box around items(x0, y0, x1, y1)."""
    return items.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def fonts_used(texts: DataFrame, keys: list[str], most: int = 14) -> DataFrame:
    """keys, font, n_chars of the fonts with the most characters, place from 1, and n_more, how many fonts are left out."""
    own = Window.partitionBy(*keys)
    used = texts.groupBy(*keys, "font").agg(F.sum(F.length("text")).alias("n_chars"))
    placed = used.withColumn("n_more", F.count("*").over(own) - most).withColumn("place", F.row_number().over(own.orderBy(F.desc("n_chars"), "font")))
    return placed.where(F.col("place") <= most)


#: Height of the strips in which boxes of a page meet.
STRIP = 40.0


def _in_strips(boxes: DataFrame, top: str, bottom: str) -> DataFrame:
    return boxes.withColumn("strip", F.explode(F.sequence(F.floor(F.col(top) / STRIP), F.floor(F.col(bottom) / STRIP))))


def _met(left: DataFrame, right: DataFrame, page: list[str]) -> DataFrame:
    """Pairs of left(x0..) and right(u_x0..) with shared, their common area, if there is any: each in the first strip that both reach."""
    met = _in_strips(left, "y0", "y1").join(_in_strips(right, "u_y0", "u_y1"), [*page, "strip"]).where(F.col("strip") == F.floor(F.greatest("y0", "u_y0") / STRIP))
    shared = F.greatest(F.lit(0.0), F.least("x1", "u_x1") - F.greatest("x0", "u_x0")) * F.greatest(F.lit(0.0), F.least("y1", "u_y1") - F.greatest("y0", "u_y0"))
    return met.withColumn("shared", shared).where("shared > 0")


def overlaps(boxes: DataFrame, key: str, page: list[str] = PAGE) -> DataFrame:
    """page, key, u_key and shared of all pairs of a page's boxes that overlap."""
    box = ("x0", "y0", "x1", "y1")
    own = boxes.select(*page, key, *box)
    other = boxes.select(*page, F.col(key).alias("u_key"), *[F.col(c).alias(f"u_{c}") for c in box])
    return _met(own, other, page).where(F.col(key) < F.col("u_key")).select(*page, key, "u_key", "shared")


def without_masked(texts: DataFrame, unseen: DataFrame, key: str, page: list[str] = PAGE, share: float = 0.6) -> DataFrame:
    """texts(x0, y0, x1, y1, key) of which no box of unseen(x0, y0, x1, y1) covers more than `share` of the area."""
    box = ("x0", "y0", "x1", "y1")
    met = _met(texts.select(*page, key, *box), unseen.select(*page, *[F.col(c).alias(f"u_{c}") for c in box]), page)
    masked = met.where(F.col("shared") > share * F.greatest((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), F.lit(1e-9))).select(*page, key).distinct()
    return texts.join(masked, [*page, key], "left_anti")

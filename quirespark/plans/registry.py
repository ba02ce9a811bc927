"""One query for each operator that the given tables can exercise, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import html, layout, shapes
from . import samples
from .samples import BLOCKS, PAGES, RECTS, TEXTS, load, plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_T, _R, _P, _B = (f"({plain(q)})" for q in (TEXTS, RECTS, PAGES, BLOCKS))


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_HTML = {
    "reveal": r"<!--\[if[^\]]*\]>\s*<!-->",
    "close": r"<!--\s*<!\[endif\]-->",
    "cond": r"<!--\[if.*?<!\[endif\]-->",
}


def _sanitize_sql() -> str:
    paired = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in html.PAIRED)
    single = r"<(?:" + "|".join(html.SINGLE) + r")\b[^>]*>"
    on = r"\son[a-z]+\s*=\s*(?:\"[^\"]*\"|''[^'']*''|[^\s>]+)"
    link = r"\s(?:href|action)\s*=\s*(?:\"\s*javascript:[^\"]*\"|''\s*javascript:[^'']*'')"
    srcset = r"\ssrcset\s*=\s*(?:\"[^\"]*\"|''[^'']*'')"
    office = r"</?(?:v|o|w|m|x|st1):[a-z0-9_-]+\b[^>]*>"
    sub = lambda x, p: f"regexp_replace({x}, '{p}', '', 'gis')"
    count = lambda x, p: f"len(regexp_extract_all({x}, '(?is){p}'))"
    return f"""
WITH a AS (SELECT page_id, {sub(sub("html", _HTML["reveal"]), _HTML["close"])} AS h FROM pages),
b AS (SELECT page_id, {count("h", _HTML["cond"])} AS mso_blocks, {sub("h", _HTML["cond"])} AS h FROM a),
c AS (SELECT page_id, mso_blocks, {count("h", paired)} AS n1, {sub("h", paired)} AS h FROM b),
d AS (SELECT page_id, mso_blocks, n1 + {count("h", single)} AS blocked_scripts, {sub(sub(sub("h", single), on), link)} AS h FROM c),
e AS (SELECT page_id, mso_blocks, blocked_scripts, {count("h", office)} AS office_tags, {sub(sub("h", office), srcset)} AS h FROM d)
SELECT page_id, mso_blocks, blocked_scripts, office_tags, {count("h", "@import[^;]+;")} AS blocked_imports, md5({sub("h", "@import[^;]+;")}) AS html_md5 FROM e"""


@query(_sanitize_sql())
def h1_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.sanitize(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "mso_blocks", "blocked_scripts", "office_tags", "blocked_imports", F.md5("html").alias("html_md5"))


# -- filters ----------------------------------------------------------------------------------

_DROPPED = """CASE WHEN hidden THEN 'hidden-layer' WHEN invisible THEN 'invisible' WHEN clip_x0 IS NOT NULL
  AND greatest(0, least(x1, clip_x1) - greatest(x0, clip_x0)) * greatest(0, least(y1, clip_y1) - greatest(y0, clip_y0)) <= 0 AND (x1 - x0) * (y1 - y0) > 0.5 THEN 'clipped' END"""
_VISIBLE = f"(SELECT * FROM (SELECT *, {_DROPPED} AS dropped FROM {_T}) WHERE dropped IS NULL AND (rot < 3 OR rot > 357))"


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.visible(load(spark, sf_dir, TEXTS)).where(layout.is_flat())


@query(f"SELECT doc_id, page_no, count(*) FILTER (d = 'hidden-layer') AS n_hidden_layer, count(*) FILTER (d = 'invisible') AS n_invisible, count(*) FILTER (d = 'clipped') AS n_clipped FROM (SELECT *, {_DROPPED} AS d FROM {_T}) GROUP BY 1, 2")
def f1_dropped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dropped_counts(load(spark, sf_dir, TEXTS))


@query(f"SELECT doc_id, page_no, seq FROM {_VISIBLE}")
def f4_visible_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(spark, sf_dir).select("doc_id", "page_no", "seq")


@query(f"SELECT doc_id, page_no, seq, CASE WHEN (y0 - 0.78 * size) / 792 <= 0.12 THEN 'header' WHEN (y0 + 0.22 * size) / 792 >= 0.88 THEN 'footer' ELSE 'body' END AS band FROM {_T}")
def f12_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, TEXTS)
    top, bottom = F.col("y0") - G.ascent(F.lit(None).cast("double")) * F.col("size"), F.col("y0") + G.descent(F.lit(None).cast("double")) * F.col("size")
    band = F.when(top / 792 <= layout.BAND, "header").when(bottom / 792 >= 1 - layout.BAND, "footer").otherwise("body")
    return t.select("doc_id", "page_no", "seq", band.alias("band"))


# -- lines ------------------------------------------------------------------------------------

_LINES = f"(SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY y0) - 1 AS line_id FROM {_VISIBLE})"
_GAPS = f"""(SELECT *, CASE WHEN gap > greatest(0.2 * greatest(size, psize), 1.8 * med) THEN ' ' ELSE '' END AS sep FROM (
  SELECT *, CASE WHEN count(wide) OVER l >= 3 THEN median(wide) OVER l ELSE 0 END AS med FROM (SELECT *, CASE WHEN gap > 0.01 THEN gap END AS wide FROM (
    SELECT *, x0 - lag(x1) OVER w AS gap, lag(size) OVER w AS psize FROM {_LINES} WINDOW w AS (PARTITION BY doc_id, page_no, line_id ORDER BY x0, seq)))
  WINDOW l AS (PARTITION BY doc_id, page_no, line_id)))"""


@query(f"SELECT doc_id, page_no, seq, line_id, y0 AS baseline FROM {_LINES}")
def w6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.assign_lines(_visible(spark, sf_dir)).select("doc_id", "page_no", "seq", "line_id", G.round_half_up("baseline", 6).alias("baseline"))


@query(f"SELECT doc_id, page_no, seq, sep FROM {_GAPS}")
def w1_word_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.gaps(layout.assign_lines(_visible(spark, sf_dir))).select("doc_id", "page_no", "seq", "sep")


_SUMMARY = f"""(SELECT doc_id, page_no, line_id, string_agg(sep || text, '' ORDER BY x0, seq) AS text, min(x0) AS x0, max(x1) AS x1, min(y0 - 0.78 * size) AS top, max(y0 + 0.22 * size) AS bottom, median(size) AS size, max(size) AS max_size,
  count(DISTINCT size) AS n_sizes, bool_or(bold) AS bold, bool_and(bold) AS all_bold, min(seq) AS seq, count(*) AS n_parts FROM {_GAPS} GROUP BY 1, 2, 3)"""


def _line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.summarize_lines(layout.gaps(layout.assign_lines(_visible(spark, sf_dir))))


@query(f"SELECT doc_id, page_no, line_id, text, x0, x1, floor(top * 1000 + 0.5) / 1000 AS top, floor(bottom * 1000 + 0.5) / 1000 AS bottom, size, max_size, n_sizes, bold, all_bold, seq, n_parts FROM {_SUMMARY}")
def a4_line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_summary(spark, sf_dir).select("doc_id", "page_no", "line_id", "text", "x0", "x1", G.round_half_up("top", 3).alias("top"), G.round_half_up("bottom", 3).alias("bottom"), "size", "max_size", "n_sizes", "bold", "all_bold", "seq", "n_parts")


@query(f"""SELECT doc_id, page_no, line_id, color FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, line_id ORDER BY n DESC, f, color) AS p
  FROM (SELECT doc_id, page_no, line_id, color, count(*) AS n, min(x0) AS f FROM {_LINES} GROUP BY 1, 2, 3, 4)) WHERE p = 1""")
def m10_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.most_common("color", "x0", ["doc_id", "page_no", "line_id"], layout.assign_lines(_visible(spark, sf_dir)))


@query()
def w7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.summarize_paragraphs(layout.assign_paragraphs(_line_summary(spark, sf_dir)))


@query()
def w8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.summarize_blocks(layout.assign_blocks(layout.summarize_paragraphs(layout.assign_paragraphs(_line_summary(spark, sf_dir)))))


@query(f"""SELECT doc_id, page_no, run_id, font, bold, color, string_agg(text, '' ORDER BY y0, x0, seq) AS text, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN f = pf AND b = pb AND c = pc OR pf IS NULL THEN 0 ELSE 1 END) OVER w AS run_id FROM (
    SELECT *, font AS f, bold AS b, color AS c, lag(font) OVER w AS pf, lag(bold) OVER w AS pb, lag(color) OVER w AS pc FROM {_T} WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y0, x0, seq))
  WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y0, x0, seq)) GROUP BY 1, 2, 3, 4, 5, 6""")
def w9_run_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.coalesce_runs(load(spark, sf_dir, TEXTS), ["doc_id", "page_no"], ["y0", "x0", "seq"], ["font", "bold", "color"])


@query(f"SELECT doc_id, page_no, line_id, seq, y0 - lag(y0) OVER (PARTITION BY doc_id, page_no ORDER BY line_id) AS lead FROM (SELECT doc_id, page_no, line_id, y0, min(seq) AS seq FROM {_LINES} GROUP BY ALL)")
def w11_line_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _line_summary(spark, sf_dir)
    gap = F.col("baseline") - F.lag("baseline").over(Window.partitionBy("doc_id", "page_no").orderBy("line_id"))
    return lines.select("doc_id", "page_no", "line_id", "seq", G.round_half_up(gap, 6).alias("lead"))


@query(f"""SELECT doc_id, page_no, pos, cluster, floor(avg(pos) OVER (PARTITION BY doc_id, page_no, cluster) * 1000 + 0.5) / 1000 AS center FROM (
  SELECT *, CAST(sum(CASE WHEN d > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS BIGINT) AS cluster FROM (
    SELECT doc_id, page_no, pos, pos - lag(pos) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS d FROM (SELECT DISTINCT doc_id, page_no, x0 + x1 AS pos FROM {_T})))""")
def w2_cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = load(spark, sf_dir, TEXTS).select("doc_id", "page_no", (F.col("x0") + F.col("x1")).alias("pos")).distinct()
    return layout.cluster_1d(values, "pos", 10.0).withColumn("center", G.round_half_up("center", 3))


_CELLS = f"""(SELECT doc_id, page_no, line_id, cell, trim(string_agg(CASE WHEN new = 0 AND gap > 0.2 * s THEN ' ' ELSE '' END || text, '' ORDER BY x0, seq)) AS text, min(x0) AS x0, max(x1) AS x1 FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id, page_no, line_id ORDER BY x0, seq) AS BIGINT) AS cell FROM (SELECT *, CASE WHEN gap > 1.6 * s THEN 1 ELSE 0 END AS new FROM (
    SELECT *, x0 - lag(x1) OVER (PARTITION BY doc_id, page_no, line_id ORDER BY x0, seq) AS gap, median(size) OVER (PARTITION BY doc_id, page_no, line_id) AS s FROM {_LINES}))) GROUP BY 1, 2, 3, 4)"""


@query(f"SELECT doc_id, page_no, line_id, cell, text, x0, x1 FROM {_CELLS}")
def w3_row_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = layout.gaps(layout.assign_lines(_visible(spark, sf_dir)))
    return shapes.segments(parts, layout.summarize_lines(parts))


@query()
def d4_unruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = layout.gaps(layout.assign_lines(_visible(spark, sf_dir)))
    lines = layout.summarize_lines(parts)
    return shapes.unruled_tables(lines, shapes.segments(parts, lines))


# -- pages ------------------------------------------------------------------------------------


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf_dir, BLOCKS), load(spark, sf_dir, PAGES)


_COLUMNS = f"""(WITH b AS (SELECT * FROM {_B} WHERE x1 - x0 > 2),
span AS (SELECT doc_id, page_no, min(x0) AS lo, max(x1) AS hi, max(bottom) - min(top) AS span, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) >= 4 AND max(x1) - min(x0) >= 0.3 * 612),
cover AS (SELECT doc_id, page_no, bin, sum(bottom - top) AS c FROM (SELECT b.*, unnest(range(CAST(greatest(0, floor((x0 - lo) / ((hi - lo) / 400))) AS BIGINT), CAST(least(399, ceil((x1 - lo) / ((hi - lo) / 400))) AS BIGINT) + 1)) AS bin FROM b JOIN span USING (doc_id, page_no)) GROUP BY 1, 2, 3),
dense AS (SELECT *, (hi - lo) / 400 AS step FROM (SELECT *, unnest(range(0, 400)) AS bin FROM span) LEFT JOIN cover USING (doc_id, page_no, bin)),
runs AS (SELECT doc_id, page_no, min(bin) AS a, max(bin) + 1 AS b, any_value(lo) AS lo, any_value(step) AS step FROM (SELECT *, bin - row_number() OVER (PARTITION BY doc_id, page_no ORDER BY bin) AS g FROM dense WHERE coalesce(c, 0) <= 0.02 * span) GROUP BY doc_id, page_no, g),
gut AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY (b - a) * step DESC, a) AS p FROM runs WHERE (b - a) * step > 0.015 * 612 AND a > 2 AND b < 398),
edges AS (SELECT doc_id, page_no, list(lo + step * (a + b) / 2 ORDER BY a) AS mid FROM gut WHERE p <= 3 AND (b - a) * step > 0.02 * 612 GROUP BY 1, 2),
held AS (SELECT doc_id, page_no, list_concat([lo], mid, [hi]) AS bounds FROM span JOIN edges USING (doc_id, page_no)),
cnt AS (SELECT doc_id, page_no, bounds, len(list_filter(bounds, lambda x: x <= (x0 + x1) / 2)) AS k, count(*) AS c FROM b JOIN held USING (doc_id, page_no) WHERE (x0 + x1) / 2 < bounds[-1] GROUP BY 1, 2, 3, 4),
ok AS (SELECT doc_id, page_no, bounds, count(*) AS filled, min(c) AS least FROM cnt GROUP BY 1, 2, 3 HAVING count(*) FILTER (c >= 2) >= 2)
SELECT p.doc_id, p.page_no, coalesce(len(bounds) - 1, 1)::BIGINT AS n_columns, CASE WHEN bounds IS NULL THEN 0 ELSE least(0.95, 0.45 + 0.15 * least(len(bounds) - 1, 3) + CASE WHEN least >= 3 AND filled = len(bounds) - 1 THEN 0.2 ELSE 0 END) END AS confidence, bounds
FROM {_P} AS p LEFT JOIN ok USING (doc_id, page_no))"""


@query(f"SELECT doc_id, page_no, n_columns, floor(confidence * 1000 + 0.5) / 1000 AS confidence FROM {_COLUMNS}")
def d1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.columns(*_blocks(spark, sf_dir))
    return found.select("doc_id", "page_no", "n_columns", G.round_half_up("confidence", 3).alias("confidence"))


_ROLES = f"""(WITH b AS (SELECT *, CASE WHEN top / 792 <= 0.12 THEN 'header' WHEN bottom / 792 >= 0.88 THEN 'footer' END AS band,
  substr(trim(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')), 1, 60) AS key FROM {_B}),
n AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM {_P} GROUP BY 1),
h AS (SELECT doc_id, band, key, count(DISTINCT page_no) AS hits FROM b WHERE band IS NOT NULL GROUP BY 1, 2, 3),
ok AS (SELECT doc_id, band, key, least(0.95, hits / n) AS conf FROM h JOIN n USING (doc_id) WHERE n >= 3 AND hits >= greatest(3, ceil(n / 2)))
SELECT b.*, CASE WHEN conf IS NOT NULL THEN b.band WHEN n >= 3 AND regexp_matches(trim(text), '^[-—–\\s]*[0-9]{{1,4}}[-—–\\s]*$') AND (top / 792 <= 0.1 OR bottom / 792 >= 0.9) THEN CASE WHEN bottom / 792 >= 0.9 THEN 'footer' ELSE 'header' END END AS role,
  conf, conf IS NULL AND n >= 3 AND regexp_matches(trim(text), '^[-—–\\s]*[0-9]{{1,4}}[-—–\\s]*$') AND (top / 792 <= 0.1 OR bottom / 792 >= 0.9) AS is_page_number
FROM b JOIN n USING (doc_id) LEFT JOIN ok ON ok.doc_id = b.doc_id AND ok.band = b.band AND ok.key = b.key)"""


@query(f"SELECT doc_id, page_no, block_id, role, CASE WHEN is_page_number THEN 0.8 ELSE conf END AS role_confidence, is_page_number FROM {_ROLES}")
def a2_headers_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.roles(*_blocks(spark, sf_dir)).select("doc_id", "page_no", "block_id", "role", "role_confidence", "is_page_number")


@query(f"""SELECT doc_id, page_no, block_id, col AS "column", CASE WHEN role IS NULL THEN row_number() OVER (PARTITION BY doc_id, page_no, role IS NULL ORDER BY col, top, x0, block_id) END AS read_index FROM (
  SELECT r.*, CASE WHEN bounds IS NULL THEN 0 ELSE greatest(0, least(len(list_filter(bounds, lambda x: x <= (x0 + x1) / 2)), len(bounds) - 1) - 1) END::BIGINT AS col FROM {_ROLES} AS r JOIN {_COLUMNS} AS c USING (doc_id, page_no))""")
def w12_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, pages = _blocks(spark, sf_dir)
    return layout.reading_order(layout.roles(blocks, pages), layout.columns(blocks, pages)).select("doc_id", "page_no", "block_id", "column", "read_index")


@query(f"""SELECT doc_id, page_no, kind, id, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq, CASE kind WHEN 'text' THEN 1 ELSE 5 END, id) AS z FROM (
  SELECT doc_id, page_no, 'text' AS kind, seq, seq AS id FROM {_T} UNION ALL SELECT doc_id, page_no, 'shape', seq, seq FROM {_R})""")
def w13_z_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda df, kind: df.select("doc_id", "page_no", F.lit(kind).alias("kind"), "seq", F.col("seq").alias("id"))
    both = of(load(spark, sf_dir, TEXTS), "text").unionByName(of(load(spark, sf_dir, RECTS), "shape"))
    return layout.z_order(both).select("doc_id", "page_no", "kind", "id", "z")


@query(f"""SELECT doc_id, color, weight, floor(share * 1e6 + 0.5) / 1e6 AS share, place FROM (SELECT *, weight / sum(weight) OVER (PARTITION BY doc_id) AS share, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, color) AS place FROM (
  SELECT doc_id, color, sum(weight) AS weight FROM (SELECT doc_id, fill AS color, floor(greatest(1, w * h)) AS weight FROM {_R} UNION ALL SELECT doc_id, stroke, floor(greatest(1, w * h) * 15 / 100) FROM {_R}
    UNION ALL SELECT doc_id, color, (x1 - x0) * size * 3 FROM {_T}) WHERE color IS NOT NULL GROUP BY 1, 2)) WHERE place <= 12""")
def a1_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects, texts = load(spark, sf_dir, RECTS), load(spark, sf_dir, TEXTS)
    size = F.greatest(F.lit(1.0), F.col("w") * F.col("h"))
    colors = rects.select("doc_id", F.col("fill").alias("color"), F.floor(size).cast("double").alias("weight"))
    colors = colors.unionAll(rects.select("doc_id", "stroke", F.floor(size * 15 / 100).cast("double"))).unionAll(texts.select("doc_id", "color", (F.col("x1") - F.col("x0")) * F.col("size") * 3))
    return layout.palette(colors).withColumn("share", G.round_half_up("share", 6))


@query("SELECT role, font, n_chars, place FROM (SELECT role, font, n_chars, row_number() OVER (PARTITION BY role ORDER BY n_chars DESC, font) AS place FROM (SELECT role, 'turn' || turn AS font, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY 1, 2)) WHERE place <= 14")
def a16_fonts_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("font"), "text")
    return layout.fonts_used(texts, ["role"]).select("role", "font", "n_chars", F.col("place").cast("long").alias("place"))


# -- shapes -----------------------------------------------------------------------------------

_RULES = f"""(SELECT doc_id, page_no, CASE WHEN h <= greatest(2.5, 1.6 * line_width) AND w > 6 THEN 'h' WHEN w <= greatest(2.5, 1.6 * line_width) AND h > 6 THEN 'v' END AS orient, x0, y0, x1, y1, w, h, line_width, stroke AS color, false AS filled, seq FROM {_R} WHERE stroke IS NOT NULL
  UNION ALL SELECT doc_id, page_no, CASE WHEN h <= 3.2 AND w > 6 THEN 'h' WHEN w <= 3.2 AND h > 6 THEN 'v' END, x0, y0, x1, y1, w, h, 0, fill, true, seq FROM {_R} WHERE fill IS NOT NULL)"""


@query(f"""SELECT doc_id, page_no, orient, CASE orient WHEN 'h' THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END AS pos, CASE orient WHEN 'h' THEN x0 ELSE y0 END AS lo, CASE orient WHEN 'h' THEN x1 ELSE y1 END AS hi, CASE orient WHEN 'h' THEN w ELSE h END AS len,
  CASE WHEN filled THEN CASE orient WHEN 'h' THEN h ELSE w END ELSE greatest(line_width, CASE orient WHEN 'h' THEN h ELSE w END) END AS thick, color, filled, seq FROM {_RULES} WHERE orient IS NOT NULL""")
def d2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.rules(samples.rect_paths(spark, sf_dir))


_SHAPES = f"""(SELECT *, w * h AS area, CASE WHEN fill IS NOT NULL AND w * h > 0.88 * 612 * 792 AND w > 0.93 * 612 AND h > 0.93 * 792 THEN 'background' WHEN least(w, h) <= 3.2 AND greatest(w, h) > 6 THEN CASE WHEN w >= h THEN 'h-line' ELSE 'v-line' END
  WHEN abs(w - h) / greatest(w, h) < 0.02 THEN 'square' ELSE 'rectangle' END AS shape FROM {_R})"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.classify(samples.rect_paths(spark, sf_dir), load(spark, sf_dir, PAGES))


@query(f"SELECT doc_id, page_no, seq, shape, CASE WHEN shape IN ('background', 'h-line', 'v-line') THEN 0.9 ELSE 0.95 END AS shape_confidence, area FROM {_SHAPES}")
def d6_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("doc_id", "page_no", "seq", "shape", "shape_confidence", "area")


@query(f"SELECT doc_id, page_no, seq, shape FROM {_SHAPES} WHERE greatest(w * h, w + h) >= 0.00004 * 612 * 792 OR shape IN ('h-line', 'v-line')")
def f5_specks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.drop_specks(_classified(spark, sf_dir), load(spark, sf_dir, PAGES)).select("doc_id", "page_no", "seq", "shape")


def _bars(axis: str, base: str, length: str) -> str:
    return f"""SELECT doc_id, page_no, bar_width, '{axis}' AS guess, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(seq) AS seq FROM (
      SELECT *, median({base}) OVER (PARTITION BY doc_id, page_no, bar_width) AS m FROM bars) WHERE abs({base} - m) < 1.5 GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND count(DISTINCT floor({length} + 0.5)) >= 2"""


_CHARTS = f"""(WITH bars AS (SELECT *, floor(2 * w + 0.5) / 2 AS bar_width FROM {_SHAPES} WHERE shape IN ('rectangle', 'square') AND fill IS NOT NULL AND area > 4 AND area < 0.5 * 612 * 792),
  up AS ({_bars("bars-vertical", "y1", "h")}), across AS ({_bars("bars-horizontal", "x0", "w")})
  SELECT *, least(0.8, 0.4 + 0.05 * n) AS confidence FROM (SELECT * FROM up UNION ALL SELECT * FROM across ANTI JOIN up USING (doc_id, page_no, bar_width)))"""


@query(f"SELECT doc_id, page_no, bar_width, guess, n, x0, y0, x1, y1, seq, floor(confidence * 1000 + 0.5) / 1000 AS confidence FROM {_CHARTS}")
def d8_bar_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.bar_charts(_classified(spark, sf_dir), load(spark, sf_dir, PAGES)).drop("series").withColumn("confidence", G.round_half_up("confidence", 3))


@query(f"""SELECT doc_id, page_no, chart_id, len(list(text)) AS n_labels, md5(string_agg(text, '|' ORDER BY top, lx0, text)) AS labels_md5 FROM (
  SELECT c.doc_id, c.page_no, c.seq AS chart_id, l.text, l.top, l.x0 AS lx0 FROM {_CHARTS} AS c JOIN {_SUMMARY} AS l USING (doc_id, page_no)
  WHERE greatest(0, least(l.x1, c.x1 + 40) - greatest(l.x0, c.x0 - 40)) * greatest(0, least(l.bottom, c.y1 + 30) - greatest(l.top, c.y0 - 25)) > 0) GROUP BY 1, 2, 3""")
def j15_chart_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    charts = shapes.bar_charts(_classified(spark, sf_dir), load(spark, sf_dir, PAGES)).withColumn("chart_id", F.col("seq"))
    found = shapes.near_labels(charts, _line_summary(spark, sf_dir)).where("labels is not null")
    return found.select("doc_id", "page_no", "chart_id", F.size("labels").cast("long").alias("n_labels"), F.md5(F.array_join("labels", "|")).alias("labels_md5"))


@query()
def l5_chart_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    charts = shapes.bar_charts(_classified(spark, sf_dir), load(spark, sf_dir, PAGES)).withColumn("id", F.col("seq"))
    return shapes.suppress(charts).select("doc_id", "page_no", "id", "guess", "confidence")


_FRAMES = """(SELECT p.doc_id, p.page_no, [0e0, 130e0, 260e0, 390e0, 520e0] AS xs, [0e0, 200e0, 400e0, 600e0, 800e0] AS ys FROM (SELECT DISTINCT doc_id, page_no FROM {t}) AS p)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, PAGES).select("doc_id", "page_no", F.array(*[F.lit(130.0 * i) for i in range(5)]).alias("col_xs"), F.array(*[F.lit(200.0 * i) for i in range(5)]).alias("row_ys"))


_PLACED = f"""(SELECT *, list_min(list_filter(range(0, 4), lambda i: px >= 130 * i - 1 AND px <= 130 * (i + 1) + 1)) AS c, list_min(list_filter(range(0, 4), lambda i: py >= 200 * i - 1 AND py <= 200 * (i + 1) + 1)) AS r
  FROM (SELECT *, (x0 + x1) / 2 AS px, y0 - 0.35 * size AS py FROM {_LINES}))"""


@query(f"SELECT doc_id, page_no, seq, r::INTEGER AS r, c::INTEGER AS c FROM {_PLACED} WHERE r IS NOT NULL AND c IS NOT NULL")
def j10_text_to_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.place_in_cells(layout.assign_lines(_visible(spark, sf_dir)), _frames(spark, sf_dir)).select("doc_id", "page_no", "seq", "r", "c")


@query(f"""SELECT doc_id, page_no, r::INTEGER AS r, c::INTEGER AS c, median(size) AS size, bool_and(bold) AS bold, CASE WHEN abs((min(x0) - 130 * c) / 130 - (130 * (c + 1) - max(x1)) / 130) < 0.1 THEN 'center' WHEN (130 * (c + 1) - max(x1)) / 130 < 0.5 * (min(x0) - 130 * c) / 130 THEN 'right' ELSE 'left' END AS align
  FROM {_PLACED} WHERE r IS NOT NULL AND c IS NOT NULL GROUP BY doc_id, page_no, r, c""")
def a7_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.cells(shapes.place_in_cells(layout.assign_lines(_visible(spark, sf_dir)), _frames(spark, sf_dir))).drop("text")


@query()
def d3_ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = shapes.table_frames(shapes.rules(samples.rect_paths(spark, sf_dir)))
    found = shapes.cells(shapes.place_in_cells(layout.assign_lines(_visible(spark, sf_dir)), frames))
    return shapes.ruled_tables(frames, found).select("doc_id", "page_no", "n_rows", "n_cols", "n_filled", "confidence")


@query(f"SELECT doc_id, page_no, seq FROM {_R} AS p ANTI JOIN (SELECT * FROM {_RULES} WHERE orient IS NOT NULL) AS u USING (doc_id, page_no, seq)")
def j12_paths_without_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = samples.rect_paths(spark, sf_dir)
    return shapes.without_rules(paths, shapes.rules(paths)).select("doc_id", "page_no", "seq")


# -- scalars over given columns ---------------------------------------------------------------


@query("SELECT p_partkey, floor(p_retailprice * (254e-2 / 72e0) * 100 + 0.5) / 100 AS cm, floor(p_retailprice * (1e0 / 72e0) * 1000 + 0.5) / 1000 AS inch, floor(p_retailprice * 10 + 0.5) / 10 AS pt, floor(p_retailprice * 12700 + 0.5) AS emu FROM part")
def m8_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", *[G.to_unit("p_retailprice", u).alias(n) for u, n in (("cm", "cm"), ("in", "inch"), ("pt", "pt"), ("emu", "emu"))])


_HEX = "upper(lpad(printf('%x', CAST(floor({} * 255 + 0.5) AS INTEGER)), 2, '0'))"


@query(f"SELECT p_partkey, '#' || {_HEX.format('(p_size % 51) / 50')} || {_HEX.format('(p_partkey % 256) / 255')} || {_HEX.format('(p_partkey % 11) / 10')} AS hex FROM part")
def m3_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", G.rgb_hex(F.col("p_size") % 51 / 50, F.col("p_partkey") % 256 / 255, F.col("p_partkey") % 11 / 10).alias("hex"))


@query("""SELECT s_suppkey, w, h, CASE WHEN abs(w - 595) < 8 AND abs(h - 842) < 8 OR abs(w - 842) < 8 AND abs(h - 595) < 8 THEN 'A4' WHEN abs(w - 612) < 8 AND abs(h - 792) < 8 OR abs(w - 792) < 8 AND abs(h - 612) < 8 THEN 'Letter'
  WHEN abs(w - 842) < 8 AND abs(h - 1191) < 8 OR abs(w - 1191) < 8 AND abs(h - 842) < 8 THEN 'A3' WHEN abs(w - 720) < 8 AND abs(h - 540) < 8 THEN '4:3' WHEN abs(w - 960) < 8 AND abs(h - 540) < 8 OR abs(w - 720) < 8 AND abs(h - 405) < 8 THEN '16:9'
  WHEN abs(w / h - 16 / 9) < 0.03 THEN '~16:9' WHEN abs(w / h - 4 / 3) < 0.03 THEN '~4:3' END AS paper,
  floor(least(960 / w, 540 / h) * 10000 + 0.5) / 10000 AS scale FROM (SELECT s_suppkey, (500 + s_suppkey * 37 % 700)::DOUBLE AS w, (400 + s_suppkey * 53 % 800)::DOUBLE AS h FROM supplier)""")
def m11_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (500 + F.col("s_suppkey") * 37 % 700).cast("double").alias("w"), (400 + F.col("s_suppkey") * 53 % 800).cast("double").alias("h"))
    return s.withColumn("paper", G.paper("w", "h")).withColumn("scale", G.round_half_up(G.fit("w", "h", "16:9")[0], 4))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def c10_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.lower(F.hex(X.md5_bytes("text"))).alias("md5"), F.lower(F.hex(X.sha_bytes("text"))).alias("sha256"))


@query("SELECT page_id, base64(encode(html)) AS b64, length(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS n_escaped FROM pages")
def c18_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    escaped = F.replace(F.replace(F.replace(F.col("html"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return p.select("page_id", F.regexp_replace(F.base64(F.encode("html", "UTF-8")), r"\s", "").alias("b64"), F.length(escaped).cast("long").alias("n_escaped"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.(pptx|potx)$') THEN 'pptx' WHEN regexp_matches(lower(url), '\\.(mht|mhtml|htm|html)$') THEN 'html' WHEN regexp_matches(lower(url), '\\.(png|jpe?g|gif|bmp|webp|svg)$') THEN 'image'
  WHEN regexp_matches(lower(url), '\\.ppt$') THEN 'ppt-unsupported' ELSE 'other' END AS kind, substr(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\\\]*)$', 1), 1, 80) AS name FROM pages""")
def s1_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.file_kind("url").alias("kind"), X.safe_name("url").alias("name"))


@query("""SELECT doc_id, key, count(*) AS n, count(DISTINCT line) AS n_distinct FROM (SELECT doc_id, line, substr(trim(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')), 1, 60) AS key FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE key <> '' GROUP BY 1, 2 HAVING count(*) > 1""")
def a2_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("key", X.repeat_key("line")).where("key <> ''")
    return lines.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.count_distinct("line").alias("n_distinct")).where("n > 1")


@query("""SELECT page_id, greatest(0, floor(y / 506.25))::BIGINT + 1 AS page_no, y + h > (greatest(0, floor(y / 506.25)) + 1) * 506.25 AS spans_page FROM (SELECT page_id, (length(html) % 5000)::DOUBLE AS y, (page_id % 400)::DOUBLE AS h FROM pages)""")
def h11_paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", (F.length("html") % 5000).cast("double").alias("y"), (F.col("page_id") % 400).cast("double").alias("h"))
    return html.paginate(items, 900.0).select("page_id", "page_no", "spans_page")


@query("""SELECT e.event_id, coalesce(a.n_name, b.n_name, c.n_name) AS found, CASE WHEN a.n_name IS NOT NULL THEN 1 WHEN b.n_name IS NOT NULL THEN 2 WHEN c.n_name IS NOT NULL THEN 3 END AS level
  FROM events e LEFT JOIN nation a ON a.n_nationkey = e.user_id LEFT JOIN nation b ON b.n_nationkey = e.user_id - 20 LEFT JOIN nation c ON c.n_nationkey = e.user_id % 40""")
def j4_priority_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import priority

    events, nation = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    keyed = events.select("event_id", F.col("user_id").alias("k1"), (F.col("user_id") - 20).alias("k2"), (F.col("user_id") % 40).alias("k3"))
    out = priority(keyed, nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("value")), ["k1", "k2", "k3"])
    return out.select("event_id", F.col("value").alias("found"), "level")


@query("""SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'O') AS priority, arg_min(o_totalprice, o_orderkey) FILTER (o_totalprice > 100000) AS price FROM orders GROUP BY 1""")
def j5_property_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import first_defined

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"))
    return first_defined(o, ["o_custkey"], "o_orderkey", ["priority", "price"])


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations""")
def w15_section_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.joins import carried

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return carried(c, ["conv_id"], "turn", {"section": F.when(F.col("role") == "user", F.col("turn"))}).select("conv_id", "turn", "role", "section")


# -- more scalars, over values derived from keys ----------------------------------------------


@query("SELECT conv_id, turn, 'last' || turn AS a, 'x' || role || ' more' AS b, 'text/html' AS mime, 'utf-8' AS charset FROM conversations")
def c22_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    block = F.concat(F.lit("A: first\r\nB: x"), "role", F.lit("\r\n\tmore\r\nno header\r\nContent-Type: Text/HTML; charset=\"UTF-8\"\r\na: last"), F.col("turn").cast("string"))
    h = c.select("conv_id", "turn", X.headers(block).alias("h"))
    return h.select("conv_id", "turn", F.element_at("h", "a").alias("a"), F.element_at("h", "b").alias("b"), X.mime_type("h").alias("mime"), X.charset(F.element_at("h", "content-type")).alias("charset"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Arial' WHEN 1 THEN 'Times New Roman' WHEN 2 THEN 'Courier New' WHEN 3 THEN 'SimSun' WHEN 4 THEN 'Foo-Bold' ELSE 'Calibri' END AS font,
  p_partkey % 6 IN (1, 4) OR p_size >= 48 AS bold, p_partkey % 6 = 5 AS italic FROM part""")
def c30_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["ABCDEF+ArialMT", "TimesNewRomanPS-BoldMT", "Courier New", "SimSun", "Foo-Bold", "Calibri-Italic"]
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6).cast("int")).alias("raw"))
    return p.select("p_partkey", X.font_name("raw").alias("font"), X.is_bold("raw", F.col("p_size") * 12.5).alias("bold"), X.is_italic("raw").alias("italic"))


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'slides' WHEN 1 THEN 'document' WHEN 2 THEN 'latex' WHEN 3 THEN 'scan' END AS origin, CASE WHEN s_suppkey % 2 = 0 THEN 'Segoe UI' ELSE 'Arial' END AS font FROM supplier")
def d13_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("s_suppkey") % len(v)).cast("int"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select("s_suppkey", X.origin(pick("Microsoft PowerPoint", "Writer", "TeX", "Office", "x"), pick("", "WPS", "pdfTeX-1.40", "HP Scanner", "y")).alias("origin"), X.first_font(pick("serif, 'Segoe UI', Arial", "Arial, sans-serif")).alias("font"))


@query("""SELECT p_partkey, floor((1 - c) * (1 - k) * 1e6 + 0.5) / 1e6 AS cmyk_r, floor(h * 1e6 + 0.5) / 1e6 AS h, floor(s * 1e6 + 0.5) / 1e6 AS s, floor(l * 1e6 + 0.5) / 1e6 AS l
  FROM (SELECT p_partkey, (p_partkey % 11) / 10e0 AS c, (p_size % 7) / 10e0 AS k, (p_partkey % 97) / 97e0 AS h, 0.1e0 + (p_size % 8) / 10e0 AS s, 0.1e0 + (p_partkey % 8) / 10e0 AS l FROM part)""")
def m2_color_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = F.col("p_partkey"), F.col("p_size")
    back = G.rgb_hsl(*G.hsl_rgb((key % 97) / 97.0, 0.1 + (size % 8) / 10.0, 0.1 + (key % 8) / 10.0))
    r = lambda c, n: G.round_half_up(c, 6).alias(n)
    return p.select("p_partkey", r(G.cmyk_rgb((key % 11) / 10.0, F.lit(0.0), F.lit(0.0), (size % 7) / 10.0)[0], "cmyk_r"), *[r(c, n) for c, n in zip(back, ("h", "s", "l"), strict=True)])


@query(f"""SELECT a.doc_id, a.page_no, count(*) AS n, sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS shared FROM {_R} AS a JOIN {_R} AS b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.y0 = b.y0 AND a.seq < b.seq
  WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY 1, 2""")
def m6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, RECTS)
    other = r.select("doc_id", "page_no", "y0", *[F.col(c).alias(f"o_{c}") for c in ("seq", "x0", "x1", "y1")])
    both = r.join(other, ["doc_id", "page_no", "y0"]).where("seq < o_seq").withColumn("shared", G.overlap(("x0", "y0", "x1", "y1"), ("o_x0", "y0", "o_x1", "o_y1"))).where("shared > 0")
    return both.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.sum("shared").alias("shared"))


@query("""SELECT s_suppkey, CASE WHEN r IN (0, 180) THEN 612 ELSE 792 END::DOUBLE AS w, CASE WHEN r IN (0, 180) THEN 792 ELSE 612 END::DOUBLE AS h,
  CASE r WHEN 0 THEN x WHEN 90 THEN y WHEN 180 THEN 612 - x ELSE 792 - y END::DOUBLE AS px, CASE r WHEN 0 THEN 792 - y WHEN 90 THEN x WHEN 180 THEN y ELSE 612 - x END::DOUBLE AS py FROM (SELECT s_suppkey, (s_suppkey % 4) * 90 AS r, s_suppkey % 600 AS x, s_suppkey * 7 % 700 AS y FROM supplier)""")
def r1_page_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 4 * 90).cast("int").alias("rot"), (F.col("s_suppkey") % 600).cast("double").alias("x"), (F.col("s_suppkey") * 7 % 700).cast("double").alias("y"))
    m, w, h = G.page_matrix(F.lit(0.0), F.lit(0.0), F.lit(612.0), F.lit(792.0), "rot")
    px, py = G.apply_to(F.col("m"), "x", "y")
    return s.withColumn("m", m).select("s_suppkey", w.alias("w"), h.alias("h"), px.alias("px"), py.alias("py"))


@query("SELECT page_id, md5(html) AS html_md5, md5(html) AS base64_md5, md5(url) AS hex_md5 FROM pages")
def c26_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    b64 = F.concat(F.lit("!!"), F.base64(F.encode("html", "UTF-8")), F.lit(" -"))
    return p.select("page_id", F.md5(X.unescape(X.escape("html"))).alias("html_md5"), F.md5(X.lenient_base64(b64)).alias("base64_md5"), F.md5(X.ascii_hex(F.concat(F.lit(" "), F.hex(F.encode("url", "UTF-8")), F.lit(">zz")))).alias("hex_md5"))


@query("SELECT page_id % 10 AS doc_id, page_id, url, CASE WHEN page_id % 4 = 0 THEN 'data:x' || page_id END AS data_url, CASE WHEN page_id % 4 = 0 THEN 'resolved' WHEN regexp_matches(lower(url), '^(https?:|//)') THEN 'blocked' ELSE 'missing' END AS status FROM pages")
def j9_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("doc_id", F.col("page_id") % 10).withColumn("url", F.concat("url", F.lit("?p="), F.col("page_id").cast("string")))
    own = F.when(F.col("page_id") % 8 == 0, F.col("url")).otherwise(F.concat(F.lit("cid:"), "url"))
    assets = p.where("page_id % 4 = 0").select("doc_id", own.alias("key"), F.concat(F.lit("data:x"), F.col("page_id").cast("string")).alias("data_url"))
    found = html.resolve(p.select("doc_id", "page_id", "url"), assets)
    return found.withColumn("url", F.regexp_replace("url", r"\?p=\d+$", ""))


@query("""WITH c AS (SELECT l_suppkey AS doc_id, l_orderkey AS table_id, l_linenumber % 3 AS r, l_returnflag = 'R' AS th, l_linestatus = 'F' AS b FROM lineitem),
n AS (SELECT doc_id, table_id, count(*) AS n_rows, max(n) AS n_cols FROM (SELECT doc_id, table_id, r, count(*) AS n FROM c GROUP BY 1, 2, 3) GROUP BY 1, 2),
s AS (SELECT doc_id, table_id, bool_or(th) AS th, avg(b::INT) AS b FROM c GROUP BY 1, 2),
f AS (SELECT doc_id, table_id, n_rows, n_cols, CASE WHEN n_rows < 2 OR n_cols < 2 THEN 0 WHEN th THEN 0.9 WHEN b > 0.5 THEN 0.8 WHEN n_rows >= 3 THEN 0.6 ELSE 0 END AS confidence FROM n JOIN s USING (doc_id, table_id))
SELECT doc_id, table_id, n_rows, n_cols, confidence > 0 AS is_data, confidence FROM f""")
def a14_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") % 3).alias("row"), F.lit("x").alias("text"), (F.col("l_returnflag") == "R").alias("is_header"), (F.col("l_linestatus") == "F").alias("bordered"), F.lit(False).alias("nested"))
    return html.classify_tables(c)


@query(f"""SELECT doc_id, page_no, color, n, n_more FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n DESC, color) AS p, count(*) OVER (PARTITION BY doc_id, page_no) - 2 AS n_more FROM (SELECT doc_id, page_no, color || size AS color, count(*) AS n FROM {_T} GROUP BY 1, 2, 3)) WHERE p <= 2""")
def l3_display_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = Window.partitionBy("doc_id", "page_no")
    t = load(spark, sf_dir, TEXTS).groupBy("doc_id", "page_no", F.concat("color", F.col("size").cast("string")).alias("color")).agg(F.count("*").alias("n"))
    return t.withColumn("n_more", F.count("*").over(page) - 2).withColumn("p", F.row_number().over(page.orderBy(F.desc("n"), "color"))).where("p <= 2").drop("p")

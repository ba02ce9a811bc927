"""Queries for the small relational operators, over values derived from given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import decks, html, layout, shapes
from . import samples
from .samples import RECTS, TEXTS, load, plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_PLACE = "((l_partkey * 1000000 + l_orderkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT)"
_T, _R = f"({plain(TEXTS)})", f"({plain(RECTS)})"


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""SELECT page_id, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(url) + 1), lambda i: ascii(url[i])::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS inverse FROM pages""")
def c17_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.bitwise_not(X.crc32("url")).bitwiseAND(F.lit(0xFFFFFFFF)).alias("inverse"))


@query("SELECT page_id, html_hex FROM (SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS html_hex FROM pages)")
def c26_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(X.escape("html")).alias("html_hex"))


@query(f"SELECT doc_id, page_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {_R} GROUP BY 1, 2")
def m5_page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bounds(load(spark, sf_dir, RECTS), ["doc_id", "page_no"])


@query("SELECT doc_id, count(DISTINCT w || 'x' || h) AS n_sizes, count(DISTINCT w || 'x' || h) = 1 AS uniform FROM (SELECT o_custkey AS doc_id, floor(600 + o_custkey % 3 + (o_orderkey % (1 + o_custkey % 2)) + 0.5)::BIGINT AS w, 800 AS h FROM orders) GROUP BY 1")
def a17_page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pages = o.select(F.col("o_custkey").alias("doc_id"), (600 + F.col("o_custkey") % 3 + F.col("o_orderkey") % (1 + F.col("o_custkey") % 2)).cast("double").alias("w"), F.lit(800.0).alias("h"))
    return layout.uniform_size(pages)


@query("SELECT l_suppkey AS doc_id, max(l_partkey % 700 + l_quantity)::DOUBLE AS \"right\", max(l_orderkey % 900 + l_linenumber)::DOUBLE AS bottom FROM lineitem GROUP BY 1")
def a18_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return layout.extent(li.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 700).cast("double").alias("x"), (F.col("l_orderkey") % 900).cast("double").alias("y"), F.col("l_quantity").cast("double").alias("w"), F.col("l_linenumber").cast("double").alias("h")), ["doc_id"])


@query(f"""WITH t AS (SELECT doc_id, page_no, seq, x0, y0 FROM {_T}), d AS (SELECT doc_id, page_no, floor(x0 * 10 + 0.5) AS kx, floor(y0 * 10 + 0.5) AS ky, min(seq) AS s FROM {_T} WHERE NOT hidden GROUP BY 1, 2, 3, 4)
SELECT t.doc_id, t.page_no, t.seq, coalesce(s, 10000000)::BIGINT AS draw_seq FROM t LEFT JOIN d ON d.doc_id = t.doc_id AND d.page_no = t.page_no AND d.kx = floor(t.x0 * 10 + 0.5) AND d.ky = floor(t.y0 * 10 + 0.5)""")
def j18_draw_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = load(spark, sf_dir, TEXTS)
    traced = texts.where("not hidden").select("doc_id", "page_no", F.col("x0").alias("x"), F.col("y0").alias("y"), "seq")
    return layout.draw_order(texts.select("doc_id", "page_no", "seq", "x0", "y0"), traced).select("doc_id", "page_no", "seq", "draw_seq")


@query(f"""WITH t AS (SELECT DISTINCT doc_id, page_no, seq, x0, y0, x1, y1 FROM {_T}), u AS (SELECT doc_id, page_no, x0, y0, x1, y1 FROM {_R} WHERE w >= 100)
SELECT doc_id, page_no, seq FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = t.doc_id AND u.page_no = t.page_no
  AND greatest(0, least(t.x1, u.x1) - greatest(t.x0, u.x0)) * greatest(0, least(t.y1, u.y1) - greatest(t.y0, u.y0)) > 0.6 * greatest((t.x1 - t.x0) * (t.y1 - t.y0), 1e-9))""")
def j16_invisible_text_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = load(spark, sf_dir, TEXTS).select("doc_id", "page_no", "seq", "x0", "y0", "x1", "y1").distinct()
    unseen = load(spark, sf_dir, RECTS).where("w >= 100").select("doc_id", "page_no", "x0", "y0", "x1", "y1")
    return layout.without_masked(texts, unseen, "seq").select("doc_id", "page_no", "seq")


@query("""WITH l AS (SELECT conv_id AS doc_id, role AS name, min(turn) AS place FROM conversations GROUP BY 1, 2), s AS (SELECT conv_id AS doc_id, turn, CASE WHEN turn % 3 = 0 THEN 'none' ELSE role END AS layout FROM conversations)
SELECT s.doc_id, s.turn, coalesce(l.place, 0)::BIGINT AS layout_index FROM s LEFT JOIN l ON l.doc_id = s.doc_id AND l.name = s.layout""")
def j20_layout_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    slides = c.select(F.col("conv_id").alias("doc_id"), "turn", F.when(F.col("turn") % 3 == 0, "none").otherwise(F.col("role")).alias("layout"))
    return decks.layout_index(slides, c.select(F.col("conv_id").alias("doc_id"), F.col("role").alias("name"), F.col("turn").alias("place"))).select("doc_id", "turn", F.col("layout_index").cast("long").alias("layout_index"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, ((l_partkey * 1000000 + l_orderkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS place, (l_partkey % 3)::INTEGER AS indent, l_suppkey % 2 = 0 AS grp FROM lineitem)
SELECT doc_id, place, (SELECT max(g.place) FROM s g WHERE g.doc_id = s.doc_id AND g.place < s.place AND g.grp AND g.indent < s.indent
  AND NOT EXISTS (SELECT 1 FROM s x WHERE x.doc_id = s.doc_id AND x.place > g.place AND x.place < s.place AND x.indent <= g.indent)) AS group_at FROM s""")
def j21_nearest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = li.select(F.col("l_orderkey").alias("doc_id"), F.expr(_PLACE).alias("place"), (F.col("l_partkey") % 3).cast("int").alias("indent"), (F.col("l_suppkey") % 2 == 0).alias("grp"))
    return decks.nearest_group(s, ["doc_id"], "place", "indent", "grp").select("doc_id", "place", "group_at")


@query("""SELECT doc_id, place, CASE WHEN before IS NULL OR before <> fmt THEN fmt END AS shown FROM (SELECT l_orderkey AS doc_id, ((l_partkey * 1000000 + l_orderkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS place, l_returnflag || l_linestatus AS fmt, lag(l_returnflag || l_linestatus) OVER (PARTITION BY l_orderkey ORDER BY ((l_partkey * 1000000 + l_orderkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT)) AS before FROM lineitem)""")
def w14_format_elision(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.expr(_PLACE).alias("place"), F.concat("l_returnflag", "l_linestatus").alias("fmt"))
    return decks.elided_formats(li, ["doc_id"], "place", "fmt").select("doc_id", "place", "shown")


@query("SELECT p_partkey, CASE WHEN s = floor(s) THEN s::BIGINT::VARCHAR ELSE s::VARCHAR END AS size FROM (SELECT p_partkey, floor((p_size * 7 % 90) / 4e0 * 10 + 0.5) / 10 AS s FROM part)")
def m12_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.floor((F.col("p_size") * 7 % 90) / 4.0 * 10 + 0.5) / 10
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", size.alias("s")).select("p_partkey", G.shown("s").alias("size"))


@query("""SELECT page_id, TRY_CAST(nullif(regexp_extract(tag, 'width="?([0-9]+)', 1), '') AS INTEGER) AS w, TRY_CAST(nullif(regexp_extract(tag, 'height="?([0-9]+)', 1), '') AS INTEGER) AS h FROM (
  SELECT page_id, '<img src="a" ' || CASE page_id % 3 WHEN 0 THEN 'width="' || page_id % 90 || '" ' WHEN 1 THEN 'height=' || page_id % 70 || ' width=7 ' ELSE '' END || '>' AS tag FROM pages)""")
def h13_image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    tag = F.concat(F.lit('<img src="a" '), F.when(key % 3 == 0, F.concat(F.lit('width="'), (key % 90).cast("string"), F.lit('" '))).when(key % 3 == 1, F.concat(F.lit("height="), (key % 70).cast("string"), F.lit(" width=7 "))).otherwise(""), F.lit(">"))
    w, h = html.preferred_size(tag)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", w.alias("w"), h.alias("h"))


@query("""SELECT event_id, d <> 'none' AND v <> 'hidden' AND o > 0.05 AS seen FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'none' ELSE 'block' END AS d, CASE event_id % 5 WHEN 0 THEN 'hidden' ELSE 'visible' END AS v, (event_id % 30) / 100e0 AS o FROM events)""")
def f9_html_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", html.is_shown(F.when(e % 4 == 0, "none").otherwise("block"), F.when(e % 5 == 0, "hidden").otherwise("visible"), (e % 30) / 100.0).alias("seen"))


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, (l_partkey % 5)::DOUBLE AS w, (l_suppkey % 7)::DOUBLE AS h, CASE WHEN l_returnflag = 'A' THEN '#FFFFFF' WHEN l_returnflag = 'R' THEN '#112233' END AS bg, l_linestatus = 'F' AS border FROM lineitem)
  WHERE w >= 2 AND h >= 2 AND (bg IS NOT NULL OR border) AND NOT (coalesce(bg = '#FFFFFF', false) AND w >= 4 AND NOT border)""")
def f10_html_decoration(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag = F.col("l_returnflag")
    boxes = li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).cast("double").alias("w"), (F.col("l_suppkey") % 7).cast("double").alias("h"), F.when(flag == "A", "#FFFFFF").when(flag == "R", "#112233").alias("background"), (F.col("l_linestatus") == "F").alias("bordered"))
    return html.decoration(boxes, 4.0).select("l_orderkey", "l_linenumber")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'keep' END AS kept FROM supplier WHERE NOT (s_suppkey % 5 = 0 AND s_suppkey % 3 <> 0)""")
def f8_empty_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.when(key % 5 == 0, "body").alias("ph_type"), F.when(key % 3 == 0, "keep").alias("text"), F.lit(None).cast("string").alias("fill"), F.lit(None).cast("string").alias("line"))
    return decks.without_empty_placeholders(s).select("s_suppkey", F.col("text").alias("kept"))


@query(f"""SELECT doc_id, page_no, font, n_chars, n_more FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY n_chars DESC, font) AS place, count(*) OVER (PARTITION BY doc_id, page_no) - 2 AS n_more FROM (SELECT doc_id, page_no, font, sum(length(text))::BIGINT AS n_chars FROM {_T} GROUP BY 1, 2, 3)) WHERE place <= 2""")
def a16_fonts_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.fonts_used(load(spark, sf_dir, TEXTS), ["doc_id", "page_no"], 2).select("doc_id", "page_no", "font", "n_chars", "n_more")


@query(f"SELECT doc_id, page_no, seq FROM {_R} AS p WHERE NOT (stroke IS NOT NULL AND (h <= greatest(2.5, 1.6 * line_width) AND w > 6 OR w <= greatest(2.5, 1.6 * line_width) AND h > 6) OR fill IS NOT NULL AND (h <= 3.2 AND w > 6 OR w <= 3.2 AND h > 6))")
def u3_paths_but_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = samples.rect_paths(spark, sf_dir)
    return shapes.without_rules(paths, shapes.rules(paths)).select("doc_id", "page_no", "seq")


@query(f"""SELECT a.doc_id, a.page_no, count(*) AS n, sum(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS shared FROM {_R} AS a JOIN {_R} AS b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.seq < b.seq
  WHERE least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY 1, 2""")
def m6_box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of boxes of a page that overlap, by bands."""
    pairs = layout.overlaps(load(spark, sf_dir, RECTS), "seq")
    return pairs.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.sum("shared").alias("shared"))

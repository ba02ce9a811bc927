"""Queries over files made from keys: what the parsers read of them, beside SQL that states what is in them."""

from __future__ import annotations

import base64
import quopri
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import text as X
from ..operators import decks as D
from ..operators import layout, shapes
from ..operators.cut import cut
from ..sources import files, mail, pptx
from . import html as html_plan
from . import pdf as pdf_plan
from . import pptx as deck_plan
from . import sample_files as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


#: Files that a task makes and reads, at most, where there are more than cores.
FILES = 2000


def _made(spark: SparkSession, sf_dir: str, build: Callable[[int], bytes]) -> DataFrame:
    """(doc_id, content): a file for each supplier. The keys lie in few splits, the files take time: they are dealt to all cores."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["n"].astype(str), "content": [build(int(n)) for n in batch["n"]]})

    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("n"))
    parts = max(spark.sparkContext.defaultParallelism, -(-keys.count() // FILES))
    return keys.repartition(parts, "n").mapInPandas(make, "doc_id string, content binary")


def _pdf(spark: SparkSession, sf_dir: str, build: Callable[[int], bytes], *kinds: str) -> DataFrame:
    rows = files.pdf_elements(_made(spark, sf_dir, build)).where(F.col("kind").isin(*kinds))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


_N = "(SELECT s_suppkey AS n FROM supplier)"


@query(f"SELECT n AS doc_id, p AS page_no, 'Doc ' || n || ' page ' || p AS text, (50 + n % 90)::DOUBLE AS x0, (100 + p)::DOUBLE AS y0, (8 + n % 5)::DOUBLE AS size FROM {_N}, (VALUES (1), (2)) AS v(p)")
def s6_pdf_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-reference tables, streams, updates and none at all; object streams; wrong stream lengths; page trees."""
    return _pdf(spark, sf_dir, S.by_structure, "text").select("doc_id", F.col("page_no").cast("long").alias("page_no"), "text", "x0", "y0", "size")


@query(f"SELECT n AS doc_id, CASE WHEN n % 4 = 3 THEN 'recovered' END AS note FROM {_N} WHERE n % 4 = 3")
def s7_recovery_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf(spark, sf_dir, S.by_structure, "note").select("doc_id", F.col("text").alias("note"))


@query(f"""SELECT n AS doc_id, seq::BIGINT AS seq, text FROM (SELECT n, 0 AS seq, 'a(b' || n || ')c () AB' || chr(65533) || '\\ xy' AS text FROM {_N} UNION ALL SELECT n, 1, 'Hex ' || n FROM {_N} UNION ALL SELECT n, 2, 'end' FROM {_N})""")
def s3_pdf_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf(spark, sf_dir, S.by_strings, "text").select("doc_id", "seq", "text")


@query(f"SELECT n AS doc_id, md5(string_agg('w' || (n * k) % 97, ' ' ORDER BY k) || ' ' || repeat('z', 30)) AS text_md5 FROM {_N}, range(40) AS r(k) GROUP BY n")
def c8_filter_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf(spark, sf_dir, S.by_chain, "text").select("doc_id", F.md5("text").alias("text_md5"))


@query(f"SELECT n AS doc_id, 'Locked ' || n AS text, 'Title ' || n AS title FROM {_N}")
def c16_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pdf(spark, sf_dir, S.by_lock, "text", "info")
    return rows.groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "text", F.col("text"))).alias("text"), F.max(F.when(F.col("name") == "title", F.col("text"))).alias("title"))


@query(f"SELECT n AS doc_id, seq::BIGINT AS seq, level::INTEGER AS level, text FROM (SELECT n, 0 AS seq, 0 AS level, 'Part ' || n AS text FROM {_N} UNION ALL SELECT n, 1, 1, 'Kapitel ' || n || ' é漢' FROM {_N} UNION ALL SELECT n, 2, 0, 'Last ' || n FROM {_N})")
def s11_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf(spark, sf_dir, S.by_outline, "outline").select("doc_id", "seq", "level", "text")


@query(f"SELECT n AS doc_id, name, text FROM (SELECT n, 'title' AS name, 'Ünit ' || n AS text FROM {_N} UNION ALL SELECT n, 'author', 'Writer ' || n % 7 FROM {_N})")
def s12_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf(spark, sf_dir, S.by_outline, "info").select("doc_id", "name", "text")


@query(f"""SELECT n AS doc_id, seq::BIGINT AS seq, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, fill, stroke, w::DOUBLE AS line_width, np::BIGINT AS n_points FROM (
  SELECT n, 0 AS seq, n % 40 + 10 AS x0, 800 - 120 - (10 + n % 30) AS y0, n % 40 + 30 + n % 50 AS x1, 680 AS y1, '#336699' AS fill, NULL AS stroke, 1 AS w, 4 AS np FROM {_N}
  UNION ALL SELECT n, 1, 40, 800 - 2 * (60 + n % 9), 40, 740, NULL, '#FF0000', 4, 2 FROM {_N} UNION ALL SELECT n, 2, 100, 600, 200, 700, '#000000', '#FF0000', 2, 3 FROM {_N})""")
def r3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.aggregate("subpaths", F.lit(0), lambda a, s: a + F.size(s["pts"])).cast("long")
    return _pdf(spark, sf_dir, S.by_paths, "path").select("doc_id", "seq", "x0", "y0", "x1", "y1", "fill", "stroke", "line_width", points.alias("n_points"))


@query(f"""SELECT n AS doc_id, seq::BIGINT AS seq, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, w::INTEGER AS pix_w, h::INTEGER AS pix_h, f AS format, r AS resource FROM (
  SELECT n, 0 AS seq, 20 AS x0, 720 - n % 11 AS y0, 120 + n % 7 AS x1, 770 - n % 11 AS y1, 2 + n % 3 AS w, 2 AS h, 'bitmap' AS f, 'I1' AS r FROM {_N}
  UNION ALL SELECT n, 1, 300, 460, 340, 500, 9, 7, 'JPEG', 'I2' FROM {_N} UNION ALL SELECT n, 2, 400, 792 - n % 13, 408, 800 - n % 13, 3, 4, 'bitmap', '(inline)' FROM {_N})""")
def r4_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf(spark, sf_dir, S.by_images, "image").select("doc_id", "seq", "x0", "y0", "x1", "y1", "pix_w", "pix_h", "format", "resource")


@query(f"SELECT n AS doc_id, text, h AS hidden, i AS invisible, c::DOUBLE AS clip_x1 FROM (SELECT n, 'off ' || n AS text, true AS h, false AS i, 500 AS c FROM {_N} UNION ALL SELECT n, 'on ' || n, false, false, 500 FROM {_N} UNION ALL SELECT n, 'unseen', false, true, 500 FROM {_N} UNION ALL SELECT n, 'clipped', false, false, 50 FROM {_N})")
def r7_hidden_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf(spark, sf_dir, S.by_layers, "text").select("doc_id", "text", "hidden", "invisible", "clip_x1")


@query(f"SELECT n AS doc_id, 'on ' || n AS text FROM {_N}")
def f1_visible_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pdf(spark, sf_dir, S.by_layers, "text").withColumn("y0", F.col("y0") - F.col("size"))
    return layout.visible(rows).select("doc_id", "text")


@query(f"SELECT n AS doc_id, 'Stamp' AS annotation, 100e0 AS x0, 680e0 AS y0, (140 + n % 9)::DOUBLE AS x1, 700e0 AS y1, '#00FF00' AS fill FROM {_N}")
def r6_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf(spark, sf_dir, S.by_layers, "path").select("doc_id", "annotation", *[F.floor(F.col(c) * 1e6 + 0.5).cast("double").__truediv__(1e6).alias(c) for c in ("x0", "y0", "x1", "y1")], "fill")


_HEX2 = "upper(lpad(printf('%x', CAST(floor(least(1, greatest(0, {})) * 255 + 0.5) AS INTEGER)), 2, '0'))"


def _hex(r: str, g: str, b: str) -> str:
    return "'#' || " + " || ".join(_HEX2.format(v) for v in (r, g, b))


@query(f"""WITH v AS (SELECT n, (n % 5) / 4e0 AS t, CASE WHEN (n % 5) / 4e0 < 0.5 THEN 2 * ((n % 5) / 4e0) ELSE 2 - 2 * ((n % 5) / 4e0) END AS u FROM {_N})
SELECT n AS doc_id, seq::BIGINT AS seq, fill FROM (SELECT n, 0 AS seq, {_hex('t', 't / 2', 't / 4')} AS fill FROM v UNION ALL SELECT n, 1, {_hex('1 - t * t', '1 - t * t', '1 - t * t')} FROM v UNION ALL SELECT n, 2, {_hex('u', 'u / 2', 'u / 4')} FROM v
  UNION ALL SELECT n, 3, {_hex('t', '0', '1 - t')} FROM v UNION ALL SELECT n, 4, {_hex('CASE WHEN t > 0.5 THEN 0 ELSE 2 * t END', 'CASE WHEN t > 0.5 THEN 1 - t ELSE 0 END', '0.25')} FROM v UNION ALL SELECT n, 5, '#808080' FROM v)""")
def r8_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf(spark, sf_dir, S.by_functions, "path").select("doc_id", "seq", "fill")


@query(f"""WITH v AS (SELECT n, (n % 6) / 5e0 AS a, (n % 11) / 10e0 AS b FROM {_N})
SELECT n AS doc_id, seq::BIGINT AS seq, color FROM (SELECT n, 0 AS seq, {_hex('a', 'a', 'a')} AS color FROM v UNION ALL SELECT n, 1, {_hex('a', 'b', '0')} FROM v UNION ALL SELECT n, 2, {_hex('(1 - a) * (1 - b)', '1 - b', '1 - b')} FROM v
  UNION ALL SELECT n, 3, CASE n % 3 WHEN 0 THEN '#FF0000' WHEN 1 THEN '#00FF00' ELSE '#0000FF' END FROM v UNION ALL SELECT n, 4, {_hex('1 - b', '(1 - a) * (1 - b)', '1 - b')} FROM v UNION ALL SELECT n, 5, {_hex('b', 'b', 'b')} FROM v)""")
def r9_color_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pdf(spark, sf_dir, S.by_spaces, "path").select("doc_id", "seq", F.coalesce("fill", "stroke").alias("color"))


@query(f"SELECT n AS doc_id, CASE n % 2 WHEN 0 THEN 'axial' ELSE 'radial' END AS kind, '0.0#FF0000 0.5#800080 1.0#0000FF' AS stops, 10e0 AS x0, 750e0 AS y0, (110 + n % 50)::DOUBLE AS x1, 780e0 AS y1 FROM {_N}")
def r5_shadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = F.array_join(F.transform("pattern.stops", lambda s: F.concat(s["t"].cast("string"), s["color"])), " ")
    return _pdf(spark, sf_dir, S.by_shading, "shading").select("doc_id", "pattern.kind", stops.alias("stops"), "x0", "y0", "x1", "y1")


_FONTS = f"""SELECT n, 0 AS seq, 'é中•€' AS text, 26e0 AS w, 'Times New Roman' AS font, 0 AS bad FROM {_N} UNION ALL SELECT n, 1, 'X一丂' || chr((97 + n % 26)::INTEGER), 20.5e0, 'Song', 0 FROM {_N} UNION ALL SELECT n, 2, repeat(chr(65533), 2), 20e0, 'Bare', 2 FROM {_N}"""


@query(f"SELECT n AS doc_id, seq::BIGINT AS seq, text, w, bad::INTEGER AS bad FROM ({_FONTS})")
def c28_font_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyph names, ToUnicode maps, code spaces, glyph numbers and widths."""
    return _pdf(spark, sf_dir, S.by_fonts, "text").select("doc_id", "seq", "text", (F.floor((F.col("x1") - F.col("x0")) * 1e6 + 0.5) / 1e6).alias("w"), "bad")


@query(f"SELECT n AS doc_id, font, 1 - sum(bad) / sum(length(text)) AS reliability FROM ({_FONTS.replace('Times New Roman', 'ABCDEF+Times-BoldItalic')}) GROUP BY 1, 2")
def c36_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reliability(_pdf(spark, sf_dir, S.by_fonts, "text"), ["doc_id", "font"]).select("doc_id", "font", "reliability")


# -- codecs over given texts ------------------------------------------------------------------


def _through(spark: SparkSession, sf_dir: str, pack: Callable[[bytes], bytes], unpack: Callable[[bytes], bytes]) -> DataFrame:
    """doc_id, bytes and digest of each document's text after both ways."""

    def both(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unpack(pack(bytes(x))))

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.pandas_udf(both, "binary")(F.encode("text", "UTF-8")).alias("b"))
    return d.select("doc_id", F.octet_length("b").cast("long").alias("n_bytes"), F.md5("b").alias("md5"))


_WHOLE = "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS md5 FROM documents"


def _round_trip(name: str, pack: Callable[[bytes], bytes], unpack: Callable[[bytes], bytes], sql: str = _WHOLE) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _through(spark, sf_dir, pack, unpack)

    run.__name__ = name
    query(sql)(run)


def _padded(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


_KEY, _IV = bytes(range(16)), bytes(range(16, 32))
#: Ciphers in Python take some ten microseconds a byte: their texts are digested first.
_SHORT = "SELECT doc_id, 32::BIGINT AS n_bytes, md5(md5(text)) AS md5 FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL"


def _digest(data: bytes) -> bytes:
    import hashlib

    return hashlib.md5(data).hexdigest().encode()


_round_trip("c1_inflate", zlib.compress, codecs.inflate)
_round_trip("c2_inflate_damaged", lambda b: b"\n " + zlib.compress(b)[2:-4], lambda b: codecs.inflate(b[2:]))
_round_trip("c3_lzw", S.lzw, codecs.lzw)
_round_trip("c4_ascii85", lambda b: base64.a85encode(b, wrapcol=60) + b"~>", codecs.ascii85)
_round_trip("c6_run_length", S.run_length, codecs.run_length)
_round_trip("c7_predictors", lambda b: S.predicted(b, 1, len(b) % 5), lambda b: codecs.unpredict(b, 10 + b[0] if b else 10, columns=1))
_round_trip("c12_rc4", lambda b: codecs.rc4(_KEY, _digest(b)), lambda b: codecs.rc4(_KEY, b), _SHORT)
_round_trip("c14_aes_cbc", lambda b: _IV + codecs.aes_cbc_encrypt(_KEY * 2, _IV, _padded(_digest(b))), lambda b: codecs.aes_cbc_decrypt(_KEY * 2, b), _SHORT)
_round_trip("c15_aes_without_padding", lambda b: codecs.aes_cbc_encrypt(_KEY, _IV, _digest(b)), lambda b: codecs.aes_cbc_decrypt(_KEY, b, _IV, False), _SHORT)
_round_trip("c19_quoted_printable", lambda b: quopri.encodestring(b, quotetabs=True), codecs.quoted_printable)
_round_trip("c20_charsets", lambda b: b.decode().encode("gb18030"), lambda b: codecs.decode_charset(b, "GB2312").encode())
_round_trip("c21_encoded_words", lambda b: b"x =?utf-8?B?" + base64.b64encode(b) + b"?= y", lambda b: codecs.decode_words(b.decode())[2:-2].encode())


@query("SELECT doc_id, md5(text) AS wide_md5 FROM documents")
def c23_pdf_text_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))
    return d.select("doc_id", F.md5(X.pdf_text_string(wide)).alias("wide_md5"))


# -- mail -------------------------------------------------------------------------------------


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _made(spark, sf_dir, lambda n: S.mail(n, f"<p>Gr&uuml;ß {n} café</p>"))
    return mail.mails(made).withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"SELECT n AS doc_id, '<p>Gr&uuml;' || CASE WHEN n % 3 = 1 THEN '&#223;' ELSE 'ß' END || ' ' || n || ' café</p>' AS html, 'Café ' || n AS subject, 'Jörg ' || n || ' <j' || n || '@example.org>' AS sender, 2 AS n_parts, 'cid:pic' || n AS asset FROM {_N}")
def s19_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).select("doc_id", "html", "subject", "sender", "n_parts", F.get("assets", F.lit(0))["key"].alias("asset"))


# -- decks ------------------------------------------------------------------------------------


def _deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the decks, written once: most plans use them several times, and each would parse every deck again."""
    return cut(pptx.deck_elements(_made(spark, sf_dir, S.deck)).withColumn("doc_id", F.col("doc_id").cast("long")), "decks")


@query(f"SELECT n AS doc_id, p::INTEGER AS page_no, part FROM {_N}, (VALUES (1, 'ppt/slides/slide2.xml'), (2, 'ppt/slides/slide1.xml')) AS v(p, part)")
def s17_slide_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deck(spark, sf_dir).where("kind = 'page' and role = 'slide'").select("doc_id", "page_no", "part")


@query(f"""SELECT n AS doc_id, name, x::BIGINT AS x, y::BIGINT AS y, cx::BIGINT AS cx, cy::BIGINT AS cy, pos_source FROM (SELECT n, 'N2' AS name, 50 AS x, 60 AS y, 70 AS cx, 80 + n AS cy, 'master' AS pos_source FROM {_N} UNION ALL SELECT n, 'N3', 500, 600, 700 + n, 800, 'layout' FROM {_N}
  UNION ALL SELECT n, 'N5', 1000 + n, 2000, 3000, 4000, 'slide' FROM {_N} UNION ALL SELECT n, 'Grid', 11, 22, 60000, 40001, 'slide' FROM {_N})""")
def j3_inherited_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slide, layout, master: places by placeholder, hidden shapes left out."""
    return deck_plan.inherited(_deck(spark, sf_dir)).where("not hidden").select("doc_id", "name", "x", "y", "cx", "cy", "pos_source")


@query(f"SELECT n AS doc_id, text, size, font, bold FROM (SELECT n, 'Head ' || n AS text, (30 + n % 9)::DOUBLE AS size, 'Garamond' AS font, NULL::BOOLEAN AS bold FROM {_N} UNION ALL SELECT n, 'Body', 14, NULL, true FROM {_N})")
def j6_text_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with what the master's styles give them; theme fonts by reference."""
    return deck_plan.styled_runs(_deck(spark, sf_dir)).where("not hidden").select("doc_id", "text", "size", "font", "bold")


@query(f"SELECT n AS doc_id, '#402010' AS fill, '#FEFEFE' AS background FROM {_N}")
def j7_scheme_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A theme colour with a modifier, and a background by the master's map."""
    rows = _deck(spark, sf_dir)
    fill = rows.where("kind = 'shape' and name = 'N5'").select("doc_id", "fill")
    return fill.join(rows.where("kind = 'page' and role = 'master'").select("doc_id", F.col("fill").alias("background")), "doc_id")


@query(f"SELECT n AS doc_id, r::INTEGER AS r, c::INTEGER AS c, 'v' || r || c || '-' || n AS text, CASE c WHEN 0 THEN 25000 ELSE 35000 END::BIGINT AS cx, (20000 + r)::BIGINT AS cy FROM {_N}, range(2) AS a(r), range(2) AS b(c)")
def x9_deck_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deck(spark, sf_dir).where("kind = 'cell'").select("doc_id", "r", "c", "text", "cx", "cy")


@query(f"SELECT n AS doc_id, 'L' || n AS layout, '1,2' AS pages FROM {_N}")
def j19_layout_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = D.layout_usage(_deck(spark, sf_dir))
    return used.select("doc_id", "layout", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured texts of one slide with a shape, a run and a table, from suppliers."""
    n = F.col("s_suppkey").cast("string")
    x = (F.col("s_suppkey") % 10).cast("string")
    lines = ["# X", "画布尺寸: 20 × 10 cm", "页数: 1", "## 幻灯片 1", "背景: #ABCDEF", "### [1] 椭圆/圆 「Oval」", F.concat(F.lit("位置: x="), x, F.lit(" y=2 宽=3.5 高=4 cm")), "填充: #102030", "边框: #405060", "  段落1:", F.concat(F.lit('    · "Say '), n, F.lit('"  — 18.5pt 粗体 字体 Arial #0A0B0C')), "### [2] 表格 「T」", "位置: x=1 y=5 宽=8 高=2 cm", "列宽: 4 | 4 cm", F.concat(F.lit('  第1行: "a'), n, F.lit('" | "b"')), '  第2行: "c" | "d⏎e"']
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(n.alias("doc_id"), F.concat_ws("\n", *[F.lit(v) if isinstance(v, str) else v for v in lines]).alias("text"))


def _again(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pptx.deck_elements(deck_plan.decks(_texts(spark, sf_dir))).where("role = 'slide' or kind = 'deck'").withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"""SELECT n AS doc_id, name, geom, x::BIGINT AS x, y::BIGINT AS y, cx::BIGINT AS cx, cy::BIGINT AS cy, fill, line FROM (SELECT n, 'Oval' AS name, 'ellipse' AS geom, n % 10 * 360000 AS x, 720000 AS y, 1260000 AS cx, 1440000 AS cy, '#102030' AS fill, '#405060' AS line FROM {_N}
  UNION ALL SELECT n, 'T', NULL, 360000, 1800000, 2880000, 720000, NULL, NULL FROM {_N})""")
def k5_written_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured text to a deck, and the deck read again."""
    return _again(spark, sf_dir).where("kind = 'shape'").select("doc_id", "name", "geom", "x", "y", "cx", "cy", "fill", "line")


@query(f"SELECT n AS doc_id, 'Say ' || n AS text, 18.5e0 AS size, true AS bold, 'Arial' AS font, '#0A0B0C' AS color FROM {_N}")
def v1_written_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir).where("kind = 'run' and text <> ''").select("doc_id", "text", "size", "bold", "font", "color")


@query(f"SELECT n AS doc_id, r::INTEGER AS r, c::INTEGER AS c, CASE WHEN r = 0 AND c = 0 THEN 'a' || n WHEN r = 0 THEN 'b' WHEN c = 0 THEN 'c' ELSE 'd' || chr(10) || 'e' END AS text FROM {_N}, range(2) AS a(r), range(2) AS b(c)")
def v4_written_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir).where("kind = 'cell'").select("doc_id", "r", "c", "text")


@query(f"SELECT n AS doc_id, 7200000::BIGINT AS cx, 3600000::BIGINT AS cy, '#ABCDEF' AS background FROM {_N}")
def v5_written_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir).groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "deck", F.col("cx"))).alias("cx"), F.max(F.when(F.col("kind") == "deck", F.col("cy"))).alias("cy"), F.max(F.when(F.col("kind") == "page", F.col("fill"))).alias("background"))


@query(f"SELECT n AS doc_id, 1 AS n_slides, 2 AS n_shapes, 1 AS n_texts, 1 AS n_tables FROM {_N}")
def a13_written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = D.text_counts(_texts(spark, sf_dir))
    return counts.withColumn("doc_id", F.col("doc_id").cast("long"))


# -- layout of files --------------------------------------------------------------------------


def _elements(spark: SparkSession, sf_dir: str, build: Callable[[int], bytes]) -> DataFrame:
    return cut(files.pdf_elements(_made(spark, sf_dir, build)), "elements")


def _lines(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = elements.where("kind = 'text'").select("doc_id", "page_no", "seq", "x0", "y0", "x1", "y1", "text", "size", "rot", "font", "bold", "italic", "color", "bad")
    parts = cut(layout.gaps(layout.assign_lines(texts)), "parts")
    return parts, cut(layout.summarize_lines(parts), "lines")


def _drawn(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    pages = elements.where("kind = 'page'").select("doc_id", "page_no", "w", "h")
    return cut(shapes.classify(elements.where("kind = 'path'").select("doc_id", "page_no", "seq", "x0", "y0", "x1", "y1", "fill", "stroke", "line_width", "subpaths"), pages), "drawn"), pages


def _ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    elements = _elements(spark, sf_dir, S.by_grid)
    frames = cut(shapes.table_frames(shapes.rules(_drawn(elements)[0])), "frames")
    return frames, cut(shapes.cells(shapes.place_in_cells(_lines(elements)[0], frames)), "cells")


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


@query(f"SELECT n AS doc_id, (2 + n % 3)::BIGINT AS n_rows, (2 + n % 2)::BIGINT AS n_cols, ((2 + n % 3) * (2 + n % 2))::BIGINT AS n_filled, 0.95e0 AS confidence, 100e0 AS x0, (260 + 80 * (n % 2))::DOUBLE AS x1 FROM {_N}")
def d3_ruled_tables_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(shapes.ruled_tables(*_ruled(spark, sf_dir))).select("doc_id", "n_rows", "n_cols", "n_filled", F.round("confidence", 9).alias("confidence"), "x0", "x1")


@query(f"SELECT n AS doc_id, r::INTEGER AS r, c::INTEGER AS c, 'r' || r || 'c' || c || '-' || n AS text, 9e0 AS size, false AS bold FROM {_N}, range(4) AS a(r), range(3) AS b(c) WHERE r < 2 + n % 3 AND c < 2 + n % 2")
def a7_cells_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_ruled(spark, sf_dir)[1]).select("doc_id", "r", "c", "text", "size", "bold")


@query(f"SELECT n AS doc_id, (6 + n % 3)::BIGINT AS n_rows, 3::BIGINT AS n_cols, 0.75e0 AS confidence, 60e0 AS x0 FROM {_N}")
def d4_unruled_tables_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, lines = _lines(_elements(spark, sf_dir, S.by_alignment))
    return _numbered(shapes.unruled_tables(lines, shapes.segments(parts, lines))).select("doc_id", "n_rows", "n_cols", F.round("confidence", 9).alias("confidence"), "x0")


@query(f"SELECT n AS doc_id, 'k' || r || 'c' || c AS text, c::BIGINT AS cell, (60 + 150 * c)::DOUBLE AS x0 FROM {_N}, range(8) AS a(r), range(3) AS b(c) WHERE r < 6 + n % 3")
def w3_segments_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, lines = _lines(_elements(spark, sf_dir, S.by_alignment))
    return _numbered(shapes.segments(parts, lines)).select("doc_id", "text", F.col("cell").cast("long").alias("cell"), "x0")


_KINDS = "(VALUES (0, 'background'), (1, 'triangle'), (2, 'quadrilateral'), (3, '6-gon'), (4, 'square'), (5, 'rectangle'), (6, 'circle'), (7, 'ellipse'), (8, 'rounded-rectangle'), (9, 'curve'), (10, 'polyline'), (11, 'rectangles'), (12, 'oblique')) AS v(seq, shape)"


@query(f"SELECT n AS doc_id, seq::BIGINT AS seq, shape FROM {_N}, {_KINDS}")
def d6_shapes_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_drawn(_elements(spark, sf_dir, S.by_outlines))[0]).select("doc_id", "seq", "shape")


@query(f"SELECT n AS doc_id, 0::BIGINT AS seq, '#000000' AS fill FROM {_N}")
def f6_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(shapes.background(_drawn(_elements(spark, sf_dir, S.by_outlines))[0])).select("doc_id", "seq", "fill")


@query(f"SELECT n AS doc_id, 'bars-vertical' AS guess, 4::BIGINT AS n, '30 60 90 ' || 120 + n % 30 AS lengths, '1.0 2.0 3.0 ' || round((120 + n % 30) / 30, 3) AS ratios FROM {_N}")
def d14_bar_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda a, of: F.array_join(F.transform(a, of), " ")
    charts = shapes.length_ratios(shapes.bar_charts(*_drawn(_elements(spark, sf_dir, S.by_charts))))
    return _numbered(charts).select("doc_id", "guess", F.col("n").cast("long").alias("n"), said("series", lambda b: F.round(b["len"]).cast("int").cast("string")).alias("lengths"), said("ratios", lambda r: F.round(r, 3).cast("string")).alias("ratios"))


@query(f"SELECT n AS doc_id, 'pie' AS guess, 3::BIGINT AS n, 0.54e0 AS confidence, 330e0 AS x0, 430e0 AS x1 FROM {_N}")
def d9_pie_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(shapes.pie_charts(_drawn(_elements(spark, sf_dir, S.by_charts))[0])).select("doc_id", "guess", F.col("n").cast("long").alias("n"), F.round("confidence", 9).alias("confidence"), "x0", "x1")


@query(f"SELECT n AS doc_id, 'line' AS guess, 5::BIGINT AS n, 0.45e0 AS confidence, 60e0 AS x0, 220e0 AS x1, 350e0 AS y0 FROM {_N}")
def d10_line_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(shapes.line_charts(*_drawn(_elements(spark, sf_dir, S.by_charts)))).select("doc_id", "guess", "n", "confidence", "x0", "x1", "y0")


@query(f"SELECT n AS doc_id, guess FROM {_N}, (VALUES ('bars-vertical'), ('pie'), ('line')) AS v(guess)")
def l5_kept_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of charts beside each other all stay; a copy of each that lies on it goes."""
    drawn, pages = _drawn(_elements(spark, sf_dir, S.by_charts))
    charts = shapes.bar_charts(drawn, pages).unionByName(shapes.pie_charts(drawn), allowMissingColumns=True).unionByName(shapes.line_charts(drawn, pages), allowMissingColumns=True)
    charts = charts.select("doc_id", "page_no", "guess", "x0", "y0", "x1", "y1", "confidence", F.col("seq").alias("id"))
    twice = charts.unionByName(charts.withColumn("x1", F.col("x1") + 1).withColumn("confidence", F.col("confidence") - 0.01).withColumn("id", F.col("id") + 1000).withColumn("guess", F.lit("copy")))
    return _numbered(shapes.suppress(cut(twice, "charts"))).select("doc_id", "guess")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(layout.summarize_paragraphs(layout.assign_paragraphs(_lines(_elements(spark, sf_dir, S.by_prose))[1])), "paragraphs")


_PROSE = f"""SELECT n, 0 AS k, 'Heading ' || n AS text, 20e0 AS size, 1 AS m, 0 AS block FROM {_N} UNION ALL SELECT n, 1, 'The first line of a paragraph that is long enough to' || chr(10) || 'be continued by the second one, number ' || n || '.', 10, 2, 0 FROM {_N}
  UNION ALL SELECT n, 2, 'Another paragraph stands here, further down, and it' || chr(10) || 'ends on its second line.', 10, 2, 1 FROM {_N} UNION ALL SELECT n, 3, '1. An entry of a list', 10, 1, 2 FROM {_N}"""


@query(f"SELECT n AS doc_id, replace(text, chr(10), ' ') AS text, size, m::BIGINT AS n_lines FROM ({_PROSE})")
def w7_paragraphs_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(_paragraphs(spark, sf_dir)).select("doc_id", F.replace("flow_text", F.lit("\n"), F.lit(" ")).alias("text"), "size", F.col("n_lines").cast("long").alias("n_lines"))


@query(f"SELECT n AS doc_id, count(*)::BIGINT AS n_paragraphs, sum(m)::BIGINT AS n_lines FROM ({_PROSE}) GROUP BY n, block")
def w8_blocks_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = layout.assign_blocks(_paragraphs(spark, sf_dir))
    return _numbered(_numbered(blocks).groupBy("doc_id", "page_no", "block_id").agg(F.count("*").alias("n_paragraphs"), F.sum("n_lines").cast("long").alias("n_lines"))).select("doc_id", "n_paragraphs", "n_lines")


@query(f"""SELECT n AS doc_id, string_agg('第' || (r + 1) || '行: ' || cells, '|' ORDER BY r) AS table_lines, true AS has_head FROM (
  SELECT n, r, string_agg('"r' || r || 'c' || c || '-' || n || '"', ' | ' ORDER BY c) AS cells FROM {_N}, range(4) AS a(r), range(3) AS b(c) WHERE r < 2 + n % 3 AND c < 2 + n % 2 GROUP BY n, r) GROUP BY n""")
def k1_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured text of a file, from bytes to table lines."""
    texts = pdf_plan.document_text(_elements(spark, sf_dir, S.by_grid))
    found = F.array_join(F.regexp_extract_all("text", F.lit(r"(第\d+行: .*)"), F.lit(1)), "|")
    return _numbered(texts).select("doc_id", found.alias("table_lines"), F.startswith("text", F.lit("# PDF 结构化描述：")).alias("has_head"))


@query(f"""SELECT n AS doc_id, 2 AS n_slides, '"Head ' || n || '"' AS title, '第1行: "v00-' || n || '" | "v01-' || n || '"' AS first_row, '#FEFEFE' AS background FROM {_N}""")
def k2_deck_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = deck_plan.document_text(cut(pptx.deck_elements(_made(spark, sf_dir, S.deck)), "deck"))
    one = lambda pattern: F.regexp_extract("text", pattern, 1)
    return _numbered(texts).select("doc_id", one(r"页数: (\d+)").cast("int").alias("n_slides"), one(r'· ("Head \d+")').alias("title"), one(r'(第1行: "v00.*)').alias("first_row"), one(r"背景: (#\w+)").alias("background"))


@query(f"SELECT n AS doc_id, '\"Grüß ' || n || ' café\"' AS said FROM {_N}")
def k3_mail_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = cut(_mails(spark, sf_dir), "mails")
    pages = read.select("doc_id", "html", "subject", "sender")
    assets = read.select("doc_id", F.explode("assets").alias("a")).select("doc_id", "a.key", "a.data_url")
    return _numbered(html_plan.document_text(pages, assets)).select("doc_id", F.regexp_extract("text", r'("Gr[^"]*")', 1).alias("said"))

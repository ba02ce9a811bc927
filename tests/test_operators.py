"""Layout operators on small pages, and the same results whatever the partitions."""

import pytest

from quirespark.operators import joins, layout, shapes
from quirespark.plans import registry, samples

TEXT = "doc_id string, page_no int, seq long, x0 double, y0 double, x1 double, y1 double, text string, size double, rot double, font string, bold boolean, italic boolean, color string, bad int"


def parts(spark, *rows):
    return spark.createDataFrame([("d", 1, i, float(x), float(y), float(x + w), float(y), t, float(s), 0.0, "F", False, False, c, 0) for i, (x, y, w, t, s, c) in enumerate(rows)], TEXT)


def lines(df):
    return [r.text for r in layout.summarize_lines(layout.gaps(layout.assign_lines(df))).orderBy("line_id").collect()]


def test_gaps(spark):
    spaced = [(10 * i, 100, 6, c, 10, "#000000") for i, c in enumerate("LATAM")]
    assert lines(parts(spark, *spaced)) == ["LATAM"]
    assert lines(parts(spark, (0, 100, 20, "two", 10, None), (24, 100, 20, "words", 10, None))) == ["two words"]
    assert lines(parts(spark, *spaced[:4], (60, 100, 6, "X", 10, None))) == ["LATA X"]
    assert lines(parts(spark, (0, 100, 10, "中", 10, None), (13, 100, 10, "文", 10, None))) == ["中文"]
    assert lines(parts(spark, (0, 100, 10, "a", 24, None), (30, 101, 10, "b", 12, None), (0, 300, 10, "c", 10, None))) == ["a b", "c"]


def test_paragraphs_and_blocks(spark):
    rows = [(50, 100, 300, "First line of a paragraph", 10, "#000000"), (50, 112, 300, "and its second line.", 10, "#000000"), (50, 130, 200, "- a bullet item", 10, "#000000"), (50, 142, 200, "- another", 10, "#000000"), (50, 300, 300, "Far away", 10, "#000000")]
    got = layout.summarize_lines(layout.gaps(layout.assign_lines(parts(spark, *rows))))
    paras = layout.summarize_paragraphs(layout.assign_paragraphs(got))
    assert [r.flow_text for r in paras.orderBy("para_id").collect()] == ["First line of a paragraph and its second line.", "- a bullet item", "- another", "Far away"]
    assert layout.summarize_blocks(layout.assign_blocks(paras)).count() == 2
    assert layout.assign_paragraphs(got, merge=False).select("para_id").distinct().count() == 5


def path(seq, pts, *, curves=False, closed=True, rect=False, ctrl=0, fill="#336699", stroke=None, lw=1.0):
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return ("d", 1, seq, min(xs), min(ys), max(xs), max(ys), fill, stroke, lw, [([{"x": float(x), "y": float(y)} for x, y in pts], curves, closed, rect, ctrl)])


PATHS = "doc_id string, page_no int, seq long, x0 double, y0 double, x1 double, y1 double, fill string, stroke string, line_width double, subpaths array<struct<pts:array<struct<x:double,y:double>>,curves:boolean,closed:boolean,is_rect:boolean,n_ctrl:int>>"


def test_shapes(spark):
    from math import cos, pi, sin

    f = lambda *pts: [(float(x), float(y)) for x, y in pts]
    round_ = [(100.0 + 30 * cos(2 * pi * i / 32), 100.0 + 30 * sin(2 * pi * i / 32)) for i in range(32)]
    rows = [
        path(0, f((0, 0), (612, 0), (612, 792), (0, 792)), rect=True), path(1, f((0, 0), (60, 0), (60, 60), (0, 60)), rect=True), path(2, f((0, 0), (60, 0), (30, 50))), path(3, round_, curves=True, ctrl=4),
        path(4, f((0, 0), (50, 80)), stroke="#000000", fill=None, closed=False), path(5, f((0, 0), (200, 0)), stroke="#000000", fill=None, closed=False), path(6, f((0, 0), (30, 50), (60, 10), (90, 70), (120, 20)), closed=False, fill=None, stroke="#FF0000"), path(7, f((5, 5), (5, 5)), fill=None, stroke="#000000"),
    ]
    pages = spark.createDataFrame([("d", 1, 612.0, 792.0)], "doc_id string, page_no int, w double, h double")
    got = {r.seq: r["shape"] for r in shapes.classify(spark.createDataFrame(rows, PATHS), pages).collect()}
    assert got == {0: "background", 1: "square", 2: "triangle", 3: "circle", 4: "oblique", 5: "h-line", 6: "polyline", 7: "h-line"}


def test_suppression_and_joins(spark):
    charts = spark.createDataFrame([("d", 1, 1, 0.5, 0.0, 0.0, 10.0, 10.0), ("d", 1, 2, 0.8, 1.0, 1.0, 9.0, 9.0), ("d", 1, 3, 0.4, 50.0, 50.0, 60.0, 60.0)], "doc_id string, page_no int, id long, confidence double, x0 double, y0 double, x1 double, y1 double")
    assert {r.id for r in shapes.suppress(charts).collect()} == {2, 3}
    rows, lookup = spark.createDataFrame([(1, "a", "b"), (2, "x", "b"), (3, None, "y")], "id int, k1 string, k2 string"), spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    assert {(r.id, r.value, r.level) for r in joins.priority(rows, lookup, ["k1", "k2"]).collect()} == {(1, 1, 1), (2, 2, 2), (3, None, None)}


@pytest.mark.parametrize("name", ["a4_line_summary", "w12_reading_order", "d8_bar_charts", "a1_palette"])
def test_partitions_do_not_matter(spark, sf, name):
    seen = []
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, registry.QUERIES[name](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1] and seen[0]


def test_every_line_item_is_a_block(spark, sf):
    blocks = samples.load(spark, sf, samples.BLOCKS)
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert blocks.count() == n and blocks.where("top < 0 or bottom > 792 or bottom <= top").isEmpty()
    assert blocks.where("bottom >= 0.88 * 792").groupBy("doc_id", "page_no").count().where("count > 1").isEmpty()
    assert registry.QUERIES["a2_headers_footers"](spark, sf).count() == registry.QUERIES["w12_reading_order"](spark, sf).count() == n


def test_registry():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) >= 40
    assert "{" not in samples.plain(samples.TEXTS)

"""PDF files made here, from bytes to structured text."""

import pytest
from quirespark.plans import pdf as plan
from quirespark.sources import files

from .builders import PRECISION, pdf

GRID = b"".join(b"%d 510 m %d 594 l S " % (x, x) for x in (60, 130, 200, 270)) + b"".join(b"60 %d m 270 %d l S " % (y, y) for y in (510, 538, 566, 594))
CELLS = b"".join(b"BT /F1 8 Tf %d %d Td (r%dc%d) Tj ET " % (66 + 70 * c, 576 - 28 * r, r, c) for r in range(3) for c in range(3))
BARS = b"0.6 0.2 0.4 rg " + b"".join(b"%d 300 18 %d re f " % (80 + 30 * i, h) for i, h in enumerate((36, 72, 108, 54, 90)))


@pytest.fixture(scope="module")
def read(spark):
    def rows(**docs):
        frame = spark.createDataFrame(list(docs.items()), "doc_id string, content binary")
        return files.pdf_elements(frame)

    return rows


def test_elements(read):
    rows = read(a=pdf(PRECISION)).collect()
    page = next(r for r in rows if r.kind == "page")
    assert (page.w, page.h, page.rot) == (612, 792, 0)
    rect, line = [r for r in rows if r.kind == "path"]
    assert (rect.x0, rect.y0, rect.x1 - rect.x0, rect.y1 - rect.y0, rect.fill) == (50, 146, 144, 36, "#33CC66")
    assert (line.stroke, line.line_width) == ("#0000FF", 5)
    text = next(r for r in rows if r.text == "Quarterly Notes")
    assert (text.x0, text.y0, text.size, text.color, text.bold) == (90, 72, 18, "#993366", False)
    assert next(r for r in rows if r.text == "Heavy").bold


def test_damage_and_layers(read):
    hidden = pdf(b"/OC /L BDC BT /F1 10 Tf 72 700 Td (secret) Tj ET EMC BT /F1 10 Tf 72 600 Td (shown) Tj ET BT 3 Tr /F1 10 Tf 72 500 Td (ocr) Tj ET", extra="/OCProperties << /OCGs [9 0 R] /D << /OFF [9 0 R] >> >>", objects={9: b"<< /Type /OCG /Name (x) >>"}, page_extra="/Properties << /L 9 0 R >>")
    rows = read(broken=pdf(PRECISION, broken=True), hidden=hidden, junk=b"nothing here", none=None, turned=pdf(PRECISION, rotate=90), cut=pdf(PRECISION)[:700]).collect()
    of = lambda d, k: [r for r in rows if r.doc_id == d and r.kind == k]
    assert any(r.text == "recovered" for r in of("broken", "note")) and len(of("broken", "path")) == 2
    assert [(r.text, r.hidden, r.invisible) for r in of("hidden", "text")] == [("secret", True, False), ("shown", False, False), ("ocr", False, True)]
    assert of("junk", "error") and of("none", "error")
    assert [(r.w, r.h, r.rot) for r in of("turned", "page")] == [(792, 612, 90)]


def test_tables_charts_text(spark, read, tmp_path):
    many = pdf(b"", pages=[b"BT /F1 9 Tf 72 770 Td (Annual report %d) Tj ET BT /F1 10 Tf 72 500 Td (Body of page %d) Tj ET BT /F1 9 Tf 300 20 Td (- %d -) Tj ET" % (i, i, i) for i in range(1, 5)])
    path = str(tmp_path / "elements")
    read(a=pdf(PRECISION), grid=pdf(GRID + CELLS), bars=pdf(BARS), many=many, junk=b"x").write.parquet(path)
    elements = spark.read.parquet(path)
    parts = plan.analyze(elements)
    table = parts.tables.collect()
    assert [(t.doc_id, t.n_rows, t.n_cols, t.ruled) for t in table] == [("grid", 3, 3, True)]
    cells = {(c.r, c.c): c.text for c in parts.cells.collect()}
    assert cells == {(r, c): f"r{r}c{c}" for r in range(3) for c in range(3)}
    charts = parts.charts.collect()
    assert [(c.doc_id, c.guess, c.n) for c in charts] == [("bars", "bars-vertical", 5)]
    roles = {(b.page_no, b.text): b.role for b in parts.blocks.where("doc_id = 'many'").collect()}
    assert all(roles[i, f"Annual report {i}"] == "header" and roles[i, f"- {i} -"] == "footer" and roles[i, f"Body of page {i}"] is None for i in range(1, 5))
    texts = {r.doc_id: r.text for r in plan.document_text(elements).collect()}
    assert texts["a"].startswith("# PDF 结构化描述：a") and "位置: x=1.76 y=5.15 宽=5.08 高=1.27 cm" in texts["a"] and "填充: #33CC66" in texts["a"] and "Heavy Type" in texts["a"]
    assert '第1行: "r0c0" | "r0c1" | "r0c2"' in texts["grid"] and "疑似图表：柱形图（垂直柱）" in texts["bars"]
    assert texts["junk"] == "错误: not a PDF" and texts["many"].count("（页眉 [推断 置信度0.95]）") == 4


def test_rotated_shadings_bars(spark, read, tmp_path):
    turned = b"BT /F1 10 Tf 72 700 Td (Flat) Tj ET " + b"".join(b"BT /F1 9 Tf 0 1 -1 0 %d 300 Tm (Side %d) Tj ET " % (20 + 10 * i, i) for i in range(35))
    shaded = b"q 100 300 200 100 re W n /S1 sh Q"
    extra = "/Shading << /S1 << /ShadingType 2 /ColorSpace /DeviceRGB /Coords [0 0 1 0] /Function << /FunctionType 2 /Domain [0 1] /C0 [1 0 0] /C1 [0 0 1] /N 1 >> >> >>"
    labels = b"".join(b"BT /F1 8 Tf %d 288 Td (Q%d) Tj ET " % (82 + 30 * i, i + 1) for i in range(5))
    path = str(tmp_path / "elements")
    read(turned=pdf(turned), shaded=pdf(shaded, page_extra=extra), bare=pdf(b"/S1 sh", page_extra=extra), bars=pdf(BARS + labels)).write.parquet(path)
    texts = {r.doc_id: r.text for r in plan.document_text(spark.read.parquet(path)).collect()}
    assert "（35 段，未参与段落归并）" in texts["turned"] and all(f'"Side {i}"  旋转 ' in texts["turned"] for i in range(35)) and '"Flat"' in texts["turned"]
    assert "渐变填充区域" in texts["shaded"] and "线性渐变 色标 0%→#FF0000" in texts["shaded"] and "100%→#0000FF" in texts["shaded"]
    assert "渐变填充区域" in texts["bare"] and "宽=21.59 高=27.94" in texts["bare"]
    assert "柱5: 长度 3.18cm  x=7.06~7.69  #993366" in texts["bars"] and "1.00 : 2.00 : 3.00 : 1.50 : 2.50" in texts["bars"]
    assert "区域内及周边文字" in texts["bars"] and all(f"Q{i}" in texts["bars"].split("区域内及周边文字")[1] for i in range(1, 6))

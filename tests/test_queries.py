"""Queries against their SQL on the smallest tables, and functions that files seldom use."""

import duckdb
import pytest
from quirespark.functions import calculator, codecs
from quirespark.plans import parsed, relations, sample_files
from quirespark.sources import files, pdfpage

SOME = ["s6_pdf_structure", "s3_pdf_strings", "c8_filter_chains", "c16_security", "r7_hidden_layers", "r8_functions", "r9_color_spaces", "c28_font_decoding", "c3_lzw", "s19_mails", "j3_inherited_places", "k5_written_shapes", "d6_shapes_of_files"]
QUERIES = relations.QUERIES | {name: parsed.QUERIES[name] for name in SOME}
ORACLES = relations.ORACLES | parsed.ORACLES
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or hasattr(v, "normalize") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df, rel = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.collect()) == want


@pytest.mark.parametrize(
    ("program", "inputs", "out"),
    [
        (b"{ add 2 div }", [1, 4], [2.5]), (b"{ 3 1 roll }", [1, 2, 3], [3, 1, 2]), (b"{ 3 -1 roll }", [1, 2, 3], [2, 3, 1]), (b"{ 1 index }", [7, 8], [7, 8, 7]), (b"{ 2 copy }", [7, 8], [7, 8, 7, 8]),
        (b"{ dup 0 lt { neg } if }", [-3], [3]), (b"{ 90 sin exch 0 cos }", [5], [1, 5, 1]), (b"{ 1 0 atan }", [], [90]), (b"{ 7 2 idiv 7 2 mod 2 3 exp }", [], [3, 1, 8]), (b"{ true false or { 1 } { 2 } ifelse }", [], [1]),
        (b"{ 5 cvi 2.7 truncate -2.5 round 6 3 bitshift }", [], [5, 2, -2, 48]), (b"{ 0 div }", [3], [0]), (b"{ % a remark }\n pop 4 }", [1], [4]),
    ],
)
def test_calculator(program, inputs, out):
    assert calculator.run(calculator.parse(program), inputs) == pytest.approx(out)


def test_damaged_calculator():
    for program in (b"{ add }", b"{ what }"):
        with pytest.raises((ValueError, IndexError)):
            calculator.run(calculator.parse(program), [])


def test_code_spaces():
    m = pdfpage.CodeMap(b"2 begincodespacerange <00> <7F> <8100> <9FFF> endcodespacerange 1 begincidrange <8140> <8142> 5 endcidrange 1 begincidchar <41> 3 endcidchar")
    assert m.codes(b"A\x81\x42\xff") == [0x41, 0x8142, 0xFF00] and [m.glyph(c) for c in (0x41, 0x8142, 0x42)] == [3, 7, 0x42]


def test_damaged_files_give_error_rows(spark):
    good = sample_files.by_structure(1)
    torn = [good[:k] for k in range(0, len(good), 97)] + [good[:k] + b"\xff(<<[" + good[k + 5 :] for k in range(9, len(good), 61)] + [sample_files.by_lock(n).replace(b"/V ", b"/W ") for n in range(3)]
    frame = spark.createDataFrame([(str(i), b) for i, b in enumerate(torn)] + [("good", good)], "doc_id string, content binary")
    rows = files.pdf_elements(frame).groupBy("doc_id", "kind").count().collect()
    assert {r.doc_id for r in rows} == {*map(str, range(len(torn))), "good"}
    assert any(r.doc_id == "good" and r.kind == "text" for r in rows)


def test_hash_of_revision_6():
    assert codecs.hardened_hash(b"", b"12345678", 5) != codecs.hardened_hash(b"", b"12345678", 6)
    assert len(codecs.hardened_hash(b"", b"12345678", 6)) == 32

"""PPTX packages as rows: shapes of slides, layouts and masters as they are written, runs, cells and series; inheritance is left to joins."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

from .files import DAMAGE, frame

A, P, R, C = (f"{{http://schemas.openxmlformats.org/{x}}}" for x in ("drawingml/2006/main", "presentationml/2006/main", "officeDocument/2006/relationships", "drawingml/2006/chart"))

#: kind: deck (cx, cy), page (part is a slide, layout or master; parent is what it inherits from; color its background), shape, run, cell, series, style, theme, error.
ROWS = """doc_id string, kind string, role string, part string, parent string, page_no int, z int, depth int, shape string, geom string, name string, ph_type string, ph_group string, ph_idx string, hidden boolean,
  x long, y long, cx long, cy long, rot long, fill string, line string, line_width long, para int, run int, level int, text string, size double, bold boolean, italic boolean, font string, color string, align string,
  r int, c int, col_span int, row_span int, covered boolean, values array<double>, categories array<string>"""
#: Placeholder types that inherit as title; all others but these and `other` inherit as body.
TITLES, OTHERS = {"title", "ctrTitle"}, {"dt", "ftr", "sldNum", "hdr", "sldImg"}


def group(ph_type: str | None) -> str | None:
    return None if ph_type is None else "title" if ph_type in TITLES else ph_type if ph_type in OTHERS else "body"


class Package:
    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        self.known: dict[str, dict[str, tuple[str, str]]] = {}

    def xml(self, part: str) -> ElementTree.Element | None:
        try:
            return ElementTree.fromstring(self.zip.read(part)) if part in self.names else None
        except (ElementTree.ParseError, zlib.error, zipfile.BadZipFile):
            return None

    def rels(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, target part); read once for each part."""
        if part in self.known:
            return self.known[part]
        folder, name = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for e in root if root is not None else ():
            target = e.get("Target", "")
            if e.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[e.get("Id", "")] = (e.get("Type", "").rsplit("/", 1)[-1], target)
        self.known[part] = out
        return out


class Colors:
    """Theme colours by name, through a master's map."""

    def __init__(self, theme: ElementTree.Element | None, mapping: dict[str, str]):
        self.of, self.fonts = {}, {}
        for e in theme.iter(f"{A}clrScheme") if theme is not None else ():
            for c in e:
                inner = c[0] if len(c) else None
                if inner is not None:
                    self.of[c.tag.removeprefix(A)] = (inner.get("lastClr") or inner.get("val") or "000000").upper()
        for kind, key in (("majorFont", "+mj"), ("minorFont", "+mn")):
            for e in theme.iter(A + kind) if theme is not None else ():
                for tag, short in (("latin", "-lt"), ("ea", "-ea")):
                    face = e.find(A + tag)
                    self.fonts[key + short] = face.get("typeface") if face is not None else None
        self.map = mapping

    def color(self, box: ElementTree.Element | None) -> str | None:
        if box is None:
            return None
        for e in box:
            tag = e.tag.removeprefix(A)
            if tag == "srgbClr":
                base = e.get("val", "000000").upper()
            elif tag == "sysClr":
                base = (e.get("lastClr") or "000000").upper()
            elif tag == "schemeClr":
                name = e.get("val", "")
                base = self.of.get(self.map.get(name, name), "000000")
            elif tag == "prstClr":
                base = "000000"
            else:
                continue
            return "#" + self.modified(base, e)
        return None

    @staticmethod
    def modified(base: str, e: ElementTree.Element) -> str:
        import colorsys

        rgb = [int(base[i : i + 2], 16) / 255 for i in (0, 2, 4)]
        for m in e:
            tag, v = m.tag.removeprefix(A), int(m.get("val", "100000")) / 100000
            if tag in ("lumMod", "lumOff"):
                h, el, s = colorsys.rgb_to_hls(*rgb)
                rgb = list(colorsys.hls_to_rgb(h, min(1.0, el * v if tag == "lumMod" else el + v), s))
            elif tag == "shade":
                rgb = [x * v for x in rgb]
            elif tag == "tint":
                rgb = [x * v + 1 - v for x in rgb]
        return "".join(f"{int(min(1.0, max(0.0, x)) * 255 + 0.5):02X}" for x in rgb)

    def face(self, e: ElementTree.Element | None) -> str | None:
        for tag in ("ea", "latin"):
            f = e.find(A + tag) if e is not None else None
            if f is not None and f.get("typeface"):
                return self.fonts.get(f.get("typeface"), f.get("typeface"))
        return None


def _fill(colors: Colors, box: ElementTree.Element | None) -> str | None:
    """#RRGGBB, none, gradient, picture or pattern; null where nothing is said."""
    if box is None:
        return None
    for tag, said in (("noFill", "none"), ("gradFill", "gradient"), ("blipFill", "picture"), ("pattFill", "pattern")):
        if box.find(A + tag) is not None:
            return said
    return colors.color(box.find(f"{A}solidFill"))


def _style(colors: Colors, d: ElementTree.Element | None) -> dict:
    if d is None:
        return {}
    flag = lambda k: None if d.get(k) is None else d.get(k) in ("1", "true")
    return {"size": int(d.get("sz")) / 100 if d.get("sz") else None, "bold": flag("b"), "italic": flag("i"), "font": colors.face(d), "color": colors.color(d.find(f"{A}solidFill"))}


def _runs(colors: Colors, body: ElementTree.Element | None) -> Iterator[dict]:
    for n, p in enumerate(body.findall(f"{A}p") if body is not None else ()):
        ppr = p.find(f"{A}pPr")
        level, align = (int(ppr.get("lvl", "0")), ppr.get("algn")) if ppr is not None else (0, None)
        i = 0
        for e in p:
            tag = e.tag.removeprefix(A)
            if tag in ("r", "fld", "br"):
                text = "\n" if tag == "br" else "".join(t.text or "" for t in e.findall(f"{A}t"))
                yield {"para": n, "run": i, "level": level, "align": align, "text": text} | _style(colors, e.find(f"{A}rPr"))
                i += 1


def _shapes(package: Package, colors: Colors, part: str, tree: ElementTree.Element, depth: int = 0, hidden: bool = False, count: list[int] | None = None) -> Iterator[dict]:
    count = count if count is not None else [0]
    rels = package.rels(part) if depth == 0 else None
    for e in tree:
        tag = e.tag.removeprefix(P)
        if tag not in ("sp", "cxnSp", "pic", "graphicFrame", "grpSp"):
            continue
        z = count[0]
        count[0] += 1
        cnv = next(iter(e.iter(f"{P}cNvPr")), None)
        off = hidden or cnv is not None and cnv.get("hidden") in ("1", "true")
        spr = e.find(f"{P}grpSpPr") if tag == "grpSp" else e.find(f"{P}spPr")
        spr = spr if spr is not None else ElementTree.Element("none")
        xf = e.find(f"{P}xfrm") if tag == "graphicFrame" else spr.find(f"{A}xfrm")
        at, size = (xf.find(f"{A}off"), xf.find(f"{A}ext")) if xf is not None else (None, None)
        ph = next(iter(e.iter(f"{P}ph")), None) if tag != "grpSp" else None
        kind = ph.get("type", "body") if ph is not None else None
        geom = spr.find(f"{A}prstGeom")
        ln = spr.find(f"{A}ln")
        base = {"z": z, "depth": depth, "hidden": off}
        row = base | {
            "kind": "shape", "shape": tag, "geom": geom.get("prst") if geom is not None else "custom" if spr.find(f"{A}custGeom") is not None else None, "name": cnv.get("name") if cnv is not None else None, "ph_type": kind, "ph_group": group(kind), "ph_idx": ph.get("idx") if ph is not None else None,
            "rot": int(xf.get("rot", "0")) if xf is not None else None, "fill": _fill(colors, spr), "line": _fill(colors, ln), "line_width": int(ln.get("w")) if ln is not None and ln.get("w") else None,
        }
        if at is not None and size is not None:
            row |= {"x": int(at.get("x")), "y": int(at.get("y")), "cx": int(size.get("cx")), "cy": int(size.get("cy"))}
        table = next(iter(e.iter(f"{A}tbl")), None) if tag == "graphicFrame" else None
        chart = next(iter(e.iter(f"{C}chart")), None) if tag == "graphicFrame" else None
        if table is not None or chart is not None:
            row["shape"] = "table" if table is not None else "chart"
        yield row
        for run in _runs(colors, e.find(f"{P}txBody")):
            yield base | {"kind": "run"} | run
        if table is not None:
            widths = [int(g.get("w", "0")) for g in table.iter(f"{A}gridCol")]
            for r, tr in enumerate(table.findall(f"{A}tr")):
                for c, tc in enumerate(tr.findall(f"{A}tc")):
                    text = "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in tc.iter(f"{A}p"))
                    yield base | {"kind": "cell", "r": r, "c": c, "text": text, "col_span": int(tc.get("gridSpan", "1")), "row_span": int(tc.get("rowSpan", "1")), "covered": "1" in (tc.get("hMerge"), tc.get("vMerge")), "cx": widths[c] if c < len(widths) else None, "cy": int(tr.get("h", "0")), "fill": _fill(colors, tc.find(f"{A}tcPr"))}
        if chart is not None:
            target = (package.rels(part).get(chart.get(f"{R}id")) or (None, ""))[1]
            root = package.xml(target)
            for plot in (x for x in (root.iter() if root is not None else ()) if x.tag.startswith(C) and x.tag.endswith("Chart")):
                for n, ser in enumerate(plot.findall(f"{C}ser")):
                    pick = lambda k: [v.text or "" for v in ser.findall(f"{C}{k}//{C}pt/{C}v")]  # noqa: B023, E731
                    numbers = [float(v) if re.fullmatch(r"[-+0-9.eE]+", v) else None for v in pick("val")]
                    yield base | {"kind": "series", "run": n, "geom": plot.tag.removeprefix(C), "name": "".join(pick("tx")), "values": numbers, "categories": pick("cat")}
        if tag == "grpSp":
            yield from _shapes(package, colors, part, e, depth + 1, off, count)


def deck_rows(doc_id: str, data: bytes) -> Iterator[dict]:
    try:
        package = Package(data)
        main = "ppt/presentation.xml"
        root, rels = package.xml(main), package.rels(main)
        if root is None:
            raise ValueError("no presentation")
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        yield {"doc_id": doc_id, "kind": "error", "text": str(e)}
        return
    size = root.find(f"{P}sldSz")
    yield {"doc_id": doc_id, "kind": "deck", "cx": int(size.get("cx", "0")) if size is not None else 12192000, "cy": int(size.get("cy", "0")) if size is not None else 6858000}
    order = [rels[s.get(f"{R}id")][1] for s in root.iter(f"{P}sldId") if s.get(f"{R}id") in rels]
    order = order or sorted((n for n in package.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    todo, seen = [("slide", part, n) for n, part in enumerate(order, 1)], set()
    by_master: dict[str | None, Colors] = {}
    while todo:
        role, part, n = todo.pop(0)
        if part in seen or (tree := package.xml(part)) is None:
            continue
        seen.add(part)
        up = {"slide": "slideLayout", "layout": "slideMaster"}.get(role)
        parent = next((t for k, t in package.rels(part).values() if k == up), None)
        master = part if role == "master" else parent if role == "layout" else next((t for k, t in package.rels(parent).values() if k == "slideMaster"), None) if parent else None
        if master not in by_master:
            held = package.xml(master) if master else None
            theme = package.xml(next((t for k, t in package.rels(master).values() if k == "theme"), "")) if master else None
            clr = held.find(f"{P}clrMap") if held is not None else None
            by_master[master] = Colors(theme, dict(clr.attrib) if clr is not None else {})
        colors = by_master[master]
        own = {"doc_id": doc_id, "role": role, "part": part, "parent": parent, "page_no": n}
        bg = tree.find(f"{P}cSld/{P}bg/{P}bgPr")
        ref = tree.find(f"{P}cSld/{P}bg/{P}bgRef")
        cs = tree.find(f"{P}cSld")
        yield own | {"kind": "page", "name": cs.get("name") if cs is not None else None, "fill": _fill(colors, bg) if bg is not None else colors.color(ref), "hidden": tree.get("show") == "0" or tree.get("showMasterSp") == "0"}
        space = tree.find(f"{P}cSld/{P}spTree")
        for row in _shapes(package, colors, part, space) if space is not None else ():
            yield own | row
        for kind, tag in (("title", "titleStyle"), ("body", "bodyStyle"), ("other", "otherStyle")) if role == "master" else ():
            style = tree.find(f"{P}txStyles/{P}{tag}")
            for level in range(9):
                d = style.find(f"{A}lvl{level + 1}pPr/{A}defRPr") if style is not None else None
                if d is not None:
                    yield own | {"kind": "style", "ph_group": kind, "level": level} | _style(colors, d)
        if up and parent:
            todo.append(("layout" if role == "slide" else "master", parent, None))


def _frames(batches: Iterator[pd.DataFrame], size: int = 5000) -> Iterator[pd.DataFrame]:
    """ROWS of the decks of batches(doc_id, content), those of many decks in a frame: a frame costs as much as a deck's parsing."""
    held: list[dict] = []
    for batch in batches:
        for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
            try:
                rows = list(deck_rows(doc_id, bytes(content or b"")))
            except (*DAMAGE, SyntaxError, OSError, zipfile.BadZipFile, zlib.error) as e:
                rows = [{"doc_id": doc_id, "kind": "error", "text": f"{type(e).__name__}: {e}"}]
            held += rows
            if len(held) >= size:
                yield frame(held, ROWS)
                held = []
    if held:
        yield frame(held, ROWS)


def deck_elements(files: DataFrame) -> DataFrame:
    """ROWS of files(doc_id, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(batches)

    return files.select("doc_id", "content").mapInPandas(parse, ROWS)

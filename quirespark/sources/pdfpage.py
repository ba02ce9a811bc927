"""What a PDF page draws, as rows: text, paths, images and shadings with device boxes, and pages.

Device space starts at the page's top left, in points. The interpreter keeps the graphics state that
rows need; clips are boxes. It runs in a Python worker, a document at a time, and never leaves a page half read:
what was drawn before damage stays.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from typing import Any

from ..functions import calculator
from .pdf import END, Document, Name, Reader, Ref, Stream, Word

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def mul(m, n):
    a, b, c, d, e, f = m
    g, h, i, j, k, el = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + el)


def at(m, x, y):
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def around(points):
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def corners(box):
    x0, y0, x1, y1 = box
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def meet(a, b):
    return max(a[0], b[0]), max(a[1], b[1]), max(max(a[0], b[0]), min(a[2], b[2])), max(max(a[1], b[1]), min(a[3], b[3]))


def hexed(rgb):
    return "#" + "".join(f"{int(min(1.0, max(0.0, v)) * 255 + 0.5):02X}" for v in rgb)


# -- colour -----------------------------------------------------------------------------------


def function(doc: Document, f: Any, t: list[float]) -> list[float] | None:
    """Values of a PDF function: sampled (0), exponential (2), stitched (3), calculator (4); null where it can't be evaluated."""
    f = doc.get(f)
    d = f.values if isinstance(f, Stream) else f
    if isinstance(f, list):
        parts = [function(doc, x, t) for x in f]
        return [p[0] for p in parts] if all(parts) else None
    if not isinstance(d, dict):
        return None
    g = lambda k, default=None: default if doc.get(d.get(k)) is None else [doc.get(x) for x in v] if isinstance(v := doc.get(d.get(k)), list) else v
    kind, domain, ranges = g("FunctionType"), g("Domain", [0, 1]), g("Range", [])
    inputs = [min(max(x, lo), hi) for x, lo, hi in zip(t, domain[::2], domain[1::2], strict=False)]
    if not inputs:
        return None
    x, lo, hi = inputs[0], domain[0], domain[1]
    if kind == 2:
        c0, c1, share = g("C0", [0]), g("C1", [1]), (x - lo) / ((hi - lo) or 1)
        out = [a + share ** g("N", 1) * (b - a) for a, b in itertools.zip_longest(c0, c1, fillvalue=0)]
    elif kind == 3:
        bounds, encode, parts = g("Bounds", []), g("Encode", []), g("Functions", [])
        k = min(sum(b <= x for b in bounds), len(parts) - 1)
        edges = [lo, *bounds, hi]
        e0, e1 = encode[2 * k : 2 * k + 2] if len(encode) >= 2 * k + 2 else (0, 1)
        width = edges[k + 1] - edges[k]
        out = function(doc, parts[k], [e0 + (x - edges[k]) / width * (e1 - e0) if width else e0])
    elif kind == 0 and isinstance(f, Stream):
        out = _sampled(doc.bytes_of(f), inputs, domain, g("Size", [2] * len(inputs)), g("BitsPerSample", 8), g("Encode"), g("Decode", ranges))
    elif kind == 4 and isinstance(f, Stream):
        try:
            out = calculator.run(calculator.parse(doc.bytes_of(f)), inputs)
        except (ValueError, IndexError, TypeError, OverflowError) as e:
            doc.note(str(e))
            return None
    else:
        return None
    return out and [min(max(v, a), b) for v, a, b in zip(out, ranges[::2], ranges[1::2], strict=False)] if ranges else out


def _sampled(raw: bytes, inputs: list[float], domain: list, size: list, bits: int, encode: list | None, decode: list) -> list[float]:
    """Between the samples around the inputs, linear in each."""
    n, most, table = len(decode) // 2, (1 << bits) - 1, int.from_bytes(raw)
    corners: list[tuple[int, float]] = [(0, 1.0)]  # (index of a sample, its share)
    stride = 1
    for k, x in enumerate(inputs):
        e0, e1 = encode[2 * k : 2 * k + 2] if encode else (0, size[k] - 1)
        at = (x - domain[2 * k]) / ((domain[2 * k + 1] - domain[2 * k]) or 1) * (e1 - e0) + e0
        at = min(max(at, 0), size[k] - 1)
        below = int(at)
        corners = [(i + stride * j, share * part) for i, share in corners for j, part in ((below, 1 - at + below), (below + 1, at - below)) if part > 0]
        stride *= size[k]

    def sample(i: int, j: int) -> float:
        shift = len(raw) * 8 - (i * n + j + 1) * bits
        return ((table >> shift) & most if shift >= 0 else 0) / most

    return [decode[2 * j] + sum(share * sample(i, j) for i, share in corners) * (decode[2 * j + 1] - decode[2 * j]) for j in range(n)]


class Color:
    """A colour space: number of components, first colour and conversion to RGB."""

    def __init__(self, doc: Document, spec: Any, resources: dict, depth: int = 0):
        self.doc, self.kind, self.n, self.base, self.extra = doc, "Gray", 1, None, None
        spec = doc.get(spec)
        if isinstance(spec, Name):
            named = doc.get((doc.get(resources.get("ColorSpace")) or {}).get(spec))
            if named is not None and depth < 8:
                self.__init__(doc, named, {}, depth + 1)
                return
            self.kind = {"DeviceRGB": "RGB", "RGB": "RGB", "CalRGB": "RGB", "DeviceCMYK": "CMYK", "CMYK": "CMYK", "Pattern": "Pattern"}.get(spec, "Gray")
        elif isinstance(spec, list) and spec:
            head = str(doc.get(spec[0]))
            part = lambda i: doc.get(spec[i]) if i < len(spec) else None
            if head == "ICCBased" and isinstance(part(1), Stream):
                self.kind = {1: "Gray", 3: "RGB", 4: "CMYK"}.get(doc.get(part(1).values.get("N")), "RGB")
            elif head in ("Indexed", "I"):
                table = part(3)
                self.kind, self.base, self.extra = "Indexed", Color(doc, part(1), resources, depth + 1), doc.bytes_of(table) if isinstance(table, Stream) else table or b""
            elif head in ("Separation", "DeviceN"):
                self.kind, self.base, self.extra = "Tint", Color(doc, part(2), resources, depth + 1), spec[3] if len(spec) > 3 else None
                self.n = len(part(1)) if head == "DeviceN" and isinstance(part(1), list) else 1
            elif head == "Lab":
                self.kind = "Lab"
            else:
                self.kind = {"CalRGB": "RGB", "DeviceRGB": "RGB", "DeviceCMYK": "CMYK", "Pattern": "Pattern"}.get(head, "Gray")
        self.n = {"RGB": 3, "CMYK": 4, "Lab": 3}.get(self.kind, self.n)

    def first(self) -> list[float]:
        return [0, 0, 0, 1] if self.kind == "CMYK" else [1.0] * self.n if self.kind == "Tint" else [0.0] * self.n

    def rgb(self, v: list[float]) -> tuple | None:
        v = [x if isinstance(x, (int, float)) else 0 for x in v] + [0.0] * self.n
        if self.kind == "Gray":
            return (v[0],) * 3
        if self.kind == "RGB":
            return tuple(v[:3])
        if self.kind == "CMYK":
            return tuple((1 - x) * (1 - v[3]) for x in v[:3])
        if self.kind == "Lab":
            fy = (v[0] + 16) / 116
            cube = lambda t: t**3 if t**3 > 0.008856 else (t - 16 / 116) / 7.787
            x, y, z = cube(fy + v[1] / 500) * 0.95047, cube(fy), cube(fy - v[2] / 200) * 1.08883
            linear = (3.2406 * x - 1.5372 * y - 0.4986 * z, -0.9689 * x + 1.8758 * y + 0.0415 * z, 0.0557 * x - 0.2040 * y + 1.0570 * z)
            return tuple(12.92 * u if u <= 0.0031308 else 1.055 * u ** (1 / 2.4) - 0.055 for u in linear)
        if self.kind == "Indexed":
            n, i = self.base.n, int(v[0])
            return self.base.rgb([b / 255 for b in self.extra[i * n : i * n + n]])
        if self.kind == "Tint":
            got = function(self.doc, self.extra, v[: self.n])
            return self.base.rgb(got) if got else (1 - v[0],) * 3
        return None


# -- fonts ------------------------------------------------------------------------------------

_GLYPH_NAMES = {"space": " ", "hyphen": "-", "period": ".", "comma": ",", "colon": ":", "semicolon": ";", "quotesingle": "'", "quotedbl": '"', "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "fi", "fl": "fl", "exclam": "!", "question": "?", "slash": "/", "parenleft": "(", "parenright": ")", "percent": "%", "ampersand": "&", "numbersign": "#", "dollar": "$", "plus": "+", "equal": "=", "asterisk": "*", "at": "@", "underscore": "_", "bracketleft": "[", "bracketright": "]", "Euro": "€", "germandbls": "ß"}
_DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
_ACCENTS = {"acute": "́", "grave": "̀", "circumflex": "̂", "dieresis": "̈", "tilde": "̃", "cedilla": "̧", "ring": "̊", "caron": "̌"}


def glyph_text(name: str) -> str | None:
    """Unicode of a glyph name: known names, letters with accents by composition, uniXXXX; numbered glyphs are never guessed."""
    if re.fullmatch(r"(g|cid|index|glyph)\d+", name):
        return None
    name = name.split(".")[0]
    if "_" in name and name != "underscore":
        parts = [glyph_text(p) for p in name.split("_")]
        return "".join(parts) if all(parts) else None
    if name in _GLYPH_NAMES:
        return _GLYPH_NAMES[name]
    if name in _DIGITS:
        return str(_DIGITS.index(name))
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", name):
        return chr(int(m[1] or m[2], 16))
    if m := re.fullmatch(r"([A-Za-z])(" + "|".join(_ACCENTS) + ")", name):
        return unicodedata.normalize("NFC", m[1] + _ACCENTS[m[2]])
    try:
        return unicodedata.lookup(name.upper())
    except KeyError:
        return None


def to_unicode(data: bytes) -> dict[int, str]:
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    reader, section, held = Reader(data), "", []
    while (x := reader.next()) is not END:
        if isinstance(x, Word):
            if x.startswith("begin"):
                section, held = x[5:], []
            elif x == "endbfchar" and section == "bfchar":
                for a, b in zip(held[::2], held[1::2], strict=False):
                    if isinstance(a, bytes) and isinstance(b, bytes):
                        out[int.from_bytes(a)] = text(b)
            elif x == "endbfrange" and section == "bfrange":
                for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                    lo, hi = int.from_bytes(a), int.from_bytes(b)
                    for i in range(hi - lo + 1 if hi - lo <= 65535 else 0):
                        if isinstance(c, list):
                            if i < len(c):
                                out[lo + i] = text(c[i])
                        elif len(c) >= 2:
                            out[lo + i] = text(c[:-2] + ((int.from_bytes(c[-2:]) + i) & 0xFFFF).to_bytes(2))
        else:
            held.append(x)
    return out


class CodeMap:
    """An embedded encoding: which bytes make a code, and the glyph numbers of codes."""

    def __init__(self, data: bytes):
        self.spaces: list[tuple[int, int, int]] = []  # least, greatest, bytes
        self.blocks: list[tuple[int, int, int]] = []  # least, greatest, glyph number of the least
        reader, held = Reader(data), []
        while (x := reader.next()) is not END:
            if not isinstance(x, Word):
                held.append(x)
                continue
            number = [int.from_bytes(v) if isinstance(v, bytes) else v for v in held]
            if x == "endcodespacerange":
                self.spaces += [(a, b, len(v)) for a, b, v in zip(number[::2], number[1::2], held[::2], strict=False) if isinstance(v, bytes)]
            elif x == "endcidrange":
                self.blocks += [(a, b, c) for a, b, c in zip(number[::3], number[1::3], number[2::3], strict=False) if isinstance(c, int)]
            elif x == "endcidchar":
                self.blocks += [(a, a, c) for a, c in zip(number[::2], number[1::2], strict=False) if isinstance(c, int)]
            held = []

    def codes(self, data: bytes) -> list[int]:
        """By the first code space that holds what comes next, two bytes where none does."""
        out, i = [], 0
        while i < len(data):
            fits = [n for lo, hi, n in self.spaces if i + n <= len(data) and lo <= int.from_bytes(data[i : i + n]) <= hi]
            n = fits[0] if fits else 2
            out.append(int.from_bytes(data[i : i + n].ljust(n, b"\0")))
            i += n
        return out

    def glyph(self, code: int) -> int:
        return next((c + code - lo for lo, hi, c in reversed(self.blocks) if lo <= code <= hi), code)


class Font:
    def __init__(self, doc: Document, d: dict):
        g = lambda k, of=d: doc.get(of.get(k))
        self.wide = g("Subtype") == "Type0"
        inner = doc.get((g("DescendantFonts") or [None])[0]) if self.wide else d
        inner = inner if isinstance(inner, dict) else {}
        fd = g("FontDescriptor", inner) or {}
        raw = str(g("FontName", fd) or g("BaseFont") or "")
        self.raw, low = raw, raw.lower()
        number = lambda k: g(k, fd) if isinstance(g(k, fd), (int, float)) else 0
        flags = int(number("Flags"))
        self.bold = bool(re.search(r"bold|black|heavy|semibold|demibold|[-,]b[do]?\b", low)) or number("FontWeight") >= 600 or bool(flags & 1 << 18)
        self.italic = bool(re.search(r"italic|oblique|[-,]i\b", low)) or abs(number("ItalicAngle")) > 4 or bool(flags & 1 << 6)
        self.symbolic = bool(flags & 4)
        box = [doc.get(x) for x in g("FontBBox", fd) or []]
        self.top, self.bottom = (float(box[3]), float(box[1])) if len(box) == 4 else (None, None)
        self.widths: dict[int, float] = {}
        self.default = 1000 if self.wide else number("MissingWidth")
        if self.wide:
            if isinstance(g("DW", inner), (int, float)):
                self.default = g("DW", inner)
            self._cid_widths(doc, g("W", inner) or [])
        elif isinstance(g("Widths"), list) and isinstance(g("FirstChar"), int):
            self.widths = {g("FirstChar") + i: v for i, x in enumerate(g("Widths")) if isinstance(v := doc.get(x), (int, float))}
        elif not self.widths:
            self.default = self.default or 500
        self.names = {} if self.wide else self._names(doc, g("Encoding"))
        enc = g("Encoding") if self.wide else None
        self.map = CodeMap(doc.bytes_of(enc)) if isinstance(enc, Stream) else None
        tu = g("ToUnicode")
        self.unicode = to_unicode(doc.bytes_of(tu)) if isinstance(tu, Stream) else {}

    def _cid_widths(self, doc: Document, w: list) -> None:
        i = 0
        while i + 1 < len(w):
            a, b = doc.get(w[i]), doc.get(w[i + 1])
            if isinstance(b, list):
                self.widths |= {a + k: doc.get(x) for k, x in enumerate(b)}
                i += 2
            else:
                c = doc.get(w[i + 2]) if i + 2 < len(w) else None
                if isinstance(c, (int, float)) and b - a <= 65535:
                    self.widths |= dict.fromkeys(range(a, b + 1), c)
                i += 3

    def _names(self, doc: Document, enc: Any) -> dict[int, str]:
        base = str(enc) if isinstance(enc, Name) else str(doc.get(enc.get("BaseEncoding")) or "") if isinstance(enc, dict) else ""
        codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(base, "latin-1")
        out = {}
        for code in range(32, 256):
            if codec == "latin-1" and 127 <= code < 161:
                continue
            try:
                out[code] = bytes([code]).decode(codec)
            except UnicodeDecodeError:
                pass
        if isinstance(enc, dict):
            code = 0
            for x in doc.get(enc.get("Differences")) or []:
                x = doc.get(x)
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    if (t := glyph_text(x)) is None:
                        out.pop(code, None)
                    else:
                        out[code] = t
                    code += 1
        return out

    def codes(self, data: bytes) -> list[int]:
        if self.map and self.map.spaces:
            return self.map.codes(data)
        return [int.from_bytes(data[i : i + 2]) for i in range(0, len(data), 2)] if self.wide else list(data)

    def text(self, code: int) -> str | None:
        return self.unicode.get(code) or (None if self.wide else self.names.get(code))

    def width(self, code: int) -> float:
        return self.widths.get(self.map.glyph(code) if self.map else code, self.default) / 1000


# -- interpreter ------------------------------------------------------------------------------


class State:
    def __init__(self, ctm, clip, gray):
        self.ctm, self.clip = ctm, clip
        self.fill_space = self.stroke_space = gray
        self.fill, self.stroke = [0.0], [0.0]
        self.fill_pattern = self.stroke_pattern = None
        self.width, self.dash, self.fill_alpha, self.stroke_alpha, self.blend, self.soft = 1.0, False, 1.0, 1.0, None, False
        self.font, self.size, self.char, self.word, self.scale, self.leading, self.rise, self.mode = None, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0

    def copy(self) -> State:
        new = object.__new__(State)
        new.__dict__.update(self.__dict__)
        return new

    def color(self, stroke: bool) -> str | None:
        space, values, pattern = (self.stroke_space, self.stroke, self.stroke_pattern) if stroke else (self.fill_space, self.fill, self.fill_pattern)
        rgb = None if pattern else space.rgb(values)
        return hexed(rgb) if rgb else None


class Page:
    """Rows of one page: call run()."""

    MOST_OPERATORS, DEEPEST = 3_000_000, 12

    def __init__(self, doc: Document, page: dict, fonts: dict, annotations: bool = True):
        self.doc, self.page, self.fonts, self.annotations = doc, page, fonts, annotations
        self.rows: list[dict] = []
        self.hidden = doc.hidden_layers()
        self.gray = Color(doc, Name("DeviceGray"), {})

    def numbers(self, value: Any) -> list[float]:
        v = self.doc.get(value)
        return [x if isinstance(x := self.doc.get(e), (int, float)) else 0 for e in v] if isinstance(v, list) else []

    def run(self) -> dict:
        g = self.doc.get
        media = self.numbers(self.page.get("MediaBox"))
        crop = self.numbers(self.page.get("CropBox"))
        box = crop if len(crop) == 4 and abs(crop[2] - crop[0]) > 1 and abs(crop[3] - crop[1]) > 1 else media if len(media) == 4 else [0, 0, 612, 792]
        x0, x1, y0, y1 = min(box[0], box[2]), max(box[0], box[2]), min(box[1], box[3]), max(box[1], box[3])
        rot = int(round((g(self.page.get("Rotate")) or 0) / 90) * 90) % 360
        base = {90: (0, 1, 1, 0, -y0, -x0), 180: (-1, 0, 0, 1, x1, -y0), 270: (0, -1, -1, 0, y1, x1)}.get(rot, (1, 0, 0, -1, -x0, y1))
        self.w, self.h = (x1 - x0, y1 - y0) if rot in (0, 180) else (y1 - y0, x1 - x0)
        whole = (0.0, 0.0, self.w, self.h)
        resources = g(self.page.get("Resources")) or {}
        self.execute(self.doc.content(self.page), resources, State(base, whole, self.gray), 0)
        if self.annotations:
            self.run_annotations(base, whole)
        return {"w": float(self.w), "h": float(self.h), "rot": rot}

    def is_hidden(self, ref: Any) -> bool:
        if not isinstance(ref, Ref):
            return False
        if ref.num in self.hidden:
            return True
        d = self.doc.get(ref)
        if isinstance(d, dict) and self.doc.get(d.get("Type")) == "OCMD":
            held = d.get("OCGs")
            members = self.doc.get(held) if isinstance(self.doc.get(held), list) else [held]
            return any(isinstance(r, Ref) and r.num in self.hidden for r in members)
        return False

    def run_annotations(self, base, whole) -> None:
        g = self.doc.get
        for ref in g(self.page.get("Annots")) or []:
            a = g(ref)
            if not isinstance(a, dict) or g(a.get("Subtype")) in ("Link", "Popup") or int(g(a.get("F")) or 0) & 34 or self.is_hidden(a.get("OC")):
                continue
            look = g((g(a.get("AP")) or {}).get("N"))
            if isinstance(look, dict):
                state = g(a.get("AS"))
                look = g(look.get(state) if isinstance(state, Name) else next(iter(look.values()), None))
            rect = self.numbers(a.get("Rect"))
            if not isinstance(look, Stream) or len(rect) != 4:
                continue
            matrix = tuple(self.numbers(look.values.get("Matrix"))) or IDENTITY
            bx0, by0, bx1, by1 = around([at(matrix, *p) for p in corners(self.numbers(look.values.get("BBox")) or [0, 0, 1, 1])])
            rx0, rx1, ry0, ry1 = min(rect[::2]), max(rect[::2]), min(rect[1::2]), max(rect[1::2])
            sx = (rx1 - rx0) / (bx1 - bx0) if bx1 - bx0 > 1e-6 else 1.0
            sy = (ry1 - ry0) / (by1 - by0) if by1 - by0 > 1e-6 else 1.0
            state = State(mul(mul(matrix, (sx, 0, 0, sy, rx0 - bx0 * sx, ry0 - by0 * sy)), base), whole, self.gray)
            before = len(self.rows)
            self.execute(self.doc.bytes_of(look), g(look.values.get("Resources")) or {}, state, 1)
            for row in self.rows[before:]:
                row["annotation"] = str(g(a.get("Subtype")) or "")

    def add(self, kind: str, state: State, hidden: bool, box, **more) -> None:
        self.rows.append({"seq": len(self.rows), "kind": kind, "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "hidden": hidden, "clip": state.clip, **more})

    def execute(self, data: bytes, resources: dict, s: State, depth: int) -> None:
        try:
            self._execute(data, resources, s, depth)
        except (ValueError, TypeError, IndexError, KeyError, AttributeError, ZeroDivisionError, RecursionError) as e:
            self.doc.note(f"content stopped: {type(e).__name__}")

    def _execute(self, data: bytes, resources: dict, s: State, depth: int) -> None:
        if depth > self.DEEPEST:
            self.doc.note("forms nested too deep")
            return
        g = self.doc.get
        res = lambda kind, name: (g(resources.get(kind)) or {}).get(name)
        reader, args, stack = Reader(data), [], []
        line = text = IDENTITY
        path: list[dict] = []
        current: dict | None = None
        point = start = None
        clipping = False
        marks: list[bool] = []
        count = 0

        def number(i: int) -> float:
            return args[i] if -len(args) <= i and isinstance(args[i], (int, float)) and not isinstance(args[i], bool) else 0

        def finish() -> None:
            nonlocal current
            if current and len(current["pts"]) > 1:
                path.append(current)
            current = None

        while (x := reader.next()) is not END:
            count += 1
            if count > self.MOST_OPERATORS:
                self.doc.note("content cut off")
                break
            if not isinstance(x, Word):
                args.append(x)
                del args[:-64]
                continue
            op = str(x)
            hidden = any(marks)
            if op == "q":
                stack.append(s.copy())
            elif op == "Q":
                s = stack.pop() if stack else s
            elif op == "cm" and len(args) >= 6:
                s.ctm = mul([number(i) for i in range(-6, 0)], s.ctm)
            elif op == "w":
                s.width = number(-1)
            elif op == "d":
                s.dash = len(args) > 1 and isinstance(args[-2], list) and bool(args[-2])
            elif op == "gs":
                self.extended(g(res("ExtGState", args[-1])), s)
            elif op in ("g", "rg", "k", "G", "RG", "K"):
                n = {"g": 1, "rg": 3, "k": 4}[op.lower()]
                space = Color(self.doc, Name({1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n]), {})
                self.set_color(s, op.isupper(), space, [number(i) for i in range(-n, 0)])
            elif op in ("cs", "CS"):
                space = Color(self.doc, args[-1], resources)
                self.set_color(s, op == "CS", space, space.first())
            elif op in ("sc", "scn", "SC", "SCN"):
                stroke = op.isupper()
                space = s.stroke_space if stroke else s.fill_space
                if args and isinstance(args[-1], Name):
                    setattr(s, "stroke_pattern" if stroke else "fill_pattern", self.pattern(g(res("Pattern", args[-1]))) or {"kind": "unknown"})
                else:
                    self.set_color(s, stroke, space, [a for a in args if isinstance(a, (int, float))][-max(1, space.n) :])
            elif op == "m":
                finish()
                point = start = at(s.ctm, number(-2), number(-1))
                current = {"pts": [point], "curves": False, "closed": False, "is_rect": False, "n_ctrl": 0}
            elif op in ("l", "c", "v", "y"):
                current = current or {"pts": [point] if point else [], "curves": False, "closed": False, "is_rect": False, "n_ctrl": 0}
                end = at(s.ctm, number(-2), number(-1))
                if op == "l":
                    current["pts"].append(end)
                else:
                    p1 = at(s.ctm, number(-6), number(-5)) if op == "c" else point or at(s.ctm, number(-4), number(-3)) if op == "v" else at(s.ctm, number(-4), number(-3))
                    p2 = end if op == "y" else at(s.ctm, number(-4), number(-3))
                    p0 = point or p1
                    for i in range(1, 9):
                        u = i / 8
                        k = ((1 - u) ** 3, 3 * (1 - u) ** 2 * u, 3 * (1 - u) * u * u, u**3)
                        current["pts"].append(tuple(sum(w * p[j] for w, p in zip(k, (p0, p1, p2, end), strict=True)) for j in (0, 1)))
                    current["curves"] = True
                    current["n_ctrl"] += 1
                point = end
            elif op == "h":
                if current:
                    current["closed"], point = True, start or point
            elif op == "re":
                finish()
                x0, y0, w, h = (number(i) for i in range(-4, 0))
                pts = [at(s.ctm, *p) for p in corners((x0, y0, x0 + w, y0 + h))]
                path.append({"pts": pts, "curves": False, "closed": True, "is_rect": True, "n_ctrl": 0})
                point = start = pts[0]
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                if op in ("s", "f", "F", "f*", "b", "b*") and current:
                    current["closed"] = True
                finish()
                fill, stroke = op[0] in "fFBb", op[0] in "SsBb"
                if path and (fill or stroke):
                    self.paint(path, s, fill, stroke, op.endswith("*"), hidden)
                if clipping and path:
                    s.clip = meet(s.clip, around([p for sub in path for p in sub["pts"]]))
                clipping, path, start = False, [], None
            elif op in ("W", "W*"):
                clipping = True
            elif op == "BT":
                line = text = IDENTITY
            elif op in ("Tc", "Tw", "TL", "Ts", "Tr"):
                setattr(s, {"Tc": "char", "Tw": "word", "TL": "leading", "Ts": "rise", "Tr": "mode"}[op], number(-1))
            elif op == "Tz":
                s.scale = number(-1) / 100
            elif op == "Tf":
                s.size = number(-1)
                s.font = self.font(res("Font", args[-2])) if len(args) > 1 and isinstance(args[-2], Name) else s.font
            elif op in ("Td", "TD"):
                if op == "TD":
                    s.leading = -number(-1)
                line = text = mul((1, 0, 0, 1, number(-2), number(-1)), line)
            elif op == "Tm" and len(args) >= 6:
                line = text = tuple(number(i) for i in range(-6, 0))
            elif op == "T*":
                line = text = mul((1, 0, 0, 1, 0, -s.leading), line)
            elif op in ("Tj", "'", '"', "TJ"):
                if op == '"':
                    s.word, s.char = number(-3), number(-2)
                if op in "'\"":
                    line = text = mul((1, 0, 0, 1, 0, -s.leading), line)
                shown = args[-1] if args else None
                for part in shown if isinstance(shown, list) else [shown]:
                    if isinstance(part, bytes):
                        text = self.show(part, s, text, hidden)
                    elif isinstance(part, (int, float)):
                        text = mul((1, 0, 0, 1, -part / 1000 * s.size * s.scale, 0), text)
            elif op == "Do" and args and isinstance(args[-1], Name):
                self.draw(args[-1], g(res("XObject", args[-1])), resources, s, depth, hidden)
            elif op == "BI":
                self.inline_image(reader, s, hidden)
            elif op == "sh" and args:
                if gradient := self.shading(g(res("Shading", args[-1]))):
                    self.add("shading", s, hidden, s.clip, pattern=gradient)
            elif op in ("BDC", "BMC"):
                off = False
                if op == "BDC" and len(args) > 1 and args[-2] == "OC":
                    off = self.is_hidden(res("Properties", args[-1]) if isinstance(args[-1], Name) else args[-1])
                marks.append(off)
            elif op == "EMC" and marks:
                marks.pop()
            args.clear()

    def set_color(self, s: State, stroke: bool, space: Color, values: list[float]) -> None:
        if stroke:
            s.stroke_space, s.stroke, s.stroke_pattern = space, values, None
        else:
            s.fill_space, s.fill, s.fill_pattern = space, values, None

    def extended(self, e: Any, s: State) -> None:
        if not isinstance(e, dict):
            return
        g = self.doc.get
        for key, name in (("ca", "fill_alpha"), ("CA", "stroke_alpha"), ("LW", "width")):
            if isinstance(g(e.get(key)), (int, float)):
                setattr(s, name, g(e[key]))
        blend = g(e.get("BM"))
        blend = g(blend[0]) if isinstance(blend, list) and blend else blend
        if isinstance(blend, Name) and blend not in ("Normal", "Compatible"):
            s.blend = str(blend)
        mask = g(e.get("SMask"))
        s.soft = mask is not None and mask != "None"
        font = g(e.get("Font"))
        if isinstance(font, list) and len(font) > 1:
            s.font, s.size = self.font(font[0]) or s.font, g(font[1]) or 0

    def font(self, ref: Any) -> Font | None:
        d = self.doc.get(ref)
        if not isinstance(d, dict):
            self.doc.note("font missing")
            return None
        key = ref.num if isinstance(ref, Ref) else id(d)
        if key not in self.fonts:
            self.fonts[key] = Font(self.doc, d)
        return self.fonts[key]

    def pattern(self, p: Any) -> dict | None:
        d = p.values if isinstance(p, Stream) else p
        if not isinstance(d, dict):
            return None
        return {"kind": "tiling"} if self.doc.get(d.get("PatternType")) == 1 else self.shading(self.doc.get(d.get("Shading")))

    def shading(self, sh: Any) -> dict | None:
        d = sh.values if isinstance(sh, Stream) else sh
        if not isinstance(d, dict):
            return None
        kind = {1: "function", 2: "axial", 3: "radial"}.get(self.doc.get(d.get("ShadingType")), "mesh")
        space, stops = Color(self.doc, d.get("ColorSpace"), {}), []
        domain = self.numbers(d.get("Domain")) or [0, 1]
        for t in (0.0, 0.5, 1.0) if kind in ("axial", "radial") else ():
            v = function(self.doc, d.get("Function"), [domain[0] + t * (domain[1] - domain[0])])
            if v and (rgb := space.rgb(v)):
                stops.append({"t": t, "color": hexed(rgb)})
        return {"kind": kind, "stops": stops}

    def paint(self, path, s: State, fill: bool, stroke: bool, even_odd: bool, hidden: bool) -> None:
        m = s.ctm
        self.add(
            "path", s, hidden, around([p for sub in path for p in sub["pts"]]), subpaths=[sub | {"pts": [{"x": float(x), "y": float(y)} for x, y in sub["pts"]]} for sub in path],
            fill=s.color(False) if fill else None, stroke=s.color(True) if stroke else None, pattern=s.fill_pattern if fill else None, line_width=float(s.width * math.sqrt(abs(m[0] * m[3] - m[1] * m[2]))), dash=bool(s.dash),
            fill_alpha=float(s.fill_alpha), stroke_alpha=float(s.stroke_alpha), blend=s.blend, soft_mask=s.soft, even_odd=even_odd,
        )

    def show(self, data: bytes, s: State, tm, hidden: bool):
        font = s.font
        if font is None:
            self.doc.note("text without font")
            return tm
        scaled = (s.size * s.scale, 0, 0, s.size, 0, s.rise)
        first, text, bad = mul(mul(scaled, tm), s.ctm), [], 0
        for code in font.codes(data):
            t = font.text(code)
            bad += t is None
            text.append("�" if t is None else t)
            space = s.word if code == 32 and not font.wide else 0
            tm = mul((1, 0, 0, 1, (font.width(code) * s.size + s.char + space) * s.scale, 0), tm)
        last = mul(mul(scaled, tm), s.ctm)
        if text:
            stroke = s.mode in (1, 5)
            self.add(
                "text", s, hidden, (first[4], first[5], last[4], last[5]), text="".join(text), size=math.hypot(first[2], first[3]), rot=math.degrees(math.atan2(first[1], first[0])), font=font.raw, bold=font.bold, italic=font.italic,
                color=s.color(stroke), alpha=float(s.stroke_alpha if stroke else s.fill_alpha), invisible=s.mode in (3, 7), bad=bad, font_top=font.top, font_bottom=font.bottom,
            )
        return tm

    def draw(self, name: str, xo: Any, resources: dict, s: State, depth: int, hidden: bool) -> None:
        g = self.doc.get
        if not isinstance(xo, Stream):
            return
        if self.is_hidden(xo.values.get("OC")):
            self.doc.note("hidden layer")
            return
        if g(xo.values.get("Subtype")) == "Image":
            self.image(xo.values, s, name, hidden)
        elif g(xo.values.get("Subtype")) == "Form":
            inner = s.copy()
            inner.ctm = mul(tuple(self.numbers(xo.values.get("Matrix"))) or IDENTITY, s.ctm)
            box = self.numbers(xo.values.get("BBox"))
            if len(box) == 4:
                inner.clip = meet(s.clip, around([at(inner.ctm, *p) for p in corners(box)]))
            before, own = len(self.rows), g(xo.values.get("Resources")) or resources
            self.execute(self.doc.bytes_of(xo), own, inner, depth + 1)
            if hidden:
                for row in self.rows[before:]:
                    row["hidden"] = True

    def image(self, d: dict, s: State, name: str, hidden: bool) -> None:
        from ..functions.codecs import IMAGE_FILTERS

        g = lambda *keys: next((v for k in keys if (v := self.doc.get(d.get(k))) is not None), None)
        names, _ = self.doc.filters(d)
        mask = g("ImageMask", "IM") is True
        self.add(
            "image", s, hidden, around([at(s.ctm, *p) for p in corners((0, 0, 1, 1))]), pix_w=int(g("Width", "W") or 0), pix_h=int(g("Height", "H") or 0), format=next((IMAGE_FILTERS[n] for n in names if n in IMAGE_FILTERS), "bitmap"),
            mask=mask, resource=name, alpha=float(s.fill_alpha), rot=math.degrees(math.atan2(s.ctm[1], s.ctm[0])), soft_mask=d.get("SMask") is not None or d.get("Mask") is not None,
        )

    def inline_image(self, reader: Reader, s: State, hidden: bool) -> None:
        d: dict = {}
        while (k := reader.next()) is not END and not (isinstance(k, Word) and k == "ID"):
            if isinstance(k, Name):
                d[str(k)] = reader.next()
        end = re.compile(rb"(?<=[\0\t\n\f\r ])EI(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)").search(reader.data, reader.at + 1)
        reader.at = end.end() if end else len(reader.data)
        self.image(d, s, "(inline)", hidden)

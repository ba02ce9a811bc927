"""Geometry, colour, unit and rounding scalars as column expressions. Boxes are x0, y0, x1, y1 from the top left, in points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PT_PER_INCH, CM_PER_INCH, EMU_PER_PT, PX_PER_INCH = 72.0, 2.54, 12700.0, 96.0
#: Decimals shown for each unit.
DECIMALS = {"pt": 1, "in": 3, "cm": 2, "emu": 0}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def round_half_up(value, digits: int = 0) -> Column:
    """floor(v * 10^n + 0.5) / 10^n: halves go up, also below zero."""
    scale = float(10**digits)
    return F.floor(_c(value) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def shown(value) -> Column:
    """A number as text without a trailing .0."""
    v = _c(value)
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def to_unit(points, unit: str = "cm", scale: float = 1.0) -> Column:
    factor = {"pt": 1.0, "in": 1 / PT_PER_INCH, "cm": CM_PER_INCH / PT_PER_INCH, "emu": EMU_PER_PT}[unit]
    return round_half_up(_c(points) * F.lit(scale) * F.lit(factor), DECIMALS[unit])


def from_unit(value, unit: str) -> Column:
    factor = {"pt": 1.0, "in": PT_PER_INCH, "cm": PT_PER_INCH / CM_PER_INCH, "emu": 1 / EMU_PER_PT, "px": PT_PER_INCH / PX_PER_INCH}[unit]
    return _c(value) * F.lit(factor)


def overlap(a: tuple, b: tuple) -> Column:
    """Area that two boxes share, 0 when apart."""
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = (tuple(map(_c, a)), tuple(map(_c, b)))
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    return w * h


def area(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    return (_c(x1) - _c(x0)) * (_c(y1) - _c(y0))


def multiply(m: Column, n: Column) -> Column:
    """Affine m followed by n; both are arrays a b c d e f."""
    a, b, c, d, e, f = (F.get(m, F.lit(i)) for i in range(6))
    g, h, i, j, k, el = (F.get(n, F.lit(x)) for x in range(6))
    return F.array(a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + el)


def apply_to(m: Column, x, y) -> tuple[Column, Column]:
    a, b, c, d, e, f = (F.get(m, F.lit(i)) for i in range(6))
    return a * _c(x) + c * _c(y) + e, b * _c(x) + d * _c(y) + f


def matrix_scale(m: Column) -> Column:
    """Square root of the absolute determinant."""
    a, b, c, d = (F.get(m, F.lit(i)) for i in range(4))
    return F.sqrt(F.abs(a * d - b * c))


def page_matrix(x0, y0, x1, y1, rotate) -> tuple[Column, Column, Column]:
    """(matrix, width, height) of a page whose box and rotation these are: device space starts at the top left."""
    x0, y0, x1, y1 = map(_c, (x0, y0, x1, y1))
    turn = F.pmod(_c(rotate), F.lit(360))
    w, h, one, zero = x1 - x0, y1 - y0, F.lit(1.0), F.lit(0.0)
    m = (
        F.when(turn == 90, F.array(zero, one, one, zero, -y0, -x0))
        .when(turn == 180, F.array(-one, zero, zero, one, x1, -y0))
        .when(turn == 270, F.array(zero, -one, -one, zero, y1, x1))
        .otherwise(F.array(one, zero, zero, -one, -x0, y1))
    )
    flat = turn.isin(0, 180)
    return m, F.when(flat, w).otherwise(h), F.when(flat, h).otherwise(w)


def _byte(v: Column) -> Column:
    return F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("bigint")), 2, "0")


def rgb_hex(r, g, b) -> Column:
    """#RRGGBB of components from 0 to 1."""
    return F.concat(F.lit("#"), *[_byte(_c(x).cast("double")) for x in (r, g, b)])


def cmyk_rgb(c, m, y, k) -> tuple[Column, Column, Column]:
    k = _c(k)
    return tuple((1 - _c(x)) * (1 - k) for x in (c, m, y))


def lab_rgb(lightness, a, b) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65 white) to sRGB."""
    fy = (_c(lightness) + 16) / 116
    fx, fz = fy + _c(a) / 500, fy - _c(b) / 200
    cube = lambda t: F.when(t * t * t > 0.008856, t * t * t).otherwise((t - 16 / 116) / 7.787)
    x, y, z = cube(fx) * 0.95047, cube(fy), cube(fz) * 1.08883
    linear = (3.2406 * x - 1.5372 * y - 0.4986 * z, -0.9689 * x + 1.8758 * y + 0.0415 * z, 0.0557 * x - 0.2040 * y + 1.0570 * z)
    gamma = lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), gamma(v))) for v in linear)


def hsl_rgb(h, s, el) -> tuple[Column, Column, Column]:
    """Hue in turns, saturation and lightness from 0 to 1."""
    h, s, el = map(_c, (h, s, el))
    q = F.when(el < 0.5, el * (1 + s)).otherwise(el + s - el * s)
    p = 2 * el - q

    def channel(t: Column) -> Column:
        t = F.pmod(t, F.lit(1.0))
        return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)

    return tuple(F.when(s == 0, el).otherwise(channel(h + d)) for d in (1 / 3, 0.0, -1 / 3))


def rgb_hsl(r, g, b) -> tuple[Column, Column, Column]:
    r, g, b = map(_c, (r, g, b))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d, el = high - low, (high + low) / 2
    s = F.when(d == 0, 0.0).otherwise(d / F.when(el > 0.5, 2 - high - low).otherwise(high + low))
    h = F.when(d == 0, 0.0).when(high == r, F.pmod((g - b) / d, F.lit(6.0))).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return h / 6, s, el


#: Names and sizes in points, either way round, within PAPER_TOLERANCE.
PAPERS = [("A4", 595, 842), ("Letter", 612, 792), ("A3", 842, 1191)]
SLIDES = [("4:3", 720, 540), ("16:9", 960, 540), ("16:9", 720, 405)]
PAPER_TOLERANCE, RATIO_TOLERANCE = 8, 0.03


def paper(w, h) -> Column:
    """A4, Letter, A3, 4:3, 16:9, or ~16:9 and ~4:3 by ratio only; null if none."""
    w, h = _c(w), _c(h)
    near = lambda a, b: (F.abs(w - a) < PAPER_TOLERANCE) & (F.abs(h - b) < PAPER_TOLERANCE)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, a, b in PAPERS:
        chain = chain.when(near(a, b) | near(b, a), name)
    for name, a, b in SLIDES:
        chain = chain.when(near(a, b), name)
    return chain.when(F.abs(w / h - 16 / 9) < RATIO_TOLERANCE, "~16:9").when(F.abs(w / h - 4 / 3) < RATIO_TOLERANCE, "~4:3")


#: Slide sizes in points.
TARGETS = {"16:9": (960.0, 540.0), "4:3": (720.0, 540.0)}


def fit(w, h, target: str) -> tuple[Column, Column, Column]:
    """(scale, x offset, y offset) that fit and centre a page on a slide; width only for a null height."""
    tw, th = TARGETS[target]
    w, h = _c(w), _c(h)
    s = F.least(F.lit(tw) / w, F.lit(th) / h)
    return s, (F.lit(tw) - w * s) / 2, (F.lit(th) - h * s) / 2


def ascent(box_top="font_box_top") -> Column:
    """Share of the size above the baseline: 0.78, or the font box's, 1.2 at most."""
    t = _c(box_top)
    return F.when(t > 0, F.least(F.lit(1.2), t / 1000)).otherwise(F.lit(0.78))


def descent(box_bottom="font_box_bottom") -> Column:
    b = _c(box_bottom)
    return F.when(b < 0, F.least(F.lit(0.5), -b / 1000)).otherwise(F.lit(0.22))


def union_box(alias: str = "") -> list[Column]:
    """Aggregates for the box around a group's boxes."""
    return [F.min("x0").alias(f"{alias}x0"), F.min("y0").alias(f"{alias}y0"), F.max("x1").alias(f"{alias}x1"), F.max("y1").alias(f"{alias}y1")]


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)

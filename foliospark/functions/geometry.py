"""Boxes and affine transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, sx=1.0, sy=1.0) -> Column:
    """Scale, clip to the page, round to 3 places; null if nothing is left. Also centre and size."""
    cut = lambda v, s, m: F.round(F.greatest(F.lit(0.0), F.least(m.cast("double"), v * s)), 3)
    a, b, c, d = cut(x0, sx, width), cut(y0, sy, height), cut(x1, sx, width), cut(y1, sy, height)
    box = F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"), F.round((a + c) / 2, 3).alias("cx"), F.round((b + d) / 2, 3).alias("cy"), F.round(c - a, 3).alias("w"), F.round(d - b, 3).alias("h"))
    return F.when((c > a) & (d > b), box)


def pixel_rectangle(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """The half-open integer rectangle that covers a box, inside the page, never negative."""
    low = lambda v, m: F.greatest(F.lit(0), F.least(m.cast("long"), F.floor(v)))
    high = lambda v, m: F.greatest(F.lit(0), F.least(m.cast("long"), F.ceil(v)))
    a, b = low(x0, width), low(y0, height)
    return F.struct(a.alias("x0"), b.alias("y0"), F.greatest(a, high(x1, width)).alias("x1"), F.greatest(b, high(y1, height)).alias("y1"))


def box_wkt(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring."""
    return F.format_string("POLYGON((%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f))", x0, y0, x1, y0, x1, y1, x0, y1, x0, y0)


def affine(a, b, c, d, e, f) -> Column:
    """x' = a x + b y + c, y' = d x + e y + f."""
    parts = [(x if isinstance(x, Column) else F.lit(x)).cast("double") for x in (a, b, c, d, e, f)]
    return F.struct(*[p.alias(n) for p, n in zip(parts, "abcdef", strict=True)])


def compose(second: Column, first: Column) -> Column:
    """The transform that applies ``first``, then ``second``."""
    s, t = (lambda n: second[n]), (lambda n: first[n])
    return affine(
        s("a") * t("a") + s("b") * t("d"), s("a") * t("b") + s("b") * t("e"), s("a") * t("c") + s("b") * t("f") + s("c"),
        s("d") * t("a") + s("e") * t("d"), s("d") * t("b") + s("e") * t("e"), s("d") * t("c") + s("e") * t("f") + s("f"),
    )


def apply(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m["a"] * x + m["b"] * y + m["c"]).alias("x"), (m["d"] * x + m["e"] * y + m["f"]).alias("y"))


def invert(m: Column) -> Column:
    """Null if the transform is singular."""
    det = m["a"] * m["e"] - m["b"] * m["d"]
    inverse = affine(m["e"] / det, -m["b"] / det, (m["b"] * m["f"] - m["e"] * m["c"]) / det, -m["d"] / det, m["a"] / det, (m["d"] * m["c"] - m["a"] * m["f"]) / det)
    return F.when(det != 0, inverse)


def placement(width: Column, height: Column, degrees: float, scale: float) -> Column:
    """The transform of a page to its rotated and scaled image, on a canvas just large enough."""
    import math

    cos, sin = round(math.cos(math.radians(degrees)), 12) * scale, round(math.sin(math.radians(degrees)), 12) * scale
    corners = [(F.lit(0.0), F.lit(0.0)), (width, F.lit(0.0)), (F.lit(0.0), height), (width, height)]
    xs, ys = [x * cos - y * sin for x, y in corners], [x * sin + y * cos for x, y in corners]
    return affine(cos, -sin, -F.least(*xs), sin, cos, -F.least(*ys))

"""Geometry: boxes are structs of top, left, bottom and right; matrices of a, b, c, d, tx and ty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(top: Column, left: Column, bottom: Column, right: Column) -> Column:
    """A box with its corners put in order; A2."""
    return F.struct(F.least(top, bottom).alias("top"), F.least(left, right).alias("left"), F.greatest(top, bottom).alias("bottom"), F.greatest(left, right).alias("right"))


def matrix(packed: Column) -> Column:
    """Six numbers separated by spaces; the identity if there are not six; C22."""
    v = F.split(F.trim(packed), r"\s+")
    names = ("a", "b", "c", "d", "tx", "ty")
    same = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    return F.struct(*(F.when(F.size(v) == 6, F.get(v, F.lit(i)).try_cast("double")).otherwise(F.lit(x)).alias(n) for i, (n, x) in enumerate(zip(names, same))))


def is_identity(m: Column) -> Column:
    """F19."""
    return (m.a == 1) & (m.b == 0) & (m.c == 0) & (m.d == 1) & (m.tx == 0) & (m.ty == 0)


def scale(m: Column) -> Column:
    """The lengths of the matrix's two rows; C22."""
    return F.struct(F.sqrt(m.a * m.a + m.b * m.b).alias("x"), F.sqrt(m.c * m.c + m.d * m.d).alias("y"))


def transformed(b: Column, m: Column) -> Column:
    """The box of two transformed corners; C20."""
    x = lambda px, py: m.a * px + m.c * py + m.tx
    y = lambda px, py: m.b * px + m.d * py + m.ty
    return box(y(b.left, b.top), x(b.left, b.top), y(b.right, b.bottom), x(b.right, b.bottom))


def inside(x: Column, y: Column, b: Column) -> Column:
    """Whether a point is in a box, edges included; F18."""
    return x.between(b.left, b.right) & y.between(b.top, b.bottom)


def fitted(width: Column, height: Column, wide: int = 1024, high: int = 768) -> Column:
    """A size brought to fit a page of the same orientation, by its limiting side; C26."""
    w, h = F.when(width >= height, F.lit(wide)).otherwise(F.lit(high)), F.when(width >= height, F.lit(high)).otherwise(F.lit(wide))
    rate = F.least(w / width, h / height, F.lit(1.0))
    return F.struct(F.floor(width * rate).alias("width"), F.floor(height * rate).alias("height"))


def capped(width: Column, height: Column, pixels: int = 3_100_000) -> Column:
    """A size scaled down so that it has at most ``pixels``; C26."""
    rate = F.least(F.sqrt(F.lit(float(pixels)) / (width * height)), F.lit(1.0))
    return F.struct(F.floor(width * rate).alias("width"), F.floor(height * rate).alias("height"))


def size_and_center(b: Column) -> Column:
    """C21."""
    return F.struct((b.right - b.left).alias("width"), (b.bottom - b.top).alias("height"), ((b.left + b.right) / 2).alias("x"), ((b.top + b.bottom) / 2).alias("y"))


def moved(b: Column, x: Column, y: Column) -> Column:
    """A box seen from an origin at ``x`` and ``y``; C21."""
    return box(b.top - y, b.left - x, b.bottom - y, b.right - x)


def on_page(b: Column, page: Column, border: Column) -> Column:
    """left and top of a box within its page, rounded, without its border; C24."""
    return F.struct((F.round(b.left - page.left) - border).alias("left"), (F.round(b.top - page.top) - border).alias("top"))


def _number(v: Column) -> Column:
    """A number without a useless fraction."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def vertex_points(vertices: Column, b: Column, stroke: Column) -> Column:
    """Points of a closed shape (structs of x and y) within its box, moved by the stroke; C37."""
    return F.array_join(F.transform(vertices, lambda v: F.concat(_number(v.x - b.left + stroke), F.lit(","), _number(v.y - b.top + stroke))), " ")


def path_points(vertices: Column, b: Column) -> Column:
    """Path of an open shape (structs of x, y and the left handle lx, ly) within its box; C37."""
    at = lambda x, y: F.concat(_number(x - b.left), F.lit(","), _number(y - b.top))
    steps = F.transform(vertices, lambda v, i: F.when(i == 0, F.concat(F.lit("M"), at(v.x, v.y))).otherwise(F.concat(F.lit("Q"), at(v.lx, v.ly), F.lit(" "), at(v.x, v.y))))
    return F.array_join(steps, " ")


def reflowable_size(own: Column, kind: Column, extent: Column) -> Column:
    """A flowing page's size with an element: shapes and groups add their extent, text none; C43."""
    return own + F.when(kind.isin("Group", "Rectangle"), extent).otherwise(0)

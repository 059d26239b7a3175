"""Column expressions for positions, sizes and colours of page elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def round_half_up(x) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(c(x) + 0.5)


def or_default(x, default) -> Column:
    """The default where x is null, zero or not a number."""
    return F.when(F.coalesce(c(x), F.lit(0.0)).isin(0.0) | F.isnan(c(x)), c(default)).otherwise(c(x))


def upper_median(values: Column) -> Column:
    """Element floor(n / 2) of the sorted array; null if it is empty."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def multiply(m: Column, n: Column) -> Column:
    """Product of affine matrices [a, b, c, d, e, f]: n is applied first."""
    at = lambda a, i: a[i]
    return F.array(
        at(m, 0) * at(n, 0) + at(m, 2) * at(n, 1),
        at(m, 1) * at(n, 0) + at(m, 3) * at(n, 1),
        at(m, 0) * at(n, 2) + at(m, 2) * at(n, 3),
        at(m, 1) * at(n, 2) + at(m, 3) * at(n, 3),
        at(m, 0) * at(n, 4) + at(m, 2) * at(n, 5) + at(m, 4),
        at(m, 1) * at(n, 4) + at(m, 3) * at(n, 5) + at(m, 5),
    )


def apply_matrix(m: Column, x, y) -> Column:
    return F.struct((m[0] * c(x) + m[2] * c(y) + m[4]).alias("x"), (m[1] * c(x) + m[3] * c(y) + m[5]).alias("y"))


def flip_y(page_height, y, height) -> Column:
    """Top-left y of a box whose y counts from the bottom."""
    return c(page_height) - c(y) - c(height)


def overlaps(a: str, b: str, tolerance: float = 0.0) -> Column:
    """Strict overlap of boxes with columns x, y, width, height under prefixes a and b."""
    g = lambda p, n: F.col(f"{p}{n}")
    return (
        (g(a, "x") < g(b, "x") + g(b, "width") + tolerance)
        & (g(a, "x") + g(a, "width") + tolerance > g(b, "x"))
        & (g(a, "y") < g(b, "y") + g(b, "height") + tolerance)
        & (g(a, "y") + g(a, "height") + tolerance > g(b, "y"))
    )


def touches(a: str, b: str, tolerance: float = 0.0) -> Column:
    """Overlap of boxes under prefixes a and b, their edges and ``tolerance`` beyond included."""
    g = lambda p, n: F.col(f"{p}{n}")
    side = lambda p, q, at, size: g(p, at) + g(p, size) + tolerance >= g(q, at)
    return side(a, b, "x", "width") & side(b, a, "x", "width") & side(a, b, "y", "height") & side(b, a, "y", "height")


def inverse_rotation(angle, width, height) -> Column:
    """Matrix that undoes a page's rotation by a multiple of 90 degrees."""
    w, h = c(width).cast("double"), c(height).cast("double")
    m = lambda *x: F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in x])
    turn = F.pmod(c(angle), F.lit(360))
    return F.when(turn == 90, m(0, -1, 1, 0, 0, w)).when(turn == 180, m(-1, 0, 0, -1, w, h)).when(turn == 270, m(0, 1, -1, 0, h, 0)).otherwise(m(1, 0, 0, 1, 0, 0))


def contains_point(box: str, x, y, tolerance: float = 0.0) -> Column:
    g = lambda n: F.col(f"{box}{n}")
    return (c(x) >= g("x") - tolerance) & (c(x) <= g("x") + g("width") + tolerance) & (c(y) >= g("y") - tolerance) & (c(y) <= g("y") + g("height") + tolerance)


def gap(a_start, a_size, b_start, b_size) -> Column:
    """Distance of two intervals, 0 if they overlap."""
    return F.greatest(F.lit(0.0), c(b_start) - (c(a_start) + c(a_size)), c(a_start) - (c(b_start) + c(b_size)))


def clamp(x, low, high) -> Column:
    return F.greatest(c(low), F.least(c(high), c(x)))


def rgb_hex(r, g, b) -> Column:
    """Six lower-case hex digits of components from 0 to 1, which are clamped."""
    part = lambda v: F.lpad(F.lower(F.hex(round_half_up(clamp(v, F.lit(0.0), F.lit(1.0)) * 255).cast("int"))), 2, "0")
    return F.concat(part(r), part(g), part(b))


def cmyk_rgb(cy, m, y, k) -> Column:
    one = lambda v: 1 - F.least(F.lit(1.0), c(v) + c(k))
    return F.struct(one(cy).alias("r"), one(m).alias("g"), one(y).alias("b"))


def normal_component(v) -> Column:
    return F.when(c(v) > 1, c(v) / 255).otherwise(c(v))


def twips(points) -> Column:
    return round_half_up(c(points) * 20).cast("long")


def emu(points) -> Column:
    return round_half_up(c(points) * 12700).cast("long")


def fit_within(width, height, most) -> Column:
    """Width and height scaled down to a longest side."""
    w1 = F.least(c(width), c(most))
    h1 = F.when(c(width) > c(most), c(height) * c(most) / c(width)).otherwise(c(height))
    return F.struct(F.when(h1 > c(most), w1 * c(most) / h1).otherwise(w1).alias("width"), F.least(h1, c(most)).alias("height"))

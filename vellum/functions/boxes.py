"""Boxes in pictures as structs (x0, y0, x1, y1): units, clamping, crops, overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coordinates up to here are shares of the picture; thousandths reach so far; sides up to here are near thousandths.
SHARE, THOUSANDTHS, NEAR = 1.5, 1020, 1100


def _corners(b: Column) -> list[Column]:
    return [b[c].cast("double") for c in ("x0", "y0", "x1", "y1")]


def finite(b: Column) -> Column:
    return F.coalesce(b.isNotNull() & ~F.greatest(*[F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull() for c in _corners(b)]), F.lit(False))


def in_shares(b: Column) -> Column:
    """True if all coordinates look like shares of the picture."""
    return F.greatest(*[F.abs(c) for c in _corners(b)]) <= SHARE


def normal(b: Column, width: Column, height: Column, sx: Column | float = 1.0, sy: Column | float = 1.0) -> Column:
    """The box in whole pixels with ordered corners inside the picture; null if it is not finite or less than two pixels wide or high."""
    share = in_shares(b)
    fx, fy = F.when(share, width.cast("double")).otherwise(F.lit(sx) if isinstance(sx, float) else sx), F.when(share, height.cast("double")).otherwise(F.lit(sy) if isinstance(sy, float) else sy)
    x0, y0, x1, y1 = _corners(b)
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    left, right = inside(F.least(x0 * fx, x1 * fx), width), inside(F.greatest(x0 * fx, x1 * fx), width)
    top, bottom = inside(F.least(y0 * fy, y1 * fy), height), inside(F.greatest(y0 * fy, y1 * fy), height)
    whole = [F.floor(v + 0.5).cast("int").alias(n) for v, n in ((left, "x0"), (top, "y0"), (right, "x1"), (bottom, "y1"))]
    return F.when(finite(b) & (width > 0) & (height > 0) & (right - left >= 2) & (bottom - top >= 2), F.struct(*whole))


def unit_scale(most_x: Column, most_y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Factors of an answer asked for in thousandths, by its greatest coordinates: pixels where these exceed a thousand, on the other axis too if the side is near it."""
    px, py = most_x > THOUSANDTHS, most_y > THOUSANDTHS
    return F.when(px | (py & (width <= NEAR)), 1.0).otherwise(width / 1000), F.when(py | (px & (height <= NEAR)), 1.0).otherwise(height / 1000)


def crop(b: Column, width: Column, height: Column, expand: float, least: int) -> Column:
    """struct(left, top, width, height) of a box widened on each side by a share of its size and cut at the picture; null below ``least`` pixels."""
    x0, y0, x1, y1 = _corners(b)
    dx, dy = (x1 - x0) * max(-0.49, expand), (y1 - y0) * max(-0.49, expand)
    left, top = F.greatest(F.lit(0), F.floor(x0 - dx)), F.greatest(F.lit(0), F.floor(y0 - dy))
    w, h = F.least(width, F.ceil(x1 + dx)) - left, F.least(height, F.ceil(y1 + dy)) - top
    good = finite(b) & (x1 - x0 >= least) & (y1 - y0 >= least) & (w >= least) & (h >= least)
    return F.when(good, F.struct(*[v.cast("int").alias(n) for v, n in ((left, "left"), (top, "top"), (w, "width"), (h, "height"))]))


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share, of the area of both together; 0 if they do not meet."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0)).cast("double")
    area = lambda x: ((x["x1"] - x["x0"]) * (x["y1"] - x["y0"])).cast("double")
    both = side("x0", "x1") * side("y0", "y1")
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def off_edges(y0: Column, y1: Column, height: Column, share: float = 0.02) -> Column:
    """True for a band that does not cling to the upper or lower edge."""
    return (y1 > height * share) & (y0 < height * (1 - share))

"""Box arithmetic as Column expressions (corner form unless stated)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def sides(prefix: str = "") -> list[Column]:
    return [F.col(prefix + s) for s in SIDES]


def area(b: list[Column]) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def clipped_area(b: list[Column]) -> Column:
    return F.greatest(F.lit(0.0), area(b))


def intersection(a: list[Column], b: list[Column]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def union_area(a: list[Column], b: list[Column]) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; 0 for touching boxes and for an empty union."""
    union = union_area(a, b)
    return F.when(union <= 0, F.lit(0.0)).otherwise(F.try_divide(intersection(a, b), union))


def giou(a: list[Column], b: list[Column]) -> Column:
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (
        F.greatest(a[3], b[3]) - F.least(a[1], b[1])
    )
    return iou(a, b) - F.coalesce(F.try_divide(hull - union_area(a, b), hull), F.lit(0.0))


def contains(outer: list[Column], inner: list[Column]) -> Column:
    return (
        (outer[0] <= inner[0])
        & (outer[1] <= inner[1])
        & (outer[2] >= inner[2])
        & (outer[3] >= inner[3])
    )


def strictly_contains(outer: list[Column], inner: list[Column]) -> Column:
    """``outer`` covers ``inner`` and is not the same box."""
    same = reduce(lambda p, q: p & q, [o == i for o, i in zip(outer, inner)])
    return contains(outer, inner) & ~same


def overlap_of_own(a: list[Column], b: list[Column]) -> Column:
    """Intersection over the first box's own area."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a)), F.lit(0.0))


def center(b: list[Column]) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def valid(box: Column) -> Column:
    """Four finite numbers with positive width and height."""
    finite = F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    shape = F.size(box) == 4
    return F.coalesce(
        F.when(shape & finite, (box[2] > box[0]) & (box[3] > box[1])), F.lit(False)
    )


def to_xywh(b):
    return [b[0], b[1], b[2] - b[0], b[3] - b[1]]


def to_cxcywh(b):
    return [(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]]


def from_cxcywh(c):
    return [c[0] - c[2] / 2, c[1] - c[3] / 2, c[0] + c[2] / 2, c[1] + c[3] / 2]


def from_xywh(c):
    return [c[0], c[1], c[0] + c[2], c[1] + c[3]]


def affine_clipped(b, matrix, width: float, height: float):
    """Axis-aligned cover of the box's four mapped corners, clipped to the grid.

    A side that collapses after clipping is widened to one pixel inside the grid.
    """
    (a, c, tx), (d, e, ty) = matrix
    corners = [(b[0], b[1]), (b[2], b[1]), (b[0], b[3]), (b[2], b[3])]
    xs = [a * x + c * y + tx for x, y in corners]
    ys = [d * x + e * y + ty for x, y in corners]

    def span(values, size):
        lo = F.least(F.greatest(F.least(*values), F.lit(0.0)), F.lit(float(size)))
        hi = F.least(F.greatest(F.greatest(*values), F.lit(0.0)), F.lit(float(size)))
        flat = hi <= lo
        start = F.when(flat & (lo >= float(size)), F.lit(float(size) - 1)).otherwise(lo)
        return start, F.when(flat, F.least(start + 1, F.lit(float(size)))).otherwise(hi)

    x1, x2 = span(xs, width)
    y1, y2 = span(ys, height)
    return [x1, y1, x2, y2]

"""Image size rules and point budgets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patch edge of the resize rules and the default longest side.
PATCH = 14
LONGEST = 504


def floored_size(width: Column, height: Column, longest: int = LONGEST) -> tuple[Column, Column]:
    """Shrink to the longest side and floor both sides to whole patches; small images stay."""
    limit = longest // PATCH * PATCH
    longer = F.greatest(width, height)
    scale = F.lit(float(limit)) / longer
    shrink = lambda side: F.when(longer <= limit, side.cast("long")).otherwise(
        (F.floor(side * scale / PATCH) * PATCH).cast("long")
    )
    return shrink(width), shrink(height)


def nearest_patch(value: Column) -> Column:
    """Nearest patch multiple; the upper one wins a tie."""
    down = F.floor(value / PATCH) * PATCH
    up = down + PATCH
    return F.greatest(F.lit(1), F.when(up - value <= value - down, up).otherwise(down)).cast("long")


def pixel_centre_affine(source: Column, target: Column) -> tuple[Column, Column]:
    """Scale and shift that map source pixel centres to target pixel centres."""
    scale = target / source
    return scale, (scale - 1) / 2


def point_budget(area: Column, most: int) -> Column:
    """Points to draw from a region: twice the side of its square, at least 5."""
    return F.greatest(F.lit(5), F.least(F.floor(F.sqrt(area) * 2), F.lit(most))).cast("long")


def centre_weight(dx: Column, dy: Column, sigma: float, cut: float) -> Column:
    """Gaussian weight of box-normalized offsets, zero beyond ``sigma * cut``."""
    d2 = dx * dx + dy * dy
    return F.when(F.sqrt(d2) <= sigma * cut, F.exp(-d2 / (2 * sigma * sigma))).otherwise(F.lit(0.0))

"""Boxes as four integer columns (x0, y0, x1, y1): FN20-FN22."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tile size, stride and canvas of the 5 x 3 grid, and the positive share of the region.
TILE, STRIDE, CANVAS = 256, 192, (1024, 640)
POSITIVE_SHARE = 0.25


def area(x0, y0, x1, y1) -> Column:
    return F.greatest(F.lit(0), x1 - x0) * F.greatest(F.lit(0), y1 - y0)


def intersection(a, b):
    """Overlap box of two boxes; may be empty (negative extent)."""
    return (F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def union_box(a, b):
    """Smallest box around two boxes."""
    return (F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def pad_clamp(box, pad, width, height):
    x0, y0, x1, y1 = box
    return (F.greatest(F.lit(0), x0 - pad), F.greatest(F.lit(0), y0 - pad),
            F.least(width, x1 + pad), F.least(height, y1 + pad))


def scale_box(box, factor, dx, dy):
    """Scales outwards (floor for the near corner, ceil for the far one), then shifts."""
    x0, y0, x1, y1 = box
    low = lambda v: F.floor(v * factor).cast("int")
    high = lambda v: F.ceil(v * factor).cast("int")
    return (low(x0) + dx, low(y0) + dy, high(x1) + dx, high(y1) + dy)


def map_box(h: list[Column], box, width, height):
    """FN21. Axis-aligned box around a box's corners under a 3x3 homography, clamped to the image."""
    x0, y0, x1, y1 = box
    xs, ys = [], []
    for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)):
        w = h[6] * x + h[7] * y + h[8]
        xs.append((h[0] * x + h[1] * y + h[2]) / w)
        ys.append((h[3] * x + h[4] * y + h[5]) / w)
    return (
        F.greatest(F.lit(0), F.floor(F.least(*xs)).cast("int")),
        F.greatest(F.lit(0), F.floor(F.least(*ys)).cast("int")),
        F.least(width, F.ceil(F.greatest(*xs)).cast("int")),
        F.least(height, F.ceil(F.greatest(*ys)).cast("int")),
    )


def tile_count() -> tuple[int, int]:
    return (CANVAS[0] - TILE) // STRIDE + 1, (CANVAS[1] - TILE) // STRIDE + 1


def tile_label(region, tile_x, tile_y) -> Column:
    """FN22. 1 if the tile holds at least a quarter of the region, -1 if it touches it, else 0.

    A missing region gives 0; an empty region raises, since no label would be right.
    """
    whole = area(*region)
    part = area(*intersection(region, (tile_x, tile_y, tile_x + TILE, tile_y + TILE)))
    return (
        F.when(region[0].isNull(), 0)
        .when(whole <= 0, F.raise_error(F.lit("empty region")).cast("int"))
        .when(part >= POSITIVE_SHARE * whole, 1)
        .when(part > 0, -1)
        .otherwise(0)
    )

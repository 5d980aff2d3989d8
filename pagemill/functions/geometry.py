"""Boxes: array<double> of x1, y1, x2, y2 as shares of the page unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_bbox(bbox: Column, source_type: Column, width: Column, height: Column, digits: int | None = 6) -> Column:
    """Box as shares of the page: kept if all parts are in [-0.001, 1.001], else divided by the page size.

    Slides give x, y, width, height, other sources two corners. Corners are put in order and clamped; without
    four parts, or without a page size where it is needed, null.
    """
    unit = F.forall(bbox, lambda v: v.between(-0.001, 1.001))
    corners = F.when(unit | (source_type != "pptx"), bbox).otherwise(F.array(bbox[0], bbox[1], bbox[0] + bbox[2], bbox[1] + bbox[3]))
    scale = F.array(width, height, width, height)
    scaled = F.when(unit, corners).when((width > 0) & (height > 0), F.zip_with(corners, scale, lambda v, s: v / s))
    x1, x2 = F.least(scaled[0], scaled[2]), F.greatest(scaled[0], scaled[2])
    y1, y2 = F.least(scaled[1], scaled[3]), F.greatest(scaled[1], scaled[3])
    box = F.transform(F.array(x1, y1, x2, y2), lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    if digits is not None:
        box = F.transform(box, lambda v: F.round(v, digits))
    return F.when((F.size(bbox) == 4) & scaled.isNotNull(), box)


def round_scaled(c: Column, digits: int) -> Column:
    """The nearest multiple of 10^-digits, halves away from zero, as SQL engines round doubles: scaled, rounded, scaled back.

    Spark's round takes the shortest decimal of the double itself, which differs where the scaled product is a half.
    """
    return F.round(c * float(10**digits), 0) / float(10**digits)


def bbox_format(bbox: Column, source_type: Column) -> Column:
    return F.when(bbox.isNull(), F.lit("none")).when(source_type == "pptx", F.lit("xywh")).otherwise(F.lit("xyxy"))


def layout_order(bbox: Column, missing: float | None = 9999.0) -> Column:
    """y1 * 1000 + x1, four digits."""
    order = F.round(bbox[1] * 1000 + bbox[0], 4)
    return order if missing is None else F.coalesce(order, F.lit(missing))


def bbox_area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def sum_of_areas(c: Column) -> Column:
    """The sum of doubles from 0 to 1, alike in any order: the exact sum of their bits down to 2^-90, rounded once.

    So one value gives itself and two give their sum as doubles, which hasn't an order either. A value goes in three
    whole numbers of 30 bits; those add up exactly.
    """
    unit, total, rest = float(1 << 30), F.lit(0).cast("decimal(38,0)"), c
    for i in range(3):
        scaled = rest * unit
        whole, rest = scaled.cast("bigint"), scaled - F.floor(scaled)
        total = total + (F.sum(whole).cast("decimal(20,0)") * F.lit(1 << 60 - 30 * i).cast("decimal(19,0)")).cast("decimal(38,0)")
    return total.cast("double") / float(1 << 90)


def bbox_union(a: Column, b: Column) -> Column:
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, bbox_area(a) + bbox_area(b) - both), F.lit(0.0))


def overlap_ratio(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Common length of two spans over the shorter one."""
    common = F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))
    return F.coalesce(F.try_divide(common, F.least(a2 - a1, b2 - b1)), F.lit(0.0))


def horizontal_overlap(a: Column, b: Column) -> Column:
    return overlap_ratio(a[0], a[2], b[0], b[2])


def vertical_overlap(a: Column, b: Column) -> Column:
    return overlap_ratio(a[1], a[3], b[1], b[3])


def center_inside(a: Column, b: Column) -> Column:
    return ((a[0] + a[2]) / 2).between(b[0], b[2]) & ((a[1] + a[3]) / 2).between(b[1], b[3])


def expand(b: Column, margin: float) -> Column:
    return F.array(F.greatest(F.lit(0.0), b[0] - margin), F.greatest(F.lit(0.0), b[1] - margin), F.least(F.lit(1.0), b[2] + margin), F.least(F.lit(1.0), b[3] + margin))


def is_template_box(b: Column) -> Column:
    """Up to 0.018 of the page in a corner, or up to 0.01 of it at an edge."""
    edge = (b[0] <= 0.08) | (b[1] <= 0.08) | (b[2] >= 0.92) | (b[3] >= 0.92)
    corner = ((b[0] <= 0.12) | (b[2] >= 0.88)) & ((b[1] <= 0.12) | (b[3] >= 0.88))
    return ((bbox_area(b) <= 0.018) & corner) | ((bbox_area(b) <= 0.01) & edge)

"""Boxes in a page space of 0 to 1000."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_area(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    return w * h


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Intersection over union, 0 for empty boxes."""
    both = overlap_area(a, b)
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(both.cast("double"), (area(a) + area(b) - both).cast("double")), F.lit(0.0))


def center(box: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2


def inside(box: tuple[Column, Column, Column, Column], region: tuple[Column, Column, Column, Column]) -> Column:
    """Is the centre of a box inside a region, borders included?"""
    x, y = center(box)
    return x.between(region[0], region[2]) & y.between(region[1], region[3])


def centre_size(box: tuple[Column, Column, Column, Column], width: Column, height: Column) -> list[Column]:
    """cx, cy, w, h as shares of the page, clamped to 0..1 and rounded to six places."""
    clamp = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 6)
    return [clamp((box[0] + box[2]) / 2.0 / width), clamp((box[1] + box[3]) / 2.0 / height), clamp((box[2] - box[0]) / width), clamp((box[3] - box[1]) / height)]

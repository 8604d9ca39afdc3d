"""Boxes of page elements as struct<x1, y1, x2, y2: double>, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def from_points(points: Column) -> Column:
    """Box of the first and third of at least four corner points; corners in the wrong order are swapped."""
    a, b = F.get(points, F.lit(0)), F.get(points, F.lit(2))
    x1, y1, x2, y2 = F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1))
    return F.when(F.size(points) >= 4, box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)))


def _clamped(value: Column, scale: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / scale))


def normalized(given: Column, coordinates: Column, layout: Column, page_width: Column, page_height: Column) -> Column:
    """``given`` as it is; else the coordinates by the layout's size, or else by the page's, clamped and put in order."""
    return scaled(given, coordinates, *scales(layout, page_width, page_height))


def scales(layout: Column, page_width: Column, page_height: Column) -> tuple[Column, Column]:
    """Width and height to divide coordinates by: the layout's, or else the page's; null without both above 0."""
    own = (layout["w"] > 0) & (layout["h"] > 0)
    w, h = F.when(own, layout["w"]).otherwise(page_width), F.when(own, layout["h"]).otherwise(page_height)
    sized = (w > 0) & (h > 0)
    return F.when(sized, w), F.when(sized, h)


def scaled(given: Column, coordinates: Column, w: Column, h: Column) -> Column:
    """``normalized`` by known ``scales``, which are best columns of their own: code of more than 8,000 bytes is not compiled."""
    full = given.isNotNull() & given["x1"].isNotNull() & given["y1"].isNotNull() & given["x2"].isNotNull() & given["y2"].isNotNull()
    x1, x2 = (_clamped(pick(coordinates["x1"], coordinates["x2"]), w) for pick in (F.least, F.greatest))
    y1, y2 = (_clamped(pick(coordinates["y1"], coordinates["y2"]), h) for pick in (F.least, F.greatest))
    there = coordinates["x1"].isNotNull() & coordinates["y1"].isNotNull() & coordinates["x2"].isNotNull() & coordinates["y2"].isNotNull()
    return F.when(full, given).when(w.isNotNull() & h.isNotNull() & there, box(x1, y1, x2, y2))


def absolute(normal: Column, width: Column, height: Column) -> Column:
    return F.when(normal.isNotNull(), box(normal["x1"] * width, normal["y1"] * height, normal["x2"] * width, normal["y2"] * height))


def union(boxes: Column) -> Column:
    """Aggregate: the least box around all; nulls are passed over."""
    around = box(F.min(boxes["x1"]), F.min(boxes["y1"]), F.max(boxes["x2"]), F.max(boxes["y2"]))
    return F.when(F.count(boxes) > 0, around)


def area(b: Column) -> Column:
    return F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def inside(b: Column, width: Column, height: Column, tolerance: float = 2.0) -> Column:
    return (b["x1"] >= -tolerance) & (b["y1"] >= -tolerance) & (b["x2"] <= width + tolerance) & (b["y2"] <= height + tolerance)

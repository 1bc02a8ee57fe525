"""Plane geometry as Column expressions: points are struct<x,y>, boxes struct<x0,y0,x1,y1>, polylines array of points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[v.cast("double").alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def center(b: Column) -> Column:
    return point((b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2)


def dist(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def near_box(p: Column, b: Column, tolerance: float = 0.0) -> Column:
    """The point lies in the box widened by the tolerance, edges included."""
    t = F.lit(float(tolerance))
    return p["x"].between(b["x0"] - t, b["x1"] + t) & p["y"].between(b["y0"] - t, b["y1"] + t)


def segment_dist(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from a segment; from its one point if it has no length."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    share = ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / square
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    return F.hypot(p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy))


def legs(polyline: Column) -> Column:
    """Consecutive vertex pairs with their place: array<struct<i,a,b>>."""
    n = F.size(polyline)
    zipped = F.zip_with(F.slice(polyline, F.lit(1), n - 1), F.slice(polyline, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(zipped, lambda leg, i: F.struct(i.alias("i"), leg["a"].alias("a"), leg["b"].alias("b")))


def polyline_dist(p: Column, polyline: Column) -> Column:
    return F.array_min(F.transform(legs(polyline), lambda g: segment_dist(p, g["a"], g["b"])))


def nearest_leg(p: Column, polyline: Column) -> Column:
    """The first of the nearest legs."""
    return F.array_min(F.transform(legs(polyline), lambda g: F.struct(segment_dist(p, g["a"], g["b"]).alias("d"), g["i"].alias("i"), g["a"].alias("a"), g["b"].alias("b"))))


def length(polyline: Column) -> Column:
    return F.aggregate(legs(polyline), F.lit(0.0), lambda s, g: s + dist(g["a"], g["b"]))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if they do not meet."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller box."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def hull(points: Column) -> Column:
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def corners(b: Column) -> Column:
    return F.array(point(b["x0"], b["y0"]), point(b["x1"], b["y0"]), point(b["x1"], b["y1"]), point(b["x0"], b["y1"]))


def rotated(p: Column, degrees: Column, about: Column) -> Column:
    """Turned about a point; positive angles turn x towards y."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    dx, dy = p["x"] - about["x"], p["y"] - about["y"]
    return point(about["x"] + dx * c - dy * s, about["y"] + dx * s + dy * c)


def scaled(p: Column, factor: Column) -> Column:
    return point(p["x"] * factor, p["y"] * factor)


def to_normalized(p: Column, norm: Column) -> Column:
    """Original to normalized frame: deskewed about the original sheet's centre, then scaled.

    norm: struct with angle_degrees, scale, original_size array<int>.
    """
    middle = point(norm["original_size"][0] / 2, norm["original_size"][1] / 2)
    return scaled(rotated(p, -norm["angle_degrees"], middle), norm["scale"])


def to_original(p: Column, norm: Column) -> Column:
    middle = point(norm["original_size"][0] / 2, norm["original_size"][1] / 2)
    return rotated(scaled(p, 1 / norm["scale"]), norm["angle_degrees"], middle)


def mapped_box(b: Column, mapper) -> Column:
    return hull(F.transform(corners(b), mapper))


def clipped(b: Column, width: Column, height: Column) -> Column:
    """The part of the box on the canvas; null if there is none."""
    c = box(F.greatest(b["x0"], F.lit(0.0)), F.greatest(b["y0"], F.lit(0.0)), F.least(b["x1"], width.cast("double")), F.least(b["y1"], height.cast("double")))
    return F.when((c["x0"] < c["x1"]) & (c["y0"] < c["y1"]), c)


def visible(polyline: Column, width: Column, height: Column) -> Column:
    """The polyline's extent overlaps the canvas."""
    h = hull(polyline)
    return (h["x1"] > 0) & (h["x0"] < width) & (h["y1"] > 0) & (h["y0"] < height)


def unrotated_box(b: Column, width: Column, height: Column, angle: Column) -> Column:
    """A box read on a sheet turned by a quarter turn, in the sheet's own frame (width, height: of the unturned sheet)."""
    by90 = box(b["y0"], height - b["x1"], b["y1"], height - b["x0"])
    by180 = box(width - b["x1"], height - b["y1"], width - b["x0"], height - b["y0"])
    by270 = box(width - b["y1"], b["x0"], width - b["y0"], b["x1"])
    return F.when(angle == 90, by90).when(angle == 180, by180).when(angle == 270, by270).otherwise(b)


def unit(v: Column) -> Column:
    """The vector at length 1; null for none or a zero vector."""
    n = F.hypot(v["x"], v["y"])
    return F.when(n > 0, point(v["x"] / n, v["y"] / n))


def sector(u: Column) -> Column:
    """One of eight directions, half-even at the borders."""
    return F.pmod(F.bround(F.atan2(u["y"], u["x"]) / F.lit(math.pi / 4)), F.lit(8)).cast("int")


def trimmed_box(x: Column, y: Column, width: Column, height: Column, ring: int = 2) -> Column:
    """A window without its ring of context."""
    r = F.lit(ring)
    return box(x + r, y + r, x + width - r, y + height - r)

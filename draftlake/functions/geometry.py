"""Geometry columns: tolerances, boxes, segments, arcs. All plain arithmetic inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def within_tol(a: Column, b: Column, rel: float, absolute: float) -> Column:
    """abs(a - b) <= max(rel * abs(b), absolute)."""
    return F.abs(a - b) <= F.greatest(rel * F.abs(b), F.lit(float(absolute)))


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def box_intersection(a, b) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(a) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def box_iou(a, b) -> Column:
    inter = box_intersection(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when((inter <= 0) | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def box_share(inner, outer) -> Column:
    """Share of ``inner`` that lies inside ``outer``."""
    return box_intersection(inner, outer) / F.greatest(box_area(inner), F.lit(1e-9))


def centre_distance(a, b) -> Column:
    return hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)


def box_distance(x: Column, y: Column, box) -> Column:
    """Zero inside, else the gap from a point to the nearest edge."""
    dx = F.greatest(box[0] - x, x - box[2], F.lit(0.0))
    dy = F.greatest(box[1] - y, y - box[3], F.lit(0.0))
    return hypot(dx, dy)


def seg_dist(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a point to a segment; a zero-length segment is its point."""
    dx, dy = x1 - x0, y1 - y0
    sq = dx * dx + dy * dy
    t = F.when(sq == 0, F.lit(0.0)).otherwise(
        F.least(F.greatest(F.try_divide((px - x0) * dx + (py - y0) * dy, sq), F.lit(0.0)), F.lit(1.0)))
    return hypot(x0 + t * dx - px, y0 + t * dy - py)


def polyline_dist(px: Column, py: Column, points: Column) -> Column:
    """Smallest segment distance over an ARRAY<ARRAY<DOUBLE>> polyline."""
    legs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1),
                      lambda a, b: seg_dist(px, py, a[0], a[1], b[0], b[1]))
    return F.array_min(legs)


def segments_meet(a, b) -> Column:
    """STRUCT<x, y> where two finite segments (x0, y0, x1, y1) meet, NULL if parallel or apart."""
    den = (a[0] - a[2]) * (b[1] - b[3]) - (a[1] - a[3]) * (b[0] - b[2])
    t = F.try_divide((a[0] - b[0]) * (b[1] - b[3]) - (a[1] - b[1]) * (b[0] - b[2]), den)
    u = F.try_divide((a[0] - b[0]) * (a[1] - a[3]) - (a[1] - b[1]) * (a[0] - a[2]), den)
    ok = (F.abs(den) >= 1e-12) & t.between(-1e-9, 1 + 1e-9) & u.between(-1e-9, 1 + 1e-9)
    tc = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.when(ok, F.struct((a[0] + tc * (a[2] - a[0])).alias("x"), (a[1] + tc * (a[3] - a[1])).alias("y")))


def on_interior(px: Column, py: Column, seg, tol: float) -> Column:
    """Is the point on the segment's interior, ``tol`` away from both ends?"""
    dx, dy = seg[2] - seg[0], seg[3] - seg[1]
    length = hypot(dx, dy)
    along = F.try_divide((px - seg[0]) * dx + (py - seg[1]) * dy, length)
    off = F.try_divide(F.abs((px - seg[0]) * dy - (py - seg[1]) * dx), length)
    return F.coalesce((length >= 1e-9) & (along > tol) & (along < length - tol) & (off <= tol), F.lit(False))


def arc_span(a: Column, b: Column) -> tuple[Column, Column]:
    """Start angle and signed sweep in page radians from drawn degrees."""
    return F.radians(-a), F.radians(-(b - a))


def arc_intervals(phi: Column, sweep: Column) -> Column:
    """ARRAY<STRUCT<lo, hi>> of one or two intervals on [0, 2 pi)."""
    start = F.pmod(F.when(sweep < 0, phi + sweep).otherwise(phi), F.lit(TWO_PI))
    end = start + F.abs(sweep)
    piece = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    zero, full = F.lit(0.0), F.lit(TWO_PI)
    return (
        F.when(F.abs(sweep) >= TWO_PI, F.array(piece(zero, full)))
        .when(end <= TWO_PI, F.array(piece(start, end)))
        .otherwise(F.array(piece(start, full), piece(zero, end - TWO_PI)))
    )


def arc_overlap(phi_a: Column, sweep_a: Column, phi_b: Column, sweep_b: Column) -> Column:
    """Length of the intersection of two angular spans, in radians."""
    pairs = F.flatten(F.transform(arc_intervals(phi_a, sweep_a), lambda p: F.transform(
        arc_intervals(phi_b, sweep_b),
        lambda q: F.greatest(F.least(p["hi"], q["hi"]) - F.greatest(p["lo"], q["lo"]), F.lit(0.0)))))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def geometry_bbox(points: Column, edges: Column, circles: Column) -> Column:
    """STRUCT<x0, y0, x1, y1> over points ARRAY<ARRAY<DOUBLE>>, edges ARRAY<STRUCT<start, end, center, radius>>
    and circles ARRAY<STRUCT<center, radius>>; NULL when there is nothing."""
    empty = F.array().cast("array<array<double>>")
    ring = lambda c: F.when(c["center"].isNotNull() & (c["radius"] != 0), F.array(
        F.transform(c["center"], lambda v: v - c["radius"]), F.transform(c["center"], lambda v: v + c["radius"]))).otherwise(empty)
    ends = F.flatten(F.transform(edges, lambda e: F.concat(F.array_compact(F.array(e["start"], e["end"])), ring(e))))
    discs = F.flatten(F.transform(circles, ring))
    every = F.concat(F.coalesce(points, empty), F.coalesce(ends, empty), F.coalesce(discs, empty))
    xs, ys = F.transform(every, lambda p: p[0]), F.transform(every, lambda p: p[1])
    return F.when(F.size(every) > 0, F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))

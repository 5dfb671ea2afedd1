"""Plane geometry as column expressions; points are structs (x, y), rings are arrays of points without the first repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Direction without sense: degrees from 0 up to 180."""
    return F.pmod(F.degrees(F.atan2(y1 - y0, x1 - x0)), F.lit(180.0))


def angle_difference(a: Column, b: Column) -> Column:
    """Between two directions without sense: 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def point_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """(t, d): place of the nearest point on the segment, from 0 to 1, and its distance. A segment of no length is a point."""
    dx, dy = x1 - x0, y1 - y0
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.struct(t.alias("t"), length(px, py, x0 + t * dx, y0 + t * dy).alias("d"))


def collinear(a: tuple[Column, ...], b: tuple[Column, ...], degrees: float, offset: float) -> Column:
    """Whether two segments point the same way and the middle of b lies near the line of a."""
    ax, ay = a[2] - a[0], a[3] - a[1]
    mx, my = (b[0] + b[2]) / 2 - a[0], (b[1] + b[3]) / 2 - a[1]
    off = F.abs(F.try_divide(ax * my - ay * mx, F.sqrt(ax * ax + ay * ay)))
    return (angle_difference(angle(*a), angle(*b)) <= degrees) & (F.coalesce(off, F.lit(0.0)) <= offset)


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Closed boxes (x0, y0, x1, y1)."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def in_box(x: Column, y: Column, box: tuple[Column, ...]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def _edges(ring: Column, closed: bool) -> Column:
    """Array of (p, q) of consecutive points."""
    n = F.size(ring)
    ahead = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)) if closed else F.slice(ring, 2, F.greatest(n - 1, F.lit(0)))
    return F.filter(F.zip_with(ring, ahead, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda e: e["p"].isNotNull() & e["q"].isNotNull())


def _total(edges: Column, of) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + of(e["p"], e["q"]))


def polyline_length(points: Column, closed: bool = False) -> Column:
    return _total(_edges(points, closed), lambda p, q: length(p["x"], p["y"], q["x"], q["y"]))


def signed_area(ring: Column) -> Column:
    """By the shoelace rule; positive for rings that turn left."""
    return _total(_edges(ring, True), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]) / 2


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray cast; a point on an edge is inside."""
    edges = _edges(ring, True)
    cross = lambda p, q: (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
    within = lambda p, q: x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
    on = F.exists(edges, lambda e: (F.abs(cross(e["p"], e["q"])) < 1e-9) & within(e["p"], e["q"]))
    hits = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]))
    return on | (F.size(F.filter(edges, lambda e: hits(e["p"], e["q"]))) % 2 == 1)


def area_with_holes(ring: Column, holes: Column) -> Column:
    """Area less that of the holes whose first point lies in the ring; never below zero."""
    inside = F.filter(holes, lambda h: point_in_ring(h[0]["x"], h[0]["y"], ring))
    return F.greatest(F.abs(signed_area(ring)) - F.aggregate(inside, F.lit(0.0), lambda s, h: s + F.abs(signed_area(h))), F.lit(0.0))


def centroid(ring: Column) -> Column:
    """Of the area; of the points where there is none."""
    a = signed_area(ring)
    part = lambda c: _total(_edges(ring, True), lambda p, q: (p[c] + q[c]) * (p["x"] * q["y"] - q["x"] * p["y"])) / (6 * a)
    mean = lambda c: F.try_divide(F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]), F.size(ring))
    flat = F.abs(a) < 1e-12
    return F.struct(F.when(flat, mean("x")).otherwise(part("x")).alias("x"), F.when(flat, mean("y")).otherwise(part("y")).alias("y"))


def vertex_angle(ax: Column, ay: Column, vx: Column, vy: Column, bx: Column, by: Column) -> Column:
    """Degrees from 0 to 180 at v between a and b; null if an arm has no length."""
    dot = (ax - vx) * (bx - vx) + (ay - vy) * (by - vy)
    cos = F.try_divide(dot, length(vx, vy, ax, ay) * length(vx, vy, bx, by))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def clip(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[Column, ...]) -> Column:
    """(t0, t1) of the part of the segment within the box, after Liang and Barsky; null if there is none."""
    dx, dy = x1 - x0, y1 - y0
    sides = [(-dx, x0 - box[0]), (dx, box[2] - x0), (-dy, y0 - box[1]), (dy, box[3] - y0)]
    t0 = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p) for p, q in sides])
    t1 = F.least(F.lit(1.0), *[F.when(p > 0, q / p) for p, q in sides])
    outside = F.lit(False)
    for p, q in sides:
        outside = outside | ((p == 0) & (q < 0))
    return F.when(~outside & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def flatten_bezier(points: list[tuple[Column, Column]], pieces: int = 8) -> Column:
    """Points of a cubic curve at equal steps of its parameter."""
    at = F.transform(F.sequence(F.lit(0), F.lit(pieces)), lambda i: i / F.lit(float(pieces)))
    b = lambda t, k: points[0][k] * (1 - t) ** 3 + points[1][k] * 3 * t * (1 - t) ** 2 + points[2][k] * 3 * t * t * (1 - t) + points[3][k] * t**3
    return F.transform(at, lambda t: F.struct(b(t, 0).alias("x"), b(t, 1).alias("y")))


#: Millimetres in a unit of length.
UNIT_MM = {"mm": 1.0, "cm": 10.0, "dm": 100.0, "m": 1000.0, "km": 1_000_000.0, "in": 25.4, "ft": 304.8, "yd": 914.4}


def convert(value: Column, source: Column, target: Column, power: int = 1) -> Column:
    """Between units of length, area or volume; null for an unknown unit."""
    mm = F.create_map(*[F.lit(x) for pair in UNIT_MM.items() for x in pair])
    return value * F.pow(F.try_divide(F.try_element_at(mm, source), F.try_element_at(mm, target)), F.lit(power))

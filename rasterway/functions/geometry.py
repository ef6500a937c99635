"""Plane geometry as column expressions, on rings and lines given as arrays of (x, y) structs.

A shape of several parts (polygons with holes, multi-polygons, multi-lines) is one array
with a null between two parts; outer rings run against the clock, holes with it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def joined(parts: Column) -> Column:
    """One array of the points of all parts, with a null between two parts."""
    gap = F.array(F.lit(None).cast("struct<x:double,y:double>"))
    return F.when(F.size(parts) > 0, F.flatten(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(gap, p)).otherwise(p))))


def parts(points: Column) -> Column:
    """The parts of a shape, each an array of points."""
    gaps = F.filter(F.sequence(F.lit(1), F.greatest(F.size(points), F.lit(1))), lambda i: F.get(points, i - 1).isNull())
    first, last = F.concat(F.array(F.lit(0)), gaps), F.concat(gaps, F.array(F.size(points) + 1))
    cuts = F.arrays_zip(first.alias("a"), last.alias("b"))
    return F.filter(F.transform(cuts, lambda c: F.slice(points, c["a"] + 1, c["b"] - c["a"] - 1)), lambda p: F.size(p) > 0)


def turned(ring: Column, hole: Column) -> Column:
    """A ring against the clock, or with it for a hole."""
    return F.when((signed_area(ring) < 0) != hole, F.reverse(ring)).otherwise(ring)


def parse_wkt(text: Column) -> Column:
    """Points of a POINT, LINESTRING, POLYGON or a MULTI of them; several parts are parted by nulls."""
    xy = lambda t: F.split(F.trim(t), r"\s+")
    points = lambda body: F.transform(F.split(body, ","), lambda t: F.struct(xy(t)[0].cast("double").alias("x"), xy(t)[1].cast("double").alias("y")))
    # An outer ring opens with one bracket more than a hole.
    bodies = F.regexp_extract_all(text, F.lit(r"(\(?)\(([^()]+)\)"), F.lit(2))
    outer = F.regexp_extract_all(text, F.lit(r"(\(?)\(([^()]+)\)"), F.lit(1))
    areal = F.upper(text).rlike(r"^\s*(MULTI)?POLYGON")
    rings = F.transform(bodies, lambda body, i: bound(points(body), lambda p: F.when(areal, turned(p, F.get(outer, i) == "")).otherwise(p)))
    return joined(rings)


def parse_geojson(kind: Column, coordinates: Column) -> Column:
    """Points of a GeoJSON geometry by its type and the JSON text of its coordinates, as ``parse_wkt`` gives them."""
    xy = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    line = lambda part: F.transform(part, xy)
    rings = lambda polygon: F.transform(polygon, lambda r, i: bound(line(r), lambda p: turned(p, i > 0)))
    read = lambda depth: F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)
    return (
        F.when(kind == "Point", F.array(xy(read(1))))
        .when(kind == "LineString", line(read(2)))
        .when(kind == "MultiPoint", joined(F.transform(read(2), lambda p: F.array(xy(p)))))
        .when(kind == "MultiLineString", joined(F.transform(read(3), line)))
        .when(kind == "Polygon", joined(rings(read(3))))
        .when(kind == "MultiPolygon", joined(F.flatten(F.transform(read(4), rings))))
    )


def to_wkt(points: Column, kind: str = "LINESTRING") -> Column:
    body = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.concat(F.lit(f"{kind} (("), body, F.lit("))")) if kind == "POLYGON" else F.concat(F.lit(f"{kind} ("), body, F.lit(")"))


def sides(points: Column) -> Column:
    """Consecutive pairs (a, b) within the parts."""
    pairs = F.arrays_zip(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))).alias("a"), F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))).alias("b"))
    return F.filter(pairs, lambda s: s["a"].isNotNull() & s["b"].isNotNull())


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; a point on the left or lower side is inside."""

    def crossing(s):
        a, b = s["a"], s["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] != a["y"], b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(sides(ring), lambda s: F.coalesce(crossing(s), F.lit(False)))) % 2 == 1


def segment_distance(x: Column, y: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.when(square > 0, square)).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    px, py = x - (a["x"] + t * dx), y - (a["y"] + t * dy)
    return F.sqrt(px * px + py * py)


def line_distance(x: Column, y: Column, points: Column) -> Column:
    """From a point to the nearest point of a line."""
    single = F.sqrt((x - points[0]["x"]) * (x - points[0]["x"]) + (y - points[0]["y"]) * (y - points[0]["y"]))
    return F.when(F.size(points) > 1, F.array_min(F.transform(sides(points), lambda s: segment_distance(x, y, s["a"], s["b"])))).otherwise(single)


def polygon_distance(x: Column, y: Column, ring: Column) -> Column:
    """0 inside."""
    return F.when(contains(ring, x, y), 0.0).otherwise(line_distance(x, y, ring))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive against the clock."""
    return F.aggregate(sides(ring), F.lit(0.0), lambda acc, s: acc + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2


def area(ring: Column) -> Column:
    """Area of all parts, less that of the holes."""
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> Column:
    """Area centroid of a ring; the mean of its points if it has no area."""
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda acc, s: F.struct((acc["a"] + cross(s)).alias("a"), (acc["x"] + (s["a"]["x"] + s["b"]["x"]) * cross(s)).alias("x"), (acc["y"] + (s["a"]["y"] + s["b"]["y"]) * cross(s)).alias("y"))
    total = F.aggregate(sides(ring), zero, add)
    real = F.filter(ring, lambda p: p.isNotNull())
    mean = lambda k: F.aggregate(real, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(real)
    flat = total["a"] == 0
    return F.when(flat, F.struct(mean("x").alias("x"), mean("y").alias("y"))).otherwise(F.struct((total["x"] / (3 * F.when(~flat, total["a"]))).alias("x"), (total["y"] / (3 * F.when(~flat, total["a"]))).alias("y")))


def bounds(points: Column) -> Column:
    """x0, y0, x1, y1 of all points."""
    of = lambda f, k: f(F.transform(points, lambda p: p[k]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_min, "y").alias("y0"), of(F.array_max, "x").alias("x1"), of(F.array_max, "y").alias("y1"))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is written, and so evaluated, once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def clipped_area(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a ring within a box, by clipping at one side of the box after another."""

    def clip(points: Column, axis: str, limit: Column, keep_above: bool) -> Column:
        other = "y" if axis == "x" else "x"
        inside = (lambda p: p[axis] >= limit) if keep_above else (lambda p: p[axis] <= limit)

        def crossing(a, b):
            t = (limit - a[axis]) / F.when(b[axis] != a[axis], b[axis] - a[axis])
            at = a[other] + t * (b[other] - a[other])
            return F.struct(limit.cast("double").alias("x"), at.alias("y")) if axis == "x" else F.struct(at.alias("x"), limit.cast("double").alias("y"))

        def step(s):
            a, b = s["a"], s["b"]
            cut = F.when(inside(a) != inside(b), F.array(crossing(a, b))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
            return F.concat(cut, F.when(inside(b), F.array(F.struct(b["x"].alias("x"), b["y"].alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>")))

        closed = lambda out: F.when(F.size(out) > 0, F.concat(out, F.slice(out, 1, 1))).otherwise(out)
        return bound(points, lambda p: bound(F.flatten(F.transform(sides(p), step)), closed))

    def clipped(points: Column) -> Column:
        for axis, limit, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
            points = clip(points, axis, limit, above)
        return bound(points, lambda p: F.when(F.size(p) > 3, signed_area(p)).otherwise(0.0))

    return F.abs(F.aggregate(F.transform(parts(ring), clipped), F.lit(0.0), lambda acc, x: acc + x))


def touches_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether any side of a ring passes through the inside of a box."""

    def hit(s):
        a, b = s["a"], s["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]

        def limits(p, d, lo, hi):
            first = F.when(d == 0, F.when((p > lo) & (p < hi), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(F.least((lo - p) / F.when(d != 0, d), (hi - p) / F.when(d != 0, d)))
            last = F.when(d == 0, F.when((p > lo) & (p < hi), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.greatest((lo - p) / F.when(d != 0, d), (hi - p) / F.when(d != 0, d)))
            return first, last

        ax, bx = limits(a["x"], dx, x0, x1)
        ay, by = limits(a["y"], dy, y0, y1)
        return F.greatest(ax, ay, F.lit(0.0)) < F.least(bx, by, F.lit(1.0))

    return F.exists(sides(ring), hit)

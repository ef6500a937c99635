"""Simplification of shapes (arrays of points with a null between two parts) that keeps shared borders.

Shapes are cut into arcs where borders part, equal arcs become one, each arc is thinned
once, and shapes are put together again from their arcs.  Sides that would cross,
touch or overlap others, or pass over others' corners, take back points until none does.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterway.functions import geometry as G
from rasterway.functions import planar
from rasterway.grid import Grid
from rasterway.operators.shapes import _mapped, _shape, parts_of
from rasterway.storage import written

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SIDES = "arc string, at int, fresh boolean, points array<struct<x:double,y:double>>"


def half_cell(grid: Grid) -> float:
    """The tolerance that shapes are simplified by before they are rasterized."""
    return max(float(np.hypot(grid.a, grid.b)), float(np.hypot(grid.d, grid.e))) / 2


def thinned(shapes: DataFrame, column: str, tolerance: float) -> DataFrame:
    """Each shape for itself, such as routes as lines: parts keep the points that lie off by more than the tolerance.

    Rings keep three corners; null and empty shapes stay.
    """

    def one(batch: pa.RecordBatch, k: int):
        return _shape([p[planar.corners(p, tolerance)] for p in parts_of(batch.column(column)[k])])

    return _mapped(shapes, column, one)


def _nodes(sides: DataFrame) -> DataFrame:
    """x, y of points where borders part or lines end: all without just two neighbours."""
    ends = sides.select("a", F.col("b").alias("o")).unionAll(sides.select(F.col("b").alias("a"), F.col("a").alias("o"))).distinct()
    return ends.groupBy("a").count().where("count <> 2").select("a")


def _arcs(batches):
    """Rows (_id, part, at, back, arc, points): parts cut at their marked places; an arc runs from its smaller end."""
    for batch in batches:
        rows = {k: [] for k in ("_id", "part", "at", "back", "arc", "points")}
        ids = batch.column("_id").to_pylist()
        for k, marks in enumerate(batch.column("marks").to_pylist()):
            marked: dict[int, list[int]] = {}
            for m in marks or ():
                marked.setdefault(m["part"], []).append(m["at"])
            for part, p in enumerate(parts_of(batch.column("_shape")[k])):
                cuts = sorted(set(marked.get(part, ())))
                ring = len(p) > 3 and (p[0] == p[-1]).all()
                if ring:  # begins at a cut, or at the point farthest from the middle, a corner if there is one
                    off = np.hypot(*(p[:-1] - (p.min(0) + p.max(0)) / 2).T)
                    first = cuts[0] if cuts else int(np.lexsort([p[:-1, 1], p[:-1, 0], -off])[0])
                    p = np.vstack([np.roll(p[:-1], -first, 0), p[first : first + 1]])
                    cuts = [c - first for c in cuts if c < len(p) - 1]
                cuts = sorted({0, len(p) - 1, *cuts})
                for at, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]) if len(p) > 1 else [(0, 0)]):
                    arc = p[a : b + 1] + 0.0
                    # A loop is told by the points next to its end.
                    e = 1 if (arc[0] == arc[-1]).all() and len(arc) > 2 else 0
                    back = tuple(arc[-1 - e]) < tuple(arc[e])
                    arc = arc[::-1] if back else arc
                    for name, v in zip(rows, (ids[k], part, at, back, hashlib.sha256(arc.tobytes()).hexdigest(), [{"x": x, "y": y} for x, y in arc.tolist()])):
                        rows[name].append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.list_(_POINT))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], list(rows))


def _cut(batches, tolerance: float, once: bool):
    """Sides between kept points, with what they pass over; ``once`` takes back the farthest point of each first."""
    for batch in batches:
        arcs, at, points = [], [], []
        for k in range(batch.num_rows):
            p = parts_of(batch.column("points")[k])[0]
            if once:
                far = planar.farthest(p)[0]
                kept = np.union1d(planar.corners(p[: far + 1], tolerance), far + planar.corners(p[far:], tolerance))
            else:
                kept = planar.corners(p, tolerance)
            first = batch.column("at")[k].as_py()
            for a, b in zip(kept[:-1], kept[1:]) if len(p) > 1 else [(0, 0)]:
                arcs.append(batch.column("arc")[k].as_py())
                at.append(first + int(a))
                points.append([{"x": x, "y": y} for x, y in p[a : b + 1].tolist()])
        yield pa.RecordBatch.from_arrays([pa.array(arcs, pa.string()), pa.array(at, pa.int32()), pa.array([True] * len(at), pa.bool_()), pa.array(points, pa.list_(_POINT))], ["arc", "at", "fresh", "points"])


def _squared(sides: DataFrame, spread: bool, high: int) -> DataFrame:
    """``sides`` on squares of a power of two no smaller than they are, or with ``spread`` on those of all larger powers too."""
    levels = F.explode(F.sequence(F.col("level"), F.lit(high))) if spread else F.col("level")
    out = sides.withColumn("on", levels)
    w = F.pow(F.lit(2.0), F.col("on"))
    for name, lo, hi in (("i", "x0", "x1"), ("j", "y0", "y1")):
        out = out.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / w), F.floor(F.col(hi) / w))))
    return out


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _clash(s: str, t: str) -> Column:
    """Whether two sides meet in anything but a common end, or are one and the same."""
    c = lambda n, k: F.col(f"{n}_{k}")
    a, b = (c(s, "ax"), c(s, "ay")), (c(s, "bx"), c(s, "by"))
    p, q = (c(t, "ax"), c(t, "ay")), (c(t, "bx"), c(t, "by"))
    same = lambda u, v: (u[0] == v[0]) & (u[1] == v[1])

    def on(u, v, m):
        box = (F.least(u[0], v[0]) <= m[0]) & (m[0] <= F.greatest(u[0], v[0])) & (F.least(u[1], v[1]) <= m[1]) & (m[1] <= F.greatest(u[1], v[1]))
        return box & (_turn(*u, *v, *m) == 0) & ~same(u, m) & ~same(v, m)

    across = (F.signum(_turn(*a, *b, *p)) * F.signum(_turn(*a, *b, *q)) < 0) & (F.signum(_turn(*p, *q, *a)) * F.signum(_turn(*p, *q, *b)) < 0)
    equal = (same(a, p) & same(b, q)) | (same(a, q) & same(b, p))
    return across | equal | on(a, b, p) | on(a, b, q) | on(p, q, a) | on(p, q, b)


def _clashing(sides: DataFrame, first: bool) -> DataFrame:
    """(arc, at) of sides that pass over points and clash with another, of which one is fresh."""
    p = F.col("points")
    b = G.bounds(p)
    flat = sides.select("arc", "at", "fresh", (F.size(p) > 2).alias("passes"), p[0]["x"].alias("ax"), p[0]["y"].alias("ay"), F.element_at(p, -1)["x"].alias("bx"), F.element_at(p, -1)["y"].alias("by"), *(b[k].alias(k) for k in ("x0", "y0", "x1", "y1")))
    flat = flat.where("x1 > x0 OR y1 > y0")
    flat = written(flat.withColumn("level", F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).cast("int")))
    high = flat.agg(F.max("level")).first()[0]
    if high is None:
        return flat.select("arc", "at")
    named = lambda df, n: df.select("on", "i", "j", *(F.col(c).alias(f"{n}_{c}") for c in flat.columns))

    def met(probe, build):
        pairs = named(_squared(probe, True, high), "s").join(named(_squared(build, False, high), "t"), ["on", "i", "j"])
        apart = ~((F.col("s_arc") == F.col("t_arc")) & (F.col("s_at") == F.col("t_at")))
        boxes = (F.col("s_x0") <= F.col("t_x1")) & (F.col("t_x0") <= F.col("s_x1")) & (F.col("s_y0") <= F.col("t_y1")) & (F.col("t_y0") <= F.col("s_y1"))
        return pairs.where(apart & boxes & (F.col("s_passes") | F.col("t_passes")))

    pairs = met(flat, flat) if first else met(flat.where("fresh"), flat).unionByName(met(flat, flat.where("fresh")))
    within = lambda n, o, e: F.col(f"{o}_{e}x").between(F.col(f"{n}_x0"), F.col(f"{n}_x1")) & F.col(f"{o}_{e}y").between(F.col(f"{n}_y0"), F.col(f"{n}_y1"))
    found = []
    for n, o in (("s", "t"), ("t", "s")):
        for e in ("a", "b"):  # corners of the other in what this side passes over
            found.append(F.struct(F.col(f"{n}_arc").alias("arc"), F.col(f"{n}_at").alias("at"), (F.col(f"{n}_passes") & F.col("clash")).alias("sure"), (F.col(f"{n}_passes") & within(n, o, e)).alias("maybe"), F.col(f"{o}_{e}x").alias("x"), F.col(f"{o}_{e}y").alias("y")))
    ends = written(pairs.withColumn("clash", _clash("s", "t")).select(F.explode(F.array(*found)).alias("f")).select("f.*").where("sure OR maybe").distinct())
    sure = ends.where("sure").select("arc", "at").distinct()
    corner = F.exists("points", lambda q: (q["x"] == F.col("x")) & (q["y"] == F.col("y")))
    ring = F.concat(F.col("points"), F.slice("points", 1, 1))
    over = ends.where("NOT sure").join(sides.select("arc", "at", "points"), ["arc", "at"]).where(~corner & G.contains(ring, F.col("x"), F.col("y")))
    return sure.unionByName(over.select("arc", "at")).distinct()


def simplified(shapes: DataFrame, tolerance: float, column: str = "ring") -> DataFrame:
    """``shapes`` without the points of lines and rings that lie off by no more than ``tolerance``; null and empty shapes go.

    Borders are shared where shapes have the same points; neighbours have the same border afterwards, and no
    side comes to cross, touch or pass another, or a corner of it.  Sides of shapes that overlap
    as they come stay as detailed as they are near their crossings.  Rings keep three corners and
    begin at a point where borders part, if there is one; repeated rows stay, other columns pass through.
    """
    source = written(shapes.where(F.size(column) > 0).withColumn("_id", F.monotonically_increasing_id()))
    # Points that repeat within a part are one.
    once = F.transform(G.parts(F.col(column)), lambda part: F.filter(part, lambda p, k: (k == 0) | ~p.eqNullSafe(F.get(part, k - 1))))
    own = written(source.select("_id", G.joined(once).alias("_shape")))
    parts = own.select("_id", F.posexplode(G.parts(F.col("_shape"))).alias("part", "p"))
    nodes = _nodes(parts.select(F.explode(G.sides(F.col("p"))).alias("s")).select("s.a", "s.b"))
    places = parts.select("_id", "part", F.posexplode("p").alias("at", "a"))
    closing = parts.select("_id", "part", F.size("p").alias("n"), (F.col("p")[0] == F.element_at("p", -1)).alias("closed"))
    ends = closing.where("NOT closed").select("_id", "part", F.explode(F.array(F.lit(0), F.col("n") - 1)).alias("at"))
    # Where a line ends, others are cut too.
    lines = places.join(ends, ["_id", "part", "at"]).select("a")
    marks = places.join(nodes.unionAll(lines).distinct(), "a", "left_semi").groupBy("_id").agg(F.collect_list(F.struct("part", "at")).alias("marks"))
    uses = written(own.join(marks, "_id", "left").mapInArrow(_arcs, "_id long, part int, at int, back boolean, arc string, points array<struct<x:double,y:double>>"))
    arcs = uses.groupBy("arc").agg(F.first("points").alias("points")).select("arc", F.lit(0).alias("at"), "points")
    sides = written(arcs.mapInArrow(lambda b: _cut(b, tolerance, False), _SIDES))
    first = True
    while True:
        again = written(_clashing(sides, first))
        if not again.limit(1).count():
            break
        cut = sides.join(again, ["arc", "at"]).select("arc", "at", "points").mapInArrow(lambda b: _cut(b, tolerance, True), _SIDES)
        sides = written(sides.join(again, ["arc", "at"], "left_anti").withColumn("fresh", F.lit(False)).select("arc", "at", "fresh", "points").unionByName(cut))
        first = False
    line = F.array_sort(F.collect_list(F.struct("at", F.col("points")[0].alias("a"), F.element_at("points", -1).alias("b"))))
    made = sides.groupBy("arc").agg(line.alias("l"), F.max(F.size("points")).alias("n"))
    made = made.select("arc", F.when((F.size("l") == 1) & (F.col("n") == 1), F.array(F.col("l")[0]["a"])).otherwise(F.concat(F.transform("l", lambda s: s["a"]), F.array(F.element_at("l", -1)["b"]))).alias("points"))
    used = uses.select("_id", "part", "at", "back", "arc").join(made, "arc").withColumn("points", F.when(F.col("back"), F.reverse("points")).otherwise(F.col("points"))).repartition("_id")
    whole = used.groupBy("_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "points"))).alias("l"))
    whole = whole.select("_id", "part", F.flatten(F.transform("l", lambda s, k: F.when(k > 0, F.slice(s["points"], F.lit(2), F.size(s["points"]))).otherwise(s["points"]))).alias("p"))
    whole = whole.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("part", "p"))).alias("l")).select("_id", G.joined(F.transform("l", lambda s: s["p"])).alias("_new"))
    return source.join(whole, "_id").select(*(F.col("_new").alias(c) if c == column else F.col(f"`{c}`") for c in shapes.columns))

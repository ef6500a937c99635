"""Unions, repairs and clips of shapes (arrays of points with a null between two parts)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterway.functions import geometry as G
from rasterway.functions import planar
from rasterway.operators import nearby
from rasterway.storage import written

#: Shapes that one task unites at once.
BATCH = 64
#: Corners of the polygon that stands for a circle where areas are clipped to it.
CORNERS = 64
_POINTS = "array<struct<x:double,y:double>>"


def parts_of(points: pa.ListScalar | None) -> list[np.ndarray]:
    """The parts of a shape as arrays (n, 2)."""
    if points is None or not points.is_valid or not len(points.values):
        return []
    values = points.values
    xy = np.stack([values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], 1)
    gaps = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False))
    return [p for p in (xy[a:b] for a, b in zip(np.append(0, gaps + 1), np.append(gaps, len(xy)))) if len(p)]


def _shape(parts: list[np.ndarray]) -> list | None:
    out: list = []
    for k, p in enumerate(parts):
        if k:
            out.append(None)
        out += [{"x": x, "y": y} for x, y in p.tolist()]
    return out or None


def _with(batch: pa.RecordBatch, column: str, shapes: list) -> pa.RecordBatch:
    at = batch.schema.get_field_index(column)
    return batch.set_column(at, batch.schema.field(at), pa.array(shapes, batch.schema.field(at).type))


def _mapped(table: DataFrame, column: str, f: Callable[[pa.RecordBatch, int], list | None]) -> DataFrame:
    """``table`` with a shape column made anew row by row."""

    def run(batches):
        for batch in batches:
            yield _with(batch, column, [f(batch, k) for k in range(batch.num_rows)])

    made = [T.StructField(c.name, T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))) if c.name == column else c for c in table.schema]
    return table.mapInArrow(run, T.StructType(made))


def _tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has: work on shapes takes far longer than their bytes tell."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def repaired(shapes: DataFrame, column: str = "ring") -> DataFrame:
    """``shapes`` with valid polygons: what rings enclose an odd number of times.

    Crossing rings are split, doubled edges cancel, holes get their direction.  Null and
    empty shapes and those without area go.
    """

    def one(batch: pa.RecordBatch, k: int):
        return _shape(planar.repaired(parts_of(batch.column(column)[k])))

    return _mapped(shapes.where(F.size(column) > 0), column, one).where(F.col(column).isNotNull())


def united(features: DataFrame, key: str, column: str = "ring", order: list[str] | None = None) -> DataFrame:
    """One row a key: the attributes of its first row, and the union of its polygons.

    Rows come in the ``order`` of these columns, or of all attributes.  Shapes are united
    in batches of near ones, again and again, until a key has one; no task takes more than
    BATCH shapes, and what is inside a union is gone before the next round.  Polygons are
    taken as they are repaired; keys without any area have a null shape.
    """
    rest = [c for c in features.columns if c not in (key, column)]
    by = F.struct(*(order or rest)) if order or rest else F.lit(0)
    first = features.groupBy(key).agg((F.min_by(F.struct(*rest), by) if rest else F.lit(None)).alias("_first"))
    # Equal shapes of a key add nothing; the exchange deals the others out, however few files they came in.
    level = repaired(features.where(F.size(column) > 0).select(F.col(key).alias("_key"), F.col(column).alias("ring")).distinct().repartition(_tasks(features), "_key", "ring"), "ring")
    schema = f"_key {features.schema[key].dataType.simpleString()}, ring {_POINTS}"

    def unite(table: pa.Table) -> pa.Table:
        if table.num_rows == 1:
            return table.select(["_key", "ring"])
        rings = planar.united([parts_of(r) for r in table.column("ring")])
        return pa.table({"_key": table.column("_key").slice(0, 1), "ring": pa.array([_shape(rings)], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})

    while True:
        level = written(level)
        if not level.groupBy("_key").count().where("count > 1").limit(1).count():
            break
        # Near shapes first: batches are squares of a grid over each key's shapes, so that what lies inside goes early.
        b = G.bounds(F.filter("ring", lambda p: p.isNotNull()))
        placed = level.withColumn("_b", b).select("_key", "ring", (F.col("_b.x0") + F.col("_b.x1")).alias("_x"), (F.col("_b.y0") + F.col("_b.y1")).alias("_y"))
        span = placed.groupBy("_key").agg(F.count("*").alias("count"), *(f(c).alias(f"{c}{n}") for c in ("_x", "_y") for n, f in (("0", F.min), ("1", F.max))))
        many = F.ceil(F.col("count") / BATCH).cast("double")
        w, h = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
        across = F.greatest(F.lit(1.0), F.least(many, F.floor(F.sqrt(F.when(h > 0, many * w / h).otherwise(many * many))).cast("double")))
        span = span.withColumnRenamed("_key", "_of").withColumns({"_nx": across, "_w": w, "_h": h}).withColumn("_ny", F.greatest(F.lit(1.0), F.floor(many / F.col("_nx")).cast("double")))
        at = lambda c, size, n: F.when(F.col(size) > 0, F.least(F.col(n) - 1, F.floor((F.col(c) - F.col(f"{c}0")) / F.col(size) * F.col(n)))).otherwise(0)
        dealt = placed.join(span, F.col("_key").eqNullSafe(F.col("_of"))).withColumn("_part", (at("_x", "_w", "_nx") * F.col("_ny") + at("_y", "_h", "_ny")).cast("long"))
        # A square that is crowded is dealt out again by its shapes' hashes.
        crowd = dealt.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
        crowd = crowd.withColumnsRenamed({"_key": "_k", "_part": "_p"})
        dealt = dealt.join(crowd, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))).drop("_k", "_p").withColumn("_more", F.pmod(F.xxhash64(F.col("ring")), F.ceil(F.col("_n") / BATCH)))
        parts = dealt.select("_key", "ring", "_part", "_more").repartition(_tasks(features), "_key", "_part", "_more")
        level = parts.groupBy("_key", "_part", "_more").applyInArrow(unite, schema)
    shapes = level.withColumnRenamed("ring", "_ring")
    return first.join(shapes, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, *(F.col(f"_first.`{c}`").alias(c) for c in rest), F.col("_ring").alias(column))


def clipped(pairs: DataFrame, column: str, region: str, areal: str) -> DataFrame:
    """``pairs`` whose shapes (polygons where ``areal`` holds, else lines or points) are cut to a region's rings; those outside go."""

    def one(batch: pa.RecordBatch, k: int):
        own, rings = parts_of(batch.column(column)[k]), parts_of(batch.column(region)[k])
        if not own or not rings:
            return None
        if batch.column(areal)[k].as_py():
            return _shape(planar.common(own, rings))
        spots = [p for p in own if len(p) == 1]
        lines = planar.lines_inside([p for p in own if len(p) > 1], rings)
        if spots:
            rim = planar.segments(planar.closed(rings))
            inside = planar.windings(np.concatenate(spots), rim, np.ones((len(rim), 1), np.int64))[:, 0] > 0
            lines += [p for p, on in zip(spots, inside) if on]
        return _shape(lines)

    return _mapped(pairs, column, one).where(F.col(column).isNotNull())


def _to_circle(lines: list[np.ndarray], x: float, y: float, radius: float) -> list[np.ndarray]:
    """The parts of lines, and the single points, within a circle."""
    out: list[list] = []
    for part in lines:
        if len(part) == 1:
            if np.hypot(*(part[0] - (x, y))) <= radius:
                out.append([part[0]])
            continue
        open_ = False
        for a, b in zip(part[:-1], part[1:]):
            d, v = b - a, a - (x, y)
            square = float(d @ d)
            if square == 0:
                continue
            # By the distance from the side's line, so that a circle that just touches it cuts nothing out.
            half, cross = float(v @ d) / square, float(d[0] * v[1] - d[1] * v[0])
            root = (radius * radius - cross * cross / square) / square
            if root < 0:
                open_ = False
                continue
            t0, t1 = max(0.0, -half - root**0.5), min(1.0, -half + root**0.5)
            if t0 > t1:
                open_ = False
                continue
            p, q = (a if t0 == 0 else a + t0 * d), (b if t1 == 1 else a + t1 * d)
            if open_ and t0 == 0:
                out[-1].append(q)
            else:
                out.append([p, q])
            open_ = t1 == 1
    return [np.array(p) for p in out]


def _sided(features: DataFrame) -> DataFrame:
    """feature, ax, ay, bx, by: the sides of all shapes; single points are sides without length."""
    sides = F.explode(F.flatten(F.transform(G.parts(F.col("points")), lambda p: F.when(F.size(p) > 1, G.sides(p)).otherwise(F.array(F.struct(p[0].alias("a"), p[0].alias("b")))))))
    return features.select("feature", sides.alias("s")).select("feature", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def _least(points: DataFrame, features: DataFrame, sides: DataFrame, side: float, radius: Column) -> DataFrame:
    """id, feature, distance of the shapes no farther from points (id, x, y) than ``radius``, at most ``side``, which squares are wide."""
    s = F.lit(side)
    near = points.withColumns({"i": nearby.square(F.col("x"), s), "j": nearby.square(F.col("y"), s)})
    spread = sides
    for name, a, b in (("i", "ax", "bx"), ("j", "ay", "by")):
        lo, hi = (nearby.square(f(a, b), s) for f in (F.least, F.greatest))
        spread = spread.withColumn(name, F.explode(F.sequence(lo - 1, hi + 1)))
    end = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    gap = G.segment_distance(F.col("x"), F.col("y"), end("ax", "ay"), end("bx", "by"))
    met = near.join(spread, ["i", "j"]).select("id", "feature", gap.alias("distance"), radius.alias("_r")).where("distance <= _r + 1e-9 * _r")
    areas = features.where("areal").select("feature", F.col("points").alias("_ring"), G.bounds(F.filter("points", lambda p: p.isNotNull())).alias("_b")).select("feature", "_ring", "_b.*")
    within = nearby.containing(points.select("id", "x", "y"), areas, G.contains(F.col("_ring"), F.col("x"), F.col("y"))).select("id", "feature", F.lit(0.0).alias("distance"))
    return met.select("id", "feature", "distance").unionByName(within).groupBy("id", "feature").agg(F.min("distance").alias("distance"))


def shapes_within_radius(points: DataFrame, features: DataFrame, radius: float, expand: bool = True, growth: float = 0.05) -> DataFrame:
    """id, feature, distance, radius and the clipped shape of features (feature, areal, points) no farther from points (id, x, y) than the radius.

    With ``expand``, a point without any gets the smallest radius * (1 + growth n) that
    reaches one.  Sides of shapes meet points on squares of the radius; points that find none
    go on to squares twice as wide until each has met one.  Lines are cut where they leave
    the circle, areas by a polygon of CORNERS corners on it (null where it just misses them).
    """
    # Points at one place and equal shapes meet, and are cut, once.
    places, spots = nearby.numbered(nearby.placed(points).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "_place", "x", "y")
    features, owners = nearby.numbered(features.where(F.size("points") > 0).select("feature", "areal", "points"), "_shape", "areal", "points")
    places, features = places.withColumnRenamed("_place", "id"), features.withColumnRenamed("_shape", "feature")
    sides = written(_sided(features))
    whole = F.lit(float(radius))
    found = written(_least(places, features, sides, float(radius), whole).withColumn("radius", whole))
    if expand and sides.limit(1).count():
        todo, side = written(places.join(found.select("id").distinct(), "id", "left_anti")), float(radius)
        grown = []
        while todo.limit(1).count():
            side *= 2
            near = _least(todo, features, sides, side, F.lit(side)).groupBy("id").agg(F.min("distance").alias("d"))
            near = written(near.withColumn("radius", whole * (1 + F.lit(growth) * F.ceil((F.col("d") / radius - 1) / growth - 1e-9))).select("id", "radius"))
            grown.append(near)
            todo = written(todo.join(near.select("id"), "id", "left_anti"))
        for k, near in enumerate(grown):
            # The radius that reaches the nearest may be a step beyond the square's side.
            more = _least(places.join(near, "id"), features, sides, float(radius) * 2 ** (k + 1) * (1 + growth), F.col("radius"))
            found = found.unionByName(more.join(near, "id").select("id", "feature", "distance", "radius"))
    pairs = found.join(places, "id").join(features.select("feature", "areal", "points"), "feature").repartition(_tasks(features), "id", "feature")

    def one(batch: pa.RecordBatch, k: int):
        x, y, r = (batch.column(c)[k].as_py() for c in ("x", "y", "radius"))
        own = parts_of(batch.column("points")[k])
        if not batch.column("areal")[k].as_py():
            return _shape(_to_circle(own, x, y, r))
        turn = np.arange(CORNERS + 1) % CORNERS * (2 * np.pi / CORNERS)
        return _shape(planar.common(own, [np.stack([x + r * np.cos(turn), y + r * np.sin(turn)], 1)]))

    cut = written(_mapped(pairs, "points", one).select(F.col("id").alias("_place"), F.col("feature").alias("_shape"), "distance", "radius", "points"))
    return nearby.expanded(cut, spots.select("_place", "id"), owners.select("_shape", "feature")).select("id", "feature", "distance", "radius", "points")

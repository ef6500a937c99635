"""Joins of points with shapes that lie near, by squares of a grid instead of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterway.storage import written

#: Rows that a task makes, about, where pairs of places become pairs of rows.
ROWS = 1 << 21
#: Times that squares widen for points that nothing lies near.
WIDER = 4.0


def square(v: Column, side: Column | float) -> Column:
    return F.floor(v / side).cast("long")


def spread(shapes: DataFrame, side: float, margin: int = 0) -> DataFrame:
    """``shapes`` (x0, y0, x1, y1, ...) once for every square that their boxes cover, ``margin`` squares wider; adds i, j."""
    s = F.lit(float(side))
    for name, lo, hi in (("i", "x0", "x1"), ("j", "y0", "y1")):
        shapes = shapes.withColumn(name, F.explode(F.sequence(square(F.col(lo), s) - margin, square(F.col(hi), s) + margin)))
    return shapes


def side_of(shapes: DataFrame) -> float | None:
    """A side for squares: the mean size of the shapes' boxes or their mean distance, whichever is more; None without shapes."""
    r = shapes.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("size"), F.count("*").alias("n"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y1") - F.min("y0")).alias("h")).first()
    if not r.n or r.size is None:
        return None
    return max(float(r.size), (r.w * r.h / r.n) ** 0.5, max(r.w, r.h) / r.n) or 1.0


def placed(points: DataFrame) -> DataFrame:
    """Points (x, y) that have a place."""
    ok = F.lit(True)
    for c in ("x", "y"):
        v = F.col(c).cast("double")
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return points.where(ok)


def containing(points: DataFrame, shapes: DataFrame, inside: Column) -> DataFrame:
    """Points joined with the shapes (with boxes) for which ``inside`` holds; it must not hold outside the box."""
    side = side_of(shapes)
    if side is None:
        return points.join(shapes, F.lit(False))
    p = placed(points).withColumn("i", square(F.col("x"), F.lit(side))).withColumn("j", square(F.col("y"), F.lit(side)))
    return p.join(spread(shapes, side), ["i", "j"]).where(inside).drop("i", "j")


def nearest(points: DataFrame, shapes: DataFrame, key: str, distance: Column) -> DataFrame:
    """(id, key, distance) of the shape nearest to each point (id, x, y); ties go to the smallest key.

    A shape no farther than the side of a square covers the point's square or one beside
    it, so a smallest distance within the side is final; other points go on to wider squares.
    Points without a place, and all points where there is no shape, have no row.
    """
    side = side_of(shapes)
    todo = placed(points).select("id", "x", "y").distinct()
    found = None
    while side is not None:
        p = todo.withColumn("i", square(F.col("x"), F.lit(side))).withColumn("j", square(F.col("y"), F.lit(side)))
        best = p.join(spread(shapes, side, 1), ["i", "j"]).groupBy("id").agg(F.min(F.struct(distance.alias("d"), F.col(key).alias("k"))).alias("m"))
        best = written(best.where(F.col("m.d") <= side).select("id", F.col("m.k").alias(key), F.col("m.d").alias("distance")))
        found = best if found is None else found.unionByName(best)
        todo = written(todo.join(best.select("id"), "id", "left_anti"))
        if not todo.limit(1).count():
            return found
        side *= WIDER
    return todo.limit(0).select("id", F.lit(None).cast(shapes.schema[key].dataType).alias(key), F.lit(None).cast("double").alias("distance"))


def numbered(table: DataFrame, key: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(the distinct values of ``columns`` with a number ``key``, ``table`` with that number)."""
    distinct = written(table.select(*columns).distinct().withColumn(key, F.monotonically_increasing_id()))
    same = F.lit(True)
    for c in columns:
        same = same & table[c].eqNullSafe(distinct[c])
    return distinct, written(table.join(distinct, same).select(*(table[c] for c in table.columns), distinct[key]))


def expanded(pairs: DataFrame, points: DataFrame, owners: DataFrame, rows: int | None = None) -> DataFrame:
    """``pairs`` (_place, _shape, ...) once for every pair of a point (_place, id) and an owner (_shape, feature) of them.

    Points of a crowded place are dealt into runs, and there are as many tasks as the pairs
    of rows need, so that no task makes many more than ``rows``.
    """
    rows = rows or ROWS
    each = pairs.join(owners.groupBy("_shape").agg(F.count("*").alias("_m")), "_shape").groupBy("_place").agg(F.sum("_m").alias("_m"))
    load = each.join(points.groupBy("_place").agg(F.count("*").alias("_n")), "_place")
    load = written(load.select("_place", (F.col("_m") * F.col("_n")).alias("_rows"), F.least(F.col("_n"), F.ceil(F.col("_m") * F.col("_n") / rows)).alias("_runs")))
    total = load.agg(F.sum("_rows")).first()[0] or 0
    tasks = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // rows))
    load = load.select("_place", "_runs")
    left = pairs.join(owners, "_shape").drop("_shape").join(load, "_place").withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_runs") - 1))).drop("_runs")
    right = points.join(load, "_place").select("_place", "id", F.pmod(F.xxhash64("id"), F.col("_runs")).alias("_run"))
    by = ["_place", "_run"]
    return left.repartition(tasks, *by).hint("shuffle_hash").join(right.repartition(tasks, *by), by).drop(*by)

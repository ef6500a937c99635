"""Tables of routes to find: points on the grid, pairs of features, regions, radii, voltages, what is done."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterway.errors import ConfigError, MissingLayerError, RasterwayWarning
from rasterway.functions import geometry as G
from rasterway.functions import projection
from rasterway.grid import Grid
from rasterway.operators import nearby
from rasterway.storage import written

#: A radius grows by this part of itself until it holds a feature, so many times at most.
GROWTH, MOST_STEPS = 0.05, 10_000


def on_grid(table: DataFrame, grid: Grid, sides: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """Adds <side>_row and <side>_col from <side>_lat and <side>_lon, which narrow to 32 bits first and then go to the grid's system."""
    out = table
    for side in sides:
        x, y = F.col(f"{side}_lon").cast("float").cast("double"), F.col(f"{side}_lat").cast("float").cast("double")
        if projection.known(grid.crs) and not projection.same(grid.crs, "EPSG:4326"):
            at = projection.transformed(x, y, "EPSG:4326", grid.crs)
            x, y = at["x"], at["y"]
        out = out.withColumn(f"{side}_row", grid.row_of(y)).withColumn(f"{side}_col", grid.col_of(x))
    return out


def in_domain(table: DataFrame, grid: Grid, sides: tuple[str, ...] = ("start", "end"), warn: bool = False) -> DataFrame:
    """Rows whose places lie on the grid; ``warn`` counts the others, which takes a job."""
    ok = F.lit(True)
    for side in sides:
        ok = ok & F.coalesce(grid.inside(F.col(f"{side}_row"), F.col(f"{side}_col")), F.lit(False))
    if warn and (n := table.where(~ok).count()):
        warnings.warn(f"{n} rows outside the cost domain are dropped", RasterwayWarning, stacklevel=2)
    return table.where(ok)


def mapped(table: DataFrame, grid: Grid) -> DataFrame:
    """A route table with rows and columns of its ends, inside the grid."""
    for name in ("start_lat", "start_lon", "end_lat", "end_lon"):
        if name not in table.columns:
            raise MissingLayerError(f"a route table needs {name}")
    return in_domain(on_grid(table, grid), grid)


def supply_points(spark: SparkSession, grid: Grid, resolution: int = 128) -> DataFrame:
    """Centres of squares of ``resolution`` cells, numbered by row; halves round to even."""
    rows, cols = -(-grid.nrows // resolution), -(-grid.ncols // resolution)
    at = spark.range(rows * cols).select(F.col("id").alias("sc_point_gid"), F.expr(f"cast(id div {cols} as int)").alias("sc_row_ind"), F.expr(f"cast(id % {cols} as int)").alias("sc_col_ind"))
    centre = lambda c: F.bround(F.col(c) * resolution + resolution / 2, 0).cast("int")
    at = at.withColumn("start_row", centre("sc_row_ind")).withColumn("start_col", centre("sc_col_ind"))
    return projection.moved(at, grid.x(F.col("start_col")), grid.y(F.col("start_row")), grid.crs if projection.known(grid.crs) else "", "EPSG:4326", ("longitude", "latitude"))


def valid_nodes(nodes: DataFrame, surf: DataFrame, blocking: bool = True) -> DataFrame:
    """Nodes (row, col, option) whose own option's cost is there and, if invalid costs block, positive."""
    ok = F.col("_cost").isNotNull() & ~F.isnan("_cost")
    ok = ok & (F.col("_cost") > 0) if blocking else ok
    costs = surf.select("row", "col", "option", F.col("cost").alias("_cost"))
    return nodes.join(costs, ["row", "col", "option"]).where(ok).drop("_cost")


def remaining(table: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Routes that ``done`` does not have yet."""
    return table.join(done.select(*keys).distinct(), keys, "left_anti")


def definitions(table: DataFrame, by: list[str], swap: bool = True) -> DataFrame:
    """Routes grouped by their end, ids by rank; ends and starts change roles if that makes fewer searches.

    Columns: route_id, <by>, starts (array of structs), reversed.
    """
    start = [c for c in ("start_row", "start_col", "start_option") if c in table.columns]
    end = [c for c in ("end_row", "end_col", "end_option") if c in table.columns]
    rename = {}
    if swap and by == end:
        n = table.agg(F.count_distinct(*start).alias("s"), F.count_distinct(*end).alias("e")).first()
        if n.e > n.s:
            rename = {a: b for a, b in zip([*start, *end], [*end, *start])}
    turned = table.select(*[F.col(c).alias(rename.get(c, c)) for c in [*start, *end]], *[c for c in table.columns if c not in start + end])
    grouped = turned.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct(*start))).alias("starts"))
    return numbered(grouped, "route_id", by).withColumn("reversed", F.lit(bool(rename)))


def with_defaults(table: DataFrame, options: list[str]) -> DataFrame:
    """start_option and end_option (the first), voltage and polarity ('unknown') by option where missing."""
    out = table
    for name in ("start_option", "end_option"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(options[0]))
    for kind in ("voltage", "polarity"):
        for o in options:
            if f"{kind}_{o}" not in out.columns:
                out = out.withColumn(f"{kind}_{o}", F.col(kind).cast("string") if kind in out.columns else F.lit("unknown"))
    return out


def combinations(table: DataFrame, options: list[str]) -> DataFrame:
    """The distinct voltages and polarities by option: one scenario each."""
    return table.select(*[f"{k}_{o}" for k in ("voltage", "polarity") for o in options]).distinct()


def voltage_product(table: DataFrame, voltages: list | None, polarities: list | None) -> DataFrame:
    """Every route with every voltage and polarity; 'unknown' where none are given."""
    lists = [(n, v or ["unknown"]) for n, v in (("voltage", voltages), ("polarity", polarities))]
    out = table
    for name, values in lists:
        out = out.withColumn(name, F.explode(F.array([F.lit(v) for v in values])))
    return out


def subset(table: DataFrame, part: int, parts: int, by: list[str]) -> DataFrame:
    """The ``part``-th of ``parts`` slices of the sorted table, as sizes of ceil(n / parts)."""
    if not 0 <= part < parts:
        raise ConfigError(f"part {part} of {parts}")
    n = -(-table.count() // parts)
    return numbered(table, "_n", by).where((F.col("_n") >= part * n) & (F.col("_n") < (part + 1) * n)).drop("_n")


def numbered(table: DataFrame, name: str, by: list[str], first: int = 0) -> DataFrame:
    """Consecutive numbers in sorted order, by counts of sorted partitions instead of one sort in one task."""
    ordered = table.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ordered = ordered.withColumn("_part", F.shiftright("_at", 33)).withColumn("_own", F.col("_at").bitwiseAND((1 << 33) - 1))
    ordered = written(ordered)
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_c"))
    before = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ordered.join(before, "_part").withColumn(name, (F.col("_before") + F.col("_own") + first).cast("long")).drop("_at", "_part", "_own", "_before")


def feature_pairs(features: DataFrame, key: str = "id") -> DataFrame:
    """All unordered pairs of a list of features, once each (start_<column>, end_<column>).

    The result is quadratic by definition; ``features`` is the list that a study routes between.
    """
    a = features.select(*[F.col(c).alias(f"start_{c}") for c in features.columns])
    b = features.select(*[F.col(c).alias(f"end_{c}") for c in features.columns])
    return a.join(b, F.col(f"start_{key}") < F.col(f"end_{key}"))


def _boxed(regions: DataFrame, key: str) -> DataFrame:
    """(key, ring, x0, y0, x1, y1)."""
    return regions.select(key, "ring", G.bounds(F.col("ring")).alias("_b")).select(key, "ring", "_b.*")


def _in_metres(points: DataFrame, regions: DataFrame, crs: str) -> tuple[DataFrame, DataFrame]:
    """Both in the UTM zone of the middle of all regions, where ``crs`` is geographic."""
    if not crs or not projection.system(crs).geographic:
        return points, regions
    b = regions.select(G.bounds(F.col("ring")).alias("b")).agg(F.min("b.x0"), F.min("b.y0"), F.max("b.x1"), F.max("b.y1")).first()
    if b[0] is None:
        return points, regions
    zone = projection.utm_of((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    return projection.moved(points.select("id", "x", "y"), F.col("x"), F.col("y"), crs, zone), regions.withColumn("ring", projection.transformed_points(F.col("ring"), crs, zone))


def nearest_region(points: DataFrame, regions: DataFrame, key: str = "rid", crs: str = "") -> DataFrame:
    """``points`` (id, x, y, ...) with the ``key`` of the nearest of ``regions`` (key, ring) and the distance; ties go to the smallest key.

    With a geographic ``crs`` distances are metres in the UTM zone of the regions.  Points
    and regions meet on squares that widen until each point has its region.
    """
    places, shapes = _in_metres(points, regions, crs)
    return points.join(nearby.nearest(places, _boxed(shapes, key), key, G.polygon_distance(F.col("x"), F.col("y"), F.col("ring"))), "id")


def within_region(points: DataFrame, regions: DataFrame, key: str = "rid") -> DataFrame:
    """(id, key) of points inside a region."""
    return nearby.containing(points.select("id", "x", "y"), _boxed(regions, key), G.contains(F.col("ring"), F.col("x"), F.col("y"))).select("id", key)


def within_radius(points: DataFrame, features: DataFrame, radius: float, expand: bool = True) -> DataFrame:
    """(id, feature, distance, radius) of features (feature, fx, fy) no farther than the radius.

    With ``expand``, a point without any gets the smallest radius * (1 + 0.05 n) that holds
    one.  Points and features meet on squares of the radius; points that find none
    there learn how far the nearest is, and then meet squares of their own size.  Points at
    one place, and features at one, meet once.
    """
    places, spots = nearby.numbered(points.select("id", "x", "y"), "_place", "x", "y")
    sites, owners = nearby.numbered(features.select("feature", "fx", "fy"), "_shape", "fx", "fy")
    met = _within_radius(places.withColumnRenamed("_place", "id"), sites.withColumnRenamed("_shape", "feature"), radius, expand)
    met = written(met.select(F.col("id").alias("_place"), F.col("feature").alias("_shape"), "distance", "radius"))
    return nearby.expanded(met, spots.select("_place", "id"), owners.select("_shape", "feature")).select("id", "feature", "distance", "radius")


def _within_radius(points: DataFrame, features: DataFrame, radius: float, expand: bool) -> DataFrame:
    """``within_radius`` of points and features that each have a place of their own."""
    around = lambda own: F.explode(F.array([own + k for k in (-1, 0, 1)]))
    far = F.sqrt((F.col("x") - F.col("fx")) ** 2 + (F.col("y") - F.col("fy")) ** 2)

    def meet(p: DataFrame, f: DataFrame, side: Column, *by: str) -> DataFrame:
        for name, x, fx in (("i", "x", "fx"), ("j", "y", "fy")):
            p = p.withColumn(name, around(nearby.square(F.col(x), side)))
            f = f.withColumn(name, nearby.square(F.col(fx), side))
        return p.join(f, [*by, "i", "j"]).withColumn("distance", far)

    features, whole = features.select("feature", "fx", "fy"), F.lit(float(radius))
    near = meet(points.select("id", "x", "y"), features, whole).where(F.col("distance") <= radius).select("id", "feature", "distance", whole.alias("radius"))
    if not expand:
        return near
    lone = written(points.select("id", "x", "y").join(near.select("id").distinct(), "id", "left_anti"))
    spots = features.select("feature", F.col("fx").alias("x0"), F.col("fy").alias("y0"), F.col("fx").alias("x1"), F.col("fy").alias("y1"))
    gap = F.sqrt((F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2)
    least = nearby.nearest(lone, spots, "feature", gap)
    steps = F.ceil((F.col("distance") / radius - 1) / GROWTH - 1e-9)
    grown = least.where(steps <= MOST_STEPS).select("id", (whole * (1 + F.lit(GROWTH) * steps)).alias("radius"))
    # Radii by powers of two: at most as many kinds as MOST_STEPS allows doublings.
    grown = written(lone.join(grown, "id").withColumn("size", F.ceil(F.log2(F.col("radius") / radius)).cast("int") + 1))
    sizes = [r[0] for r in grown.select("size").distinct().collect()]
    if not sizes:
        return near
    sized = features.withColumn("size", F.explode(F.array([F.lit(k) for k in sizes])))
    wide = meet(grown, sized, whole * F.pow(F.lit(2.0), F.col("size")), "size").where(F.col("distance") <= F.col("radius") + 1e-9)
    return near.unionByName(wide.select("id", "feature", "distance", "radius"))


def latest(done: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; rows without a key belong to no route."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return done.dropna(subset=keys).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resumed(table: DataFrame, done: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """``table`` with the last known values of its keys, missing where there are none.

    A finished row of a key without a value cannot be resumed: the job that meets it ends with an error.
    """
    sure = [F.when(F.col(v).isNull(), F.raise_error(F.lit(f"cannot resume: finished routes have rows without {v}"))).otherwise(F.col(v)).alias(v) for v in values]
    return table.join(latest(done, keys, order).select(*keys, *sure), keys, "left")


def tidy_features(features: DataFrame) -> DataFrame:
    """Transmission features without helper columns and without a null category; gid becomes trans_gid."""
    out = features.drop("bgid", "egid", "cap_left")
    out = out.withColumnRenamed("gid", "trans_gid") if "gid" in out.columns else out
    return out.where(F.col("category").isNotNull()) if "category" in out.columns else out


def points_with_features(points: DataFrame, routes: DataFrame, key: str) -> DataFrame:
    """Points that have at least one feature to go to."""
    return points.join(routes.select(key).distinct(), key, "left_semi")


def end_cells(ends: DataFrame, cells_of_features: DataFrame, key: str) -> DataFrame:
    """All cells of the feature that each route ends at."""
    return ends.join(cells_of_features, key)

"""Registered queries: each applies operators to grids, routes and zones derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterway import grid as gridlib
from rasterway.functions import expressions as X
from rasterway.functions import geometry as G
from rasterway.grid import Grid
from rasterway.operators import finalize, network, reports, route_tables, search, zonal
from rasterway.plans import layer_file as layer_files
from rasterway.plans import layers as L
from rasterway.plans import scenario as P
from rasterway.plans.lookups import Transmission
from rasterway.sources.store import Store, append, read_features, read_points
from rasterway.storage import shared_dir

N = 32
GRID = Grid(N, N, a=90.0, c=0.0, e=-90.0, f=N * 90.0)
KEYS = ["route_id", "start_row", "start_col", "start_option"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    """A grid of lineitem: sums of integral quantities, so that all values are exact."""
    total, count = F.sum("l_quantity"), F.count("*")
    codes = F.array([F.lit(x) for x in (11, 21, 24, 41, 81, 90)])
    g = _t(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % n).cast("int").alias("row"), (F.col("l_partkey") % n).cast("int").alias("col")).agg(total.alias("s"), count.alias("k"))
    return g.select(
        "row", "col", (F.col("s") % 97 + 1).cast("float").alias("c1"), (F.col("k") % 7 + 1).cast("float").alias("c2"), (F.col("s") % 13).cast("float").alias("slope"), codes[(F.col("s") % 6).cast("int")].alias("nlcd"),
        (F.col("row") % 4 + 1).alias("iso"), (F.col("s") % 10 == 0).cast("float").alias("barrier"), ((F.col("k") % 3) / 2.0).cast("float").alias("fric"), (F.col("s") % 5 + 1).cast("float").alias("inv"), (F.col("s") % 4).cast("float").alias("zone"),
    )


def _small(spark, sf_dir) -> DataFrame:
    return _cells(spark, sf_dir, 16)


# Grids and stores ------------------------------------------------------------


def grid_coordinates(spark, sf_dir):
    return gridlib.with_coordinates(_cells(spark, sf_dir).select("row", "col"), GRID)


def grid_of_point(spark, sf_dir):
    p = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 2880).cast("double").alias("x"), (F.col("c_custkey") * 53 % 2880).cast("double").alias("y"))
    return p.select("c_custkey", GRID.row_of(F.col("y")).alias("row"), GRID.col_of(F.col("x")).alias("col"))


def grid_resampled(spark, sf_dir):
    target = Grid(20, 20, a=144.0, c=0.0, e=-144.0, f=N * 90.0)
    return gridlib.resampled(_cells(spark, sf_dir), GRID, target, ["c1", "nlcd"])


def grid_from_long(spark, sf_dir):
    c = _cells(spark, sf_dir)
    long = c.select("row", "col", F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("value")) for n in ("c1", "c2")])).alias("v")).select("row", "col", "v.layer", "v.value")
    return gridlib.from_long(long, ["c1", "c2"])


def grid_tiles(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("t", gridlib.tile(10))
    return c.groupBy("t.i", "t.j").agg(F.count("*").alias("cells"), F.max("c1").alias("largest"))


def _store(spark, sf_dir) -> Store:
    store = Store(spark, shared_dir(spark)).create(GRID)
    store.write_all(_cells(spark, sf_dir).select("row", "col", "c1", "c2", "nlcd"))
    return store


def store_layer(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.write("c2", store.cells(["c1"]).select("row", "col", (F.col("c1") * 2).alias("c2")), overwrite=True)
    store.delete("nlcd")
    return store.cells()


def store_window(spark, sf_dir):
    return _store(spark, sf_dir).window((-2, 6), (28, 35), ["c1"])


def store_append(spark, sf_dir):
    path = shared_dir(spark)
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    append(o.where("o_orderkey % 2 = 0"), path)
    append(o.where("o_orderkey % 2 = 1").withColumn("extra", F.lit(1)).drop("o_orderstatus"), path)
    return spark.read.parquet(path)


def routes_collected(spark, sf_dir):
    path = shared_dir(spark)
    r = _routes(spark, sf_dir).select("route_id", "start_row", "start_col", "end_row", "end_col")
    for part in (0, 1):
        r.where(F.col("route_id") % 2 == part).write.option("header", True).csv(f"{path}/routes_{part}.csv")
    kind = "route_id long, start_row int, start_col int, end_row int, end_col int"
    return finalize.collected(spark, f"{path}/routes_*.csv", kind)


def store_resampled(spark, sf_dir):
    store = Store(spark, shared_dir(spark)).create(GRID)
    store.write_resampled(_small(spark, sf_dir), Grid(16, 16, a=180.0, c=0.0, e=-180.0, f=N * 90.0), ["c1", "nlcd"])
    return store.cells(["c1", "nlcd"])


def store_layers_deleted(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.delete("c2")
    return spark.createDataFrame([(n, store.profile(n)["dtype"]) for n in store.layers()], "layer string, kind string")


def features_read(spark, sf_dir):
    path = shared_dir(spark) + ".geojson"
    x = (F.col("s_suppkey") % 90).cast("double")
    square = lambda x0, side: F.transform(F.array(*(F.array(x0 + i * side, F.lit(j * side)) for i, j in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)))), lambda p: p)
    kind = F.element_at(F.array(*map(F.lit, ("Polygon", "MultiPolygon", "MultiLineString"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rings = F.array(square(x, 30.0), square(x + 10.0, 10.0))
    text = F.when(kind == "MultiPolygon", F.to_json(F.array(rings, F.array(square(x + 100.0, 5.0))))).otherwise(F.to_json(rings))
    line = F.concat(F.lit('{"type":"Feature","properties":{"id":"'), F.col("s_suppkey"), F.lit('"},"geometry":{"type":"'), kind, F.lit('","coordinates":'), text, F.lit("}}"))
    _t(spark, sf_dir, "supplier").select(line.alias("value")).write.text(path)
    p = F.col("points")
    shape = [F.size(G.parts(p)).alias("n_parts"), F.when(F.col("type") != "MultiLineString", G.area(p)).alias("area"), G.contains(p, F.lit(57.5), F.lit(5.0)).alias("holds"), F.round(G.line_distance(F.lit(-5.0), F.lit(0.0), p), 6).alias("gap")]
    return read_features(spark, path).select(F.col("properties")["id"].cast("int").alias("id"), "type", *shape)


def points_read(spark, sf_dir):
    path = shared_dir(spark)
    _points(spark, sf_dir).write.option("header", True).csv(path)
    return read_points(spark, path, "id bigint, x double, y double")


# Layer building --------------------------------------------------------------


def layer_file(spark, sf_dir):
    """Masks from land, layers with a rasterized source, dry costs and a merge, built into a new store."""
    store = Store(spark, shared_dir(spark)).create(GRID)
    layer_files.write_masks(store, _zones(spark, sf_dir))
    specs = [
        L.Layer("land", [L.Component("c1", extent="dry", pass_through=True), L.Component(global_value=3, extent="landfall"), L.Component("parks", rasterize=5.0, all_touched=True)]),
        L.Layer("sea", [L.Component("c2", extent="wet+", pass_through=True)]),
        L.Layer("friction", [L.Component("fric", pass_through=True)]),
    ]
    plan = layer_files.Plan(specs, layer_files.DryCosts(), layer_files.Merge("friction", "sea", "merged"))
    parks = _regions(spark, sf_dir).select(F.col("rid").alias("id"), "ring")
    layer_files.build(store, plan, _cells(spark, sf_dir), shapes={"parks": parks}, validate_masks=True)
    return store.cells(["land", "sea", "merged", "dry_multipliers", "wet_mask", "dry_mask", "landfall_mask"])


def _built(spark, sf_dir, *specs, extent=None, cell=90.0):
    c = _cells(spark, sf_dir)
    return L.build(c, list(specs), extent, cell).select("row", "col", *[s.name for s in specs])


def _extent():
    land = F.col("slope") > 3
    return L.masks(land, land & (F.col("slope") < 6))


def layer_bins(spark, sf_dir):
    bins = [L.Bin(1, max=20), L.Bin(5, 10, 50), L.Bin(9, 50)]
    return _built(spark, sf_dir, L.Layer("v", [L.Component("c1", bins=bins)]))


def layer_map(spark, sf_dir):
    return _built(spark, sf_dir, L.Layer("v", [L.Component("nlcd", map={11: 3, 24: 7.5, 90: 1})]))


def layer_extents(spark, sf_dir):
    specs = [L.Layer("e_" + e.replace("+", "p"), [L.Component(global_value=2, extent=e), L.Component("c1", extent=e, pass_through=True)]) for e in L.EXTENTS]
    return _built(spark, sf_dir, *specs, extent=_extent())


def layer_fill(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("gap", F.when(F.col("zone") == 1, F.lit(float("nan")).cast("float")).when(F.col("zone") == 2, F.lit(None).cast("float")).otherwise(F.col("c1")))
    return L.build(c, [L.Layer("v", [L.Component("gap", pass_through=True, na_fill=-5)])]).select("row", "col", "v")


def layer_forced_inclusion(spark, sf_dir):
    return _built(spark, sf_dir, L.Layer("v", [L.Component("c1", pass_through=True), L.Component(global_value=1, extent="wet"), L.Component("barrier", forced_inclusion=True)]), extent=_extent())


def layer_cost_per_mile(spark, sf_dir):
    return _built(spark, sf_dir, L.Layer("v", [L.Component("c1", map={k: 1609.344 * k for k in range(1, 98)})], values_are_costs_per_mile=True), cell=2.0)


def layer_masks(spark, sf_dir):
    return _cells(spark, sf_dir).select("row", "col", *[m.cast("int").alias(k.replace("+", "_plus")) for k, m in _extent().items()])


def layer_stored_masks(spark, sf_dir):
    m = L.stored_masks(F.col("c2") % 2, F.col("zone"), F.col("barrier"))
    return _cells(spark, sf_dir).select("row", "col", *[x.cast("int").alias(k.replace("+", "_plus")) for k, x in m.items()])


def dry_multipliers(spark, sf_dir):
    default = {"land_use": {"forest": 1.25}, "slope": {"hill_mult": 1.5, "hill_slope": 2, "mtn_mult": 3, "mtn_slope": 8}}
    c = _cells(spark, sf_dir).withColumn("iso", F.col("iso") + (F.col("col") % 2))
    return c.select("row", "col", L.dry_multiplier(F.col("iso"), F.col("nlcd"), F.col("slope"), default=default).alias("m"))


def dry_tie_line_costs(spark, sf_dir):
    out = L.dry_costs(_cells(spark, sf_dir), 90.0, mask=F.col("barrier") == 0)
    names = [c for c in out.columns if c.startswith("tie_line")]
    return out.select("row", "col", *[F.round(F.col(c).cast("double"), 0).alias(c) for c in names])


def friction_and_barriers(spark, sf_dir):
    return _cells(spark, sf_dir).select("row", "col", L.friction_and_barriers(F.col("fric"), F.col("barrier")).alias("v"))


# Scenarios -------------------------------------------------------------------

SCENARIO = {
    "routing_options": {
        "overhead": {
            "cost_layers": [{"layer_name": "c1", "multiplier_layer": "c2", "multiplier_scalar": 0.5}, {"layer_name": "slope"}, {"layer_name": "inv", "is_invariant": True}],
            "friction_layers": [{"multiplier_layer": "fric", "multiplier_scalar": 2}],
            "barrier_layers": [{"layer_name": "zone", "where": ">=3", "barrier_importance": 2}, {"layer_name": "nlcd", "where": "==24", "barrier_importance": 1}],
        },
        "underground": {
            "cost_layers": [{"layer_name": "c1", "multiplier_scalar": 4, "include_in_final_cost": False}, {"layer_name": "c2"}, {"layer_name": "inv", "is_invariant": True, "multiplier_scalar": 2}],
            "barrier_layers": [{"layer_name": "barrier", "where": "> 0"}],
            "cost_multiplier_layer": "c2",
            "cost_multiplier_scalar": 3,
        },
    },
    "drivers": {"default": {"overhead": 1, "underground": 2}, "zones": [{"layer_name": "slope", "where": "<4", "options": {"overhead": 1.5, "underground": "excluded"}}, {"layer_name": "slope", "where": "<2", "options": {"underground": 0.5}}]},
    "transition_costs": {"default": 10, "pairwise": [{"between": ["overhead", "underground"], "cost": 25.5}]},
}


def scenario_surface(spark, sf_dir):
    return P.surface(_cells(spark, sf_dir), P.Scenario.from_json(SCENARIO))


def scenario_final_layers(spark, sf_dir):
    s = P.Scenario.from_json({"routing_options": {k: {**v, "cost_layers": v["cost_layers"][:2]} for k, v in SCENARIO["routing_options"].items()}})
    return P.final_layers(_cells(spark, sf_dir), s)


def scenario_report_costs(spark, sf_dir):
    s, c = P.Scenario.from_json(SCENARIO), _cells(spark, sf_dir)
    parts = [c.select("row", "col", F.lit(n).alias("option_name"), *[x.alias(k) for x, k in zip(P.report_costs(s, n), ("cost", "li_cost"))]) for n in s.names]
    return parts[0].unionByName(parts[1])


def scenario_soft_invalid_costs(spark, sf_dir):
    s = P.Scenario.from_json({"routing_options": {"o": {"cost_layers": [{"layer_name": "slope"}]}}, "invalid_costs_block_routing": False})
    return P.surface(_cells(spark, sf_dir), s).select("row", "col", F.col("cost").cast("double").alias("cost"))


VOLTAGES = {"routing_options": {"o": {"cost_layers": [{"layer_name": "c1", "apply_row_mult": True}, {"layer_name": "slope", "apply_polarity_mult": True}]}, "p": {"cost_layers": [{"layer_name": "c2", "apply_row_mult": True}]}}}


def scenario_for_voltage(spark, sf_dir):
    s = P.for_voltage(P.Scenario.from_json(VOLTAGES), {"o": 138, "p": 500}, {"o": "ac", "p": "dc"}, {"138": 2, "500": {"fric": 0.5, "inv": 3}}, {"138": {"ac": 4000, "dc": 1}})
    return P.surface(_cells(spark, sf_dir), s).select("row", "col", "option", "cost")


def where_predicates(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("v", F.when(F.col("zone") == 1, F.lit(float("nan")).cast("float")).when(F.col("zone") != 2, F.col("c1")))
    return c.select("row", "col", *[X.where(F.col("v"), f"{op}40").alias(n) for n, op in zip(("gt", "ge", "lt", "le", "eq", "ne"), (">", ">=", "<", "<=", "==", "!="))])


# Search ----------------------------------------------------------------------

PLAIN = {"routing_options": {"o": {"cost_layers": [{"layer_name": "c1"}]}}}
TWO = {
    "routing_options": {"a": {"cost_layers": [{"layer_name": "c1"}, {"layer_name": "inv", "is_invariant": True}]}, "b": {"cost_layers": [{"layer_name": "c1", "multiplier_scalar": 0.25}, {"layer_name": "c2", "is_invariant": True}], "barrier_layers": [{"layer_name": "zone", "where": "==3"}]}},
    "transition_costs": {"default": 12.5},
}
SOFT = {"routing_options": {"o": {"cost_layers": [{"layer_name": "c2"}], "barrier_layers": [{"layer_name": "wall", "where": ">=2", "barrier_importance": 5}, {"layer_name": "wall", "where": "==1", "barrier_importance": 3}]}}}


def neighbour_cells(spark, sf_dir):
    n = search.neighbours(_cells(spark, sf_dir).select("row", "col"))
    return n.where(F.col("n_row").between(0, N - 1) & F.col("n_col").between(0, N - 1))


def routing_edges(spark, sf_dir):
    s = P.Scenario.from_json(TWO)
    return search.edges(P.surface(_small(spark, sf_dir), s), s)


def _edges(spark, sf_dir, config, n=16):
    s = P.Scenario.from_json(config)
    e = search.edges(P.surface(_cells(spark, sf_dir, n), s), s)
    k = len(s.names)
    return e.select(search.slot(F.col("row"), F.col("col"), F.col("option"), n, k).alias("src"), search.slot(F.col("n_row"), F.col("n_col"), F.col("n_option"), n, k).alias("dst"), "w")


def least_distances(spark, sf_dir):
    source = spark.createDataFrame([(0, 0), (1, 43)], "id int, node long")
    return search.distances(_edges(spark, sf_dir, PLAIN, 8), source)


def meeting_cost(spark, sf_dir):
    e = _edges(spark, sf_dir, PLAIN, 8)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    forward = search.distances(e, spark.createDataFrame([(0, 0)], "id int, node long"))
    return search.meeting(forward, search.distances(back, spark.createDataFrame([(0, 63)], "id int, node long"))).select("id", "total")


def _ends(rows, spark):
    return spark.createDataFrame(rows, "route_id int, row int, col int, option int")


def _found(spark, sf_dir, config, starts, ends, n=N, cells=None, tile=search.TILE, name="long_range_dijkstra"):
    s = P.Scenario.from_json(config)
    return search.find_paths(_cells(spark, sf_dir, n) if cells is None else cells, s, _ends(starts, spark), _ends(ends, spark), n, tile, name)


def shortest_paths(spark, sf_dir):
    starts = [(0, 0, 0, 0), (0, 5, 30, 0), (1, 31, 0, 0), (2, 7, 7, 0)]
    ends = [(0, 31, 31, 0), (0, 16, 8, 0), (1, 0, 31, 0), (2, 7, 7, 0), (2, 9, 9, 0)]
    found, _ = _found(spark, sf_dir, PLAIN, starts, ends)
    return found.select("route_id", "start_row", "start_col", "cost_units")


def shortest_paths_both_ends(spark, sf_dir):
    """Two routes over tiles well below the grid's side, searched from their starts and from all their ends."""
    starts, ends = [(0, 0, 0, 0), (1, 31, 0, 0)], [(0, 31, 31, 0), (1, 0, 31, 0)]
    found, _ = _found(spark, sf_dir, PLAIN, starts, ends, tile=8, name="bidirectional_long_range_dijkstra")
    return found.select("route_id", "end_row", "end_col", "cost_units")


def shortest_paths_by_tiles(spark, sf_dir):
    found, steps = _found(spark, sf_dir, PLAIN, [(0, 0, 0, 0), (1, 31, 0, 0)], [(0, 31, 31, 0), (1, 0, 31, 0)], tile=16)
    # The cost of a path, added up anew from its steps.
    w = reports._order(["route_id"])
    c = _cells(spark, sf_dir).select("row", "col", "c1")
    moves = steps.join(c, ["row", "col"]).withColumn("p", F.lag("c1").over(w)).withColumn("pr", F.lag("row").over(w)).withColumn("pc", F.lag("col").over(w))
    corner = (F.col("row") != F.col("pr")) & (F.col("col") != F.col("pc"))
    half = F.when(corner, X.single(float(search.CORNER))).otherwise(X.single(0.5))
    units = moves.groupBy("route_id").agg(F.sum(X.fixed_point(half * (F.col("p") + F.col("c1")))).alias("along"))
    return found.join(units, "route_id").select("route_id", "cost_units", "along")


def option_paths(spark, sf_dir):
    found, _ = _found(spark, sf_dir, TWO, [(0, 0, 0, 0), (1, 0, 15, 1)], [(0, 15, 15, 1), (1, 15, 0, 0)], 16)
    return found.select("route_id", "cost_units")


def _walled(spark, sf_dir):
    wall = F.when(F.col("row") == 8, F.when(F.col("col") == 3, 1).otherwise(2)).when(F.col("row") == 4, F.lit(1)).otherwise(0)
    return _small(spark, sf_dir).withColumn("wall", wall.cast("float"))


def soft_barrier_paths(spark, sf_dir):
    found, _ = _found(spark, sf_dir, SOFT, [(0, 0, 0, 0), (1, 5, 5, 0), (2, 9, 0, 0), (3, 1, 1, 0)], [(0, 6, 6, 0), (1, 15, 15, 0), (2, 15, 15, 0), (3, 2, 9, 0)], 16, _walled(spark, sf_dir))
    return found.select("route_id", "cost_units", F.size("dropped").alias("dropped"))


# Reports ---------------------------------------------------------------------


def _steps(spark, sf_dir) -> DataFrame:
    """Events by user as steps of a route on the grid."""
    e = _t(spark, sf_dir, "events")
    step = F.row_number().over(reports.Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("route_id"), step.alias("step"), (F.col("event_id") % N).cast("int").alias("row"), ((F.col("event_id") * 7 + F.col("user_id")) % N).cast("int").alias("col"), (F.length("event_type") % 2).alias("option"))


def route_travel_lengths(spark, sf_dir):
    m = reports.travel_lengths(_steps(spark, sf_dir), ["route_id"])
    return m.select("route_id", "step", F.round("len", 9).alias("len"))


def _measured(spark, sf_dir):
    return reports.travel_lengths(_steps(spark, sf_dir), ["route_id"])


REPORT = {"routing_options": {"even": {"cost_layers": [{"layer_name": "c1", "multiplier_layer": "c2"}, {"layer_name": "inv", "is_invariant": True}]}, "odd": {"cost_layers": [{"layer_name": "c2"}], "cost_multiplier_scalar": 2}}, "transition_costs": {"default": 3, "pairwise": [{"between": ["odd", "even"], "cost": 4.5}]}}


def route_option_costs(spark, sf_dir):
    m = reports.option_metrics(_measured(spark, sf_dir), _cells(spark, sf_dir), P.Scenario.from_json(REPORT), ["route_id"], GRID)
    return m.select("route_id", "option_name", F.round("cost", 4).alias("cost"), F.round("length_km", 6).alias("length_km"))


def route_transition_costs(spark, sf_dir):
    return reports.transition_costs(_steps(spark, sf_dir), P.Scenario.from_json(REPORT), ["route_id"])


def route_layer_totals(spark, sf_dir):
    out = reports.layer_along(_measured(spark, sf_dir), _cells(spark, sf_dir), F.col("slope"), ["route_id"], GRID)
    inv = reports.layer_along(_measured(spark, sf_dir), _cells(spark, sf_dir), F.col("slope"), ["route_id"], GRID, invariant=True)
    return out.join(inv.select("route_id", F.col("cost").alias("inv_cost")), "route_id").select("route_id", F.round(F.col("cost").cast("double"), 1).alias("cost"), F.round(F.col("length_km").cast("double"), 2).alias("length_km"), F.col("inv_cost").cast("double").alias("inv_cost"))


def route_layer_aggregates(spark, sf_dir):
    m, c, out = _steps(spark, sf_dir).withColumn("len", F.lit(1.0)), _cells(spark, sf_dir), None
    for method in ("mean", "min", "max", "sum", "std"):
        found = reports.layer_along(m, c, F.col("c1"), ["route_id"], GRID, method=method).withColumn(method, F.round(F.col(method).cast("double"), 2))
        out = found if out is None else out.join(found, "route_id")
    return out


def route_sampled_layers(spark, sf_dir):
    return reports.sampled(_steps(spark, sf_dir), _cells(spark, sf_dir), ["c1", "nlcd"])


def _started(spark, sf_dir) -> DataFrame:
    s = _steps(spark, sf_dir)
    first = lambda c: F.first_value(c).over(reports._order(["route_id"])).alias(f"start_{c}")
    return s.select("*", *map(first, ("row", "col", "option")))


def route_report(spark, sf_dir):
    steps = _started(spark, sf_dir)
    found = steps.select(*KEYS, F.when(F.col("route_id") % 2 == 0, F.array(F.lit("wall"))).otherwise(F.array().cast("array<string>")).alias("dropped")).distinct()
    people = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route_id"), "c_mktsegment")
    r = reports.route_table(found, steps, _cells(spark, sf_dir), P.Scenario.from_json(REPORT), GRID, people)
    exact = [F.round(F.col(c).cast("double"), 4).alias(c) for c in ("cost", "even_cost", "odd_cost")] + [F.round(F.col(c).cast("double"), 6).alias(c) for c in ("length_km", "odd_length_km")]
    return r.select(*KEYS, *exact, F.col("inv_even_cost").cast("double").alias("inv_even_cost"), "total_transition_costs", "poi_lat", "poi_lon", "dropped_barrier_layers", "c_mktsegment")


def route_companion(spark, sf_dir):
    m, c, s = _measured(spark, sf_dir), _cells(spark, sf_dir), P.Scenario.from_json(REPORT)
    by_option = reports.option_metrics(m, c, s, ["route_id"], GRID).select("route_id", "option_name", F.round("length_km", 6).alias("length_km"))
    flat = m.where("option = 0").withColumn("routing_option", F.lit("even"))
    inv = reports.layer_along(flat, c, F.col("inv"), ["route_id", "routing_option"], GRID, invariant=True).select("route_id", "routing_option", F.col("cost").cast("double").alias("cost"))
    return reports.companion(by_option, [("Inv. layer", inv)], ["route_id", "routing_option"])


def route_segments(spark, sf_dir):
    return reports.segments(_steps(spark, sf_dir), ["route_id"])


def route_turns(spark, sf_dir):
    return reports.simplified(_unit_steps(spark, sf_dir), ["route_id"])


def _unit_steps(spark, sf_dir):
    """Walks of single steps: runs of one direction by event."""
    w = reports.Window.partitionBy("route_id").orderBy("step")
    s = _steps(spark, sf_dir).withColumn("d", F.expr("(row div 5) % 3"))
    down, right = F.sum((F.col("d") != 1).cast("int")).over(w), F.sum((F.col("d") != 2).cast("int")).over(w)
    return s.select("route_id", "step", down.cast("int").alias("row"), right.cast("int").alias("col"), "option")


def route_wkt(spark, sf_dir):
    return reports.wkt(_steps(spark, sf_dir), ["route_id"], GRID)


def route_files(spark, sf_dir):
    """Routes and their lines by option through the two files of a writer."""
    steps = _steps(spark, sf_dir)
    by_option = reports.option_wkt(reports.segments(steps, ["route_id"]), ["route_id"], GRID)
    paths = reports.write_routes(reports.wkt(steps, ["route_id"], GRID), by_option, f"{shared_dir(spark)}/routes.parquet", "wkt")
    whole, parts = map(spark.read.parquet, paths)
    return whole.select("route_id", F.lit(-1).alias("option"), "wkt").unionByName(parts.select("route_id", "option", "wkt"))


# Route tables ----------------------------------------------------------------


def _routes(spark, sf_dir) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("route_id"), (F.col("o_orderkey") % N).cast("int").alias("start_row"), (F.col("o_custkey") % N).cast("int").alias("start_col"), ((F.col("o_orderkey") + 7) % 8).cast("int").alias("end_row"), (F.col("o_custkey") % 5).cast("int").alias("end_col"),
        F.col("o_orderpriority").alias("voltage"), F.col("o_orderstatus").alias("polarity"), F.col("o_totalprice").alias("price"),
    )


def _places(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", (F.col("c_custkey") * 31 % 4000).cast("double").alias("start_lon"), (F.col("c_custkey") * 17 % 4000 - 500).cast("double").alias("start_lat"), (F.col("c_custkey") * 13 % 3000).cast("double").alias("end_lon"), (F.col("c_custkey") * 11 % 3000).cast("double").alias("end_lat"))


def route_points_on_grid(spark, sf_dir):
    return route_tables.mapped(_places(spark, sf_dir), GRID).select("c_custkey", "start_row", "start_col", "end_row", "end_col")


def route_supply_points(spark, sf_dir):
    """Supply points of a grid that has a cell for each customer, with the customers in their squares."""
    c = _t(spark, sf_dir, "customer")
    last = c.agg(F.max("c_custkey")).first()[0] or 0
    points = route_tables.supply_points(spark, Grid(last // 52 + 1, 52, a=2.0, c=10.0, e=-2.0, f=90.0), 10)
    at = [F.expr("cast(c_custkey div 520 as int)").alias("sc_row_ind"), F.expr("cast(c_custkey % 52 div 10 as int)").alias("sc_col_ind")]
    return points.join(c.groupBy(*at).agg(F.count("*").alias("customers")), ["sc_row_ind", "sc_col_ind"], "left").na.fill(0, ["customers"])


def route_valid_nodes(spark, sf_dir):
    surf = P.surface(_cells(spark, sf_dir), P.Scenario.from_json(SCENARIO))
    nodes = _routes(spark, sf_dir).select("route_id", F.col("start_row").alias("row"), F.col("start_col").alias("col"), (F.col("route_id") % 2).cast("int").alias("option"))
    return route_tables.valid_nodes(nodes, surf).select("route_id", "row", "col", "option")


def route_remaining(spark, sf_dir):
    r = _routes(spark, sf_dir).select("route_id", "start_row", "start_col", "voltage")
    return route_tables.remaining(r, r.where("route_id % 3 = 0 OR start_row < 4"), ["start_row", "start_col", "voltage"])


def route_definitions(spark, sf_dir):
    d = route_tables.definitions(_routes(spark, sf_dir), ["end_row", "end_col"])
    return d.select(F.col("route_id").cast("int").alias("route_id"), "end_row", "end_col", F.size("starts").alias("n_starts"), "reversed")


def route_combinations(spark, sf_dir):
    r = route_tables.with_defaults(_routes(spark, sf_dir).select("route_id", "voltage"), ["a", "b"])
    return route_tables.combinations(r, ["a", "b"])


def route_voltage_product(spark, sf_dir):
    return route_tables.voltage_product(_t(spark, sf_dir, "nation").select("n_nationkey"), [138, 230, 500], None)


def route_subset(spark, sf_dir):
    return route_tables.subset(_routes(spark, sf_dir).select("route_id", "start_row", "start_col"), 1, 4, ["start_row", "start_col", "route_id"])


def route_numbers(spark, sf_dir):
    return route_tables.numbered(_routes(spark, sf_dir).select("route_id", "start_row"), "rid", ["start_row", "route_id"], first=100)


def route_feature_pairs(spark, sf_dir):
    return route_tables.feature_pairs(_t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey")


def _regions(spark, sf_dir) -> DataFrame:
    r, k = _t(spark, sf_dir, "region"), F.col("r_regionkey")
    return r.select(k.alias("rid"), G.box(k % 3 * 900.0, k % 2 * 1500.0, k % 3 * 900.0 + 600.0, k % 2 * 1500.0 + 800.0).alias("ring"))


def _points(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 2880).cast("double").alias("x"), (F.col("c_custkey") * 53 % 2880).cast("double").alias("y"))


def nearest_region(spark, sf_dir):
    return route_tables.nearest_region(_points(spark, sf_dir), _regions(spark, sf_dir)).select("id", "rid", F.round("distance", 6).alias("distance"))


def within_region(spark, sf_dir):
    return route_tables.within_region(_points(spark, sf_dir), _regions(spark, sf_dir))


def within_radius(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    f = s.select(F.col("s_suppkey").alias("feature"), (F.col("s_suppkey") * 97 % 2880).cast("double").alias("fx"), (F.col("s_suppkey") * 61 % 2880).cast("double").alias("fy"))
    return route_tables.within_radius(_points(spark, sf_dir), f, 60.0).select("id", "feature", F.round("distance", 6).alias("distance"), F.round("radius", 6).alias("radius"))


def route_resumed(spark, sf_dir):
    r = _routes(spark, sf_dir)
    return route_tables.resumed(r.select("route_id", "start_row", "start_col"), r.where("route_id % 2 = 0").select("start_row", "start_col", "route_id", "price"), ["start_row", "start_col"], "route_id", ["price"])


def tidy_features(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("gid"), F.lit(1).alias("bgid"), F.lit(2).alias("egid"), F.lit(0.5).alias("cap_left"), F.when(F.col("s_nationkey") % 3 != 0, F.concat(F.lit("c"), F.col("s_nationkey"))).alias("category"))
    return route_tables.tidy_features(s)


def points_with_features(spark, sf_dir):
    return route_tables.points_with_features(_points(spark, sf_dir).select("id"), _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


# Finalize --------------------------------------------------------------------


def _lengths(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("cost"), ((F.col("o_orderkey") % 2000) / 100.0).alias("length_km"))


def length_multiplier_step(spark, sf_dir):
    return finalize.with_length_multiplier(_lengths(spark, sf_dir), "step")


def length_multiplier_linear(spark, sf_dir):
    f = finalize.with_length_multiplier(_lengths(spark, sf_dir), "linear")
    return f.withColumn("length_mult", F.round("length_mult", 9)).withColumn("cost", F.round("cost", 4))


def length_floor(spark, sf_dir):
    return finalize.with_length_floor(_lengths(spark, sf_dir), 5.7)


def finalized_routes(spark, sf_dir):
    return finalize.finalized(_lengths(spark, sf_dir), "step", 5.7).withColumn("cost", F.round(F.col("cost") / 7, 3))


def routes_with_features(spark, sf_dir):
    cells = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 8).cast("int").alias("row"), (F.col("s_suppkey") % 3).cast("int").alias("col"), F.col("s_suppkey").alias("trans_gid"))
    features = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("trans_gid"), F.col("s_nationkey").alias("price"))
    return finalize.with_features(_routes(spark, sf_dir).select("route_id", "end_row", "end_col", "price"), cells, features, "trans_gid")


def route_end_features(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    lines = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("trans_gid"), F.array(G.point(k * 37 + 11, F.lit(2300.0)), G.point(k * 37 + 11, k * 20 + 2300)).alias("points"), F.col("n_name").alias("line"))
    routes = _routes(spark, sf_dir).select("route_id", "end_row", "end_col")
    return finalize.with_features(routes, finalize.end_cells(routes, lines, "trans_gid", GRID), lines.drop("points"), "trans_gid")


def dissolved_features(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("gid"), F.concat(F.lit("line "), F.col("s_suppkey") % 3).alias("category"), F.concat(F.lit("POINT ("), F.col("s_suppkey") % 60, F.lit(" 0)")).alias("wkt"))
    return finalize.dissolved(s, "gid").select("gid", "category", "wkt")


# Zonal statistics -------------------------------------------------------------


def _zones(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = k % 5 * 500.0 + 33.0, F.floor(k / 5) * 600.0 - 107.0
    return _t(spark, sf_dir, "nation").select(k.alias("id"), G.box(x, y, x + 700.0, y + 410.0).alias("ring"))


def zonal_basic(spark, sf_dir):
    z = zonal.zonal(_zones(spark, sf_dir), _cells(spark, sf_dir), "slope", GRID, "count min max mean sum std median unique range nodata", nodata=12)
    return z.withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


def zonal_centre_rule(spark, sf_dir):
    return zonal.zonal(_zones(spark, sf_dir), _cells(spark, sf_dir), "c2", GRID, "count sum", all_touched=False, prefix="c2_")


def zonal_percentiles(spark, sf_dir):
    z = zonal.zonal(_zones(spark, sf_dir), _cells(spark, sf_dir), "c1", GRID, ["percentile_10.5", "percentile_90"])
    return z.select("id", F.round("`percentile_10.5`", 6).alias("p10"), F.round("percentile_90", 6).alias("p90"))


def zonal_majority(spark, sf_dir):
    names = {0: "flat", 5: "mid", 6: "mid"}
    return zonal.zonal(_zones(spark, sf_dir), _cells(spark, sf_dir), "slope", GRID, ["majority", "minority"], categories=names)


def zonal_pixel_count(spark, sf_dir):
    z = zonal.zonal(_zones(spark, sf_dir), _cells(spark, sf_dir), "zone", GRID, ["pixel_count"], categories={0: "zero", 1: "one", 2: "two", 3: "three"})
    return zonal.flattened(z, "pixel_count", ["zero", "one", "two", "three"])


def zonal_fractional(spark, sf_dir):
    z = zonal.zonal(_zones(spark, sf_dir), _cells(spark, sf_dir), "zone", GRID, ["fractional_pixel_count", "fractional_area", "value_multiplied_by_fractional_area"], categories={0: "zero", 1: "one", 2: "two", 3: "three"})
    z = zonal.flattened(zonal.flattened(z, "fractional_pixel_count", ["one", "two"]), "fractional_area", ["three"])
    return z.select("id", *[F.round(c, 5).alias(c) for c in z.columns if c != "id"])


def zonal_zone_func(spark, sf_dir):
    return zonal.zonal(_zones(spark, sf_dir), _cells(spark, sf_dir), "c2", GRID, "sum", zone_func=lambda v: v * 2 + 1)


def zonal_user_stats(spark, sf_dir):
    return zonal.user_stats(_zones(spark, sf_dir), _cells(spark, sf_dir), "c2", GRID, {"spread": lambda f: f["value"].max() - f["value"].min(), "last": lambda f: f["value"].iloc[-1]})


def rasterized_boxes(spark, sf_dir):
    k = F.col("n_nationkey")
    return zonal.rasterized(_zones(spark, sf_dir).select("id", "ring", (F.col("id") * 1.5).alias("value"), F.col("id").alias("order")), GRID, all_touched=True)


def buffered_line_cells(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    lines = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array(G.point(k * 80 + 100, F.lit(300.0)), G.point(k * 80 + 100, k * 60 + 700)).alias("points"), zonal.half_width(k, {3: 500.0, 7: 200.0}, [{"min": 0, "max": 10, "width": 300.0}, {"min": 10, "max": 20, "width": 420.0}]).alias("half_width"))
    return zonal.line_cells(lines.where("half_width IS NOT NULL"), GRID)


def route_characterized(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    lines = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array(G.point(k * 80 + 100, F.lit(300.0)), G.point(k * 80 + 100, k * 60 + 700)).alias("points"), k.alias("voltage"))
    ranges = [{"min": 0, "max": 10, "width": 300.0}, {"min": 10, "max": 20, "width": 420.0}]
    return zonal.characterized(lines, _cells(spark, sf_dir), "c2", GRID, {3: 500.0, 7: 200.0}, ranges, stats="count sum max")


# Network and lookups -----------------------------------------------------------


def substation_voltages(spark, sf_dir):
    lists = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.sort_array(F.collect_set("l_partkey"))).alias("trans_gids"))
    lines = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("trans_gid"), (F.col("p_size") * 3).alias("voltage"))
    return network.substation_voltages(lists.withColumnRenamed("l_orderkey", "gid"), lines).select("gid", "min_volts", "max_volts")


def substations_of_category(spark, sf_dir):
    """Orders as substations among parts as lines; a column that only lines have goes."""
    lists = _t(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") + 1_000_000_000).alias("gid")).agg(F.to_json(F.sort_array(F.collect_set("l_partkey"))).alias("trans_gids"))
    lines = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("gid"), (F.col("p_size") * 3).alias("voltage"), F.col("p_brand").alias("owner"), F.lit("TransLine").alias("category"))
    return network.substations_of_category(lists.withColumn("category", F.lit("Substation")).unionByName(lines, allowMissingColumns=True)).drop("trans_gids")


def substations_of_connections(spark, sf_dir):
    c = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("poi_gid"), (F.col("o_custkey") % 40 * 1.5 + F.when((F.col("o_custkey") % 40 == 5) & (F.col("o_custkey") % 3 == 0), 0.25).otherwise(0.0)).alias("poi_lat"), F.when(F.col("o_custkey") % 40 != 3, F.lit(7.0)).alias("poi_lon"))
    return network.substations_of_connections(c)


def nodes_with_regions(spark, sf_dir):
    return network.regions_of_nodes(_points(spark, sf_dir), _regions(spark, sf_dir))


def region_centroids(spark, sf_dir):
    return network.region_centroids(_regions(spark, sf_dir)).select("rid", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


def poi_lines(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("XX").alias("state"), F.col("s_nationkey").alias("voltage"), F.col("s_suppkey").alias("x"), F.lit(5).alias("y"))
    return network.poi_lines(s).select("name", "state", "voltage", "category", F.col("points")[1]["x"].alias("x1"))


def transformer_costs(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 12).alias("feature_voltage"), F.element_at(F.array(F.lit(69), F.lit(138), F.lit(500)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("tie_voltage"))
    return Transmission().with_transformer_cost(p)


def substation_costs(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") + 1).alias("region"), F.when(F.col("n_nationkey") % 2 == 0, 138).otherwise(500).alias("voltage"))
    return n.join(F.broadcast(Transmission().substation_costs(spark)), ["region", "voltage"])


def queries() -> dict:
    """All queries of this module."""
    skip = {"queries"}
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in skip}

"""Layers, zones, reports, finalising, stores and streams against small arrays with known results."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterway.errors import ConfigError, LayerExistsError, MissingLayerError
from rasterway.functions import geometry as G
from rasterway.grid import Grid
from rasterway.operators import finalize, network, reports, route_tables, zonal
from rasterway.plans import layer_file
from rasterway.plans import layers as L
from rasterway.plans import scenario as P
from rasterway.plans.lookups import Transmission
from rasterway.sources.store import Store, append, read_features
from rasterway.storage import shared_dir
from rasterway.streaming import requests

RASTER = [[2, 7, 7, 3], [2, 2, 0, 7], [8, 3, 7, 7]]
GRID = Grid(3, 4, a=20.0, c=100.0, e=-20.0, f=60.0)
NAMES = {2: "meadow", 7: "forest", 8: "lake"}


def cells(spark, values, name="v"):
    rows = [(i, j, None if v is None else float(v)) for i, r in enumerate(values) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, f"row int, col int, {name} double")


def array(frame, name):
    rows = frame.orderBy("row", "col").collect()
    out = {}
    for r in rows:
        out.setdefault(r.row, []).append(r[name])
    return list(out.values())


def boxes(spark, *sides):
    z = spark.createDataFrame([(i + 1, *map(float, s)) for i, s in enumerate(sides)], "id int, a double, b double, c double, d double")
    return z.select("id", G.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("ring"))


def test_slope_and_land_use(spark):
    slope = cells(spark, [[2, 12, 25], [0, 10, 40]]).withColumn("m", L.slope_multiplier(F.col("v"), 3, 4, 10, 20))
    assert array(slope, "m") == [[1, 3, 4], [1, 3, 4]]
    land = cells(spark, [[5, 6], [7, 5], [8, 9]]).withColumn("m", L.land_use_multiplier(F.col("v"), {"grass": 1.25, "rock": 3}, {"grass": [5], "rock": [6, 8]}))
    assert array(land, "m") == [[1.25, 3], [1, 1.25], [3, 1]]
    with pytest.raises(ConfigError):
        L.land_use_multiplier(F.col("v"), {"sand": 2}, {"grass": [5]})


def test_layers_check_their_definitions(spark):
    with pytest.raises(ConfigError):
        L.Component("v", global_value=1, pass_through=True).check()
    with pytest.raises(ConfigError):
        L.check_bins([L.Bin(1, 5, 2)])
    with pytest.warns(UserWarning, match="overlap"):
        L.check_bins([L.Bin(1, max=3), L.Bin(2, 2)])
    gap = cells(spark, [[1, None, float("nan")]])
    built = L.build(gap, [L.Layer("x", [L.Component("v", pass_through=True, na_fill=7)])])
    assert array(built, "x") == [[1, 7, 7]]


def overlaps(side):
    """(value, share of the cell) of every cell that a box meets, cell by cell."""
    a, b, c, d = side
    out = []
    for i, row in enumerate(RASTER):
        for j, v in enumerate(row):
            x, y = GRID.c + j * GRID.a, GRID.f + (i + 1) * GRID.e
            w, h = min(c, x + 20) - max(a, x), min(d, y + 20) - max(b, y)
            if w > 0 and h > 0:
                out.append((v, w * h / 400))
    return out


def test_zonal_statistics(spark):
    sides = [(101, 41, 119, 59), (105, 5, 151, 33), (103, 1, 178, 58), (161, 22, 179, 38), (500, 500, 510, 510), (133, 27, 135, 29)]
    out = zonal.zonal(boxes(spark, *sides), cells(spark, RASTER), "v", GRID, "*", nodata=0, categories=NAMES)
    got = {r.id: r for r in out.collect()}
    name = lambda v: NAMES.get(v, str(float(v)))
    for k, side in enumerate(sides, 1):
        hits, r = overlaps(side), got[k]
        values = [v for v, _ in hits if v != 0]
        shares = {}
        for v, part in hits:
            if v != 0:
                shares[name(v)] = shares.get(name(v), 0) + part
        assert (r["count"], r.nodata or 0) == (len(values), len(hits) - len(values))
        assert r.pixel_count == {n: sum(name(v) == n for v in values) for n in shares}
        if not values:
            assert (r.mean, r.min, r.value_multiplied_by_fractional_area) == (None, None, None)
            continue
        assert (r.min, r.max, r["sum"], r.unique, r.range) == (min(values), max(values), sum(values), len(set(values)), max(values) - min(values))
        assert np.allclose([r.mean, r.std, r.median], [np.mean(values), np.std(values), np.median(values)])
        often = Counter(values).most_common()
        if len(often) == 1 or often[0][1] > often[1][1]:
            assert r.majority == name(often[0][0])
        if len(often) == 1 or often[-1][1] < often[-2][1]:
            assert r.minority == name(often[-1][0])
        assert np.isclose(r.value_multiplied_by_fractional_area, sum(v * part * 400 for v, part in hits if v != 0))
        assert r.fractional_pixel_count.keys() == shares.keys() and all(np.isclose(r.fractional_pixel_count[n], x) for n, x in shares.items())


def test_statistic_names():
    assert zonal.parse_stats().basic == ["count", "min", "max", "mean"]
    assert zonal.parse_stats("percentile_10.5 sum").percentiles == {"percentile_10.5": 10.5}
    for bad in ("percentile_x", "percentile_101", "mode"):
        with pytest.raises(ConfigError):
            zonal.parse_stats(bad)


def steps(spark, places):
    return spark.createDataFrame([(0, k, i, j, 0) for k, (i, j) in enumerate(places)], "route_id int, step int, row int, col int, option int")


def test_travel_lengths_and_turns(spark):
    m = reports.travel_lengths(steps(spark, [(4, 4), (5, 5), (5, 6)]), ["route_id"])
    root = math.sqrt(2)
    assert np.allclose([r.len for r in m.orderBy("step").collect()], [root / 2, (1 + root) / 2, 0.5])
    assert reports.travel_lengths(steps(spark, [(3, 3)]), ["route_id"]).first().len == 0
    path = steps(spark, [(k, k) for k in range(11)] + [(11, 10)])
    for tolerance in (None, 0.5):
        kept = reports.simplified(path, ["route_id"], tolerance).orderBy("step").collect()
        assert [(r.row, r.col) for r in kept] == [(0, 0), (10, 10), (11, 10)]


def test_length_multipliers(spark):
    mile = 1.609344
    lengths = spark.createDataFrame([(10 * mile + 1,), (10 * mile - 1,), (1.5 * mile,)], "length_km double")
    slope = (1 - 1.5) / (8.5 * mile)
    got = [r.m for r in lengths.select(finalize.length_multiplier(F.col("length_km"), "linear").alias("m")).collect()]
    assert np.allclose(got, [1, 1 - slope, 1.5])
    with pytest.raises(ConfigError):
        finalize.length_multiplier(F.col("length_km"), "cubic")
    floored = finalize.with_length_floor(spark.createDataFrame([(8.0, 2.0), (8.0, 0.0), (8.0, 9.0)], "cost double, length_km double"), 4)
    assert [(r.cost, r.length_km) for r in floored.collect()] == [(16, 4), (8, 4), (8, 9)]


def test_scenarios_are_strict(spark):
    layer = {"layer_name": "v"}
    for bad in ({}, {"routing_options": {}}, {"routing_options": {"a": {"cost_layers": []}}}, {"routing_options": {"a": {"cost_layers": [layer], "color": 1}}}):
        with pytest.raises(ConfigError):
            P.Scenario.from_json(bad)
    with pytest.raises(ConfigError):
        P.BarrierLayer("v", "=> 3")
    s = P.Scenario.from_json({"routing_options": {"a": {"cost_layers": [{"layer_name": "nothing"}]}}})
    with pytest.raises(MissingLayerError):
        P.surface(cells(spark, RASTER), s)


def test_friction_and_barriers(spark):
    config = {"routing_options": {"a": {"cost_layers": [{"layer_name": "v"}], "friction_layers": [{"multiplier_layer": "v", "multiplier_scalar": -1}], "barrier_layers": [{"layer_name": "v", "where": "==3", "barrier_importance": 2}, {"layer_name": "v", "where": ">=8"}, {"layer_name": "v", "where": "==7", "barrier_importance": 1}]}}}
    surf = P.surface(cells(spark, RASTER), P.Scenario.from_json(config))
    assert array(surf, "soft_rank") == [[0, 1, 1, 2], [0, 0, 0, 1], [0, 2, 1, 1]]
    assert array(surf, "hard") == [[False] * 4, [False] * 4, [True] + [False] * 3]
    # Friction takes the whole cost away; a cell without a cost stays without one.
    assert all(c is None if v == 0 else 0 < c < 1e-5 for r, values in zip(array(surf, "cost"), RASTER) for c, v in zip(r, values))


def test_store(spark):
    store = Store(spark, shared_dir(spark)).create(GRID)
    store.write("v", cells(spark, RASTER))
    with pytest.raises(LayerExistsError):
        store.write("v", cells(spark, RASTER))
    with pytest.raises(LayerExistsError):
        Store(spark, store.path).create(GRID)
    assert array(store.cells(["v"]), "v") == RASTER
    with pytest.raises(MissingLayerError):
        store.cells(["w"])
    store.delete("v")
    assert "v" not in store.layers()


def test_requests_as_a_stream(spark):
    base = shared_dir(spark)
    schema = "route_id int, start int"
    spark.createDataFrame([(1, 5), (2, 6), (2, 6)], schema).write.parquet(f"{base}/in")
    search = lambda df: df.withColumn("cost", F.col("start") * 2)
    for k in range(2):
        requests.serve(requests.requests(spark, f"{base}/in", schema), search, f"{base}/out", ["route_id"], f"{base}/state{k}").awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{base}/out").collect())) == [(1, 5, 10), (2, 6, 12)]


def ring_distance(ring, x, y):
    """(whether inside, 0 inside or else the distance to the nearest side)."""
    inside, gap = False, math.inf
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0
        gap = min(gap, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return inside, 0.0 if inside else gap


def test_regions_and_radii_equal_all_pairs(spark):
    rng = random.Random(11)
    rings = {}
    for k in range(25):
        x, y, w, h = rng.uniform(0, 900), rng.uniform(0, 900), rng.uniform(5, 150), rng.uniform(5, 400 if k == 3 else 60)
        rings[k] = [(x, y), (x + w, y + h / 3), (x + w / 2, y + h), (x, y)]
    places = {i: (rng.uniform(-50, 1050), rng.uniform(-50, 1050)) for i in range(150)} | {150: (90_000.0, -70_000.0), 151: rings[4][0], 152: (rings[7][1])}
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in places.items()] + [(900, None, 1.0), (901, float("nan"), 2.0)], "id int, x double, y double")
    regions = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in rings.items()], "rid int, ring array<struct<x:double,y:double>>")
    both = {i: {k: ring_distance(r, *p) for k, r in rings.items()} for i, p in places.items()}
    gap = {i: {k: d for k, (_, d) in x.items()} for i, x in both.items()}
    got = {r.id: (r.rid, r.distance) for r in route_tables.nearest_region(points, regions).collect()}
    assert got.keys() == places.keys()
    assert all(math.isclose(d, min(gap[i].values()), abs_tol=1e-6) and math.isclose(gap[i][k], d, abs_tol=1e-6) for i, (k, d) in got.items())
    assert {tuple(r) for r in route_tables.within_region(points, regions).collect()} == {(i, k) for i in places for k in rings if both[i][k][0]}
    assert route_tables.nearest_region(points, regions.limit(0)).count() == route_tables.within_region(points, regions.limit(0)).count() == 0
    spots = {f: (rng.uniform(0, 400), rng.uniform(0, 1000)) for f in range(40)}
    features = spark.createDataFrame([(f, x, y) for f, (x, y) in spots.items()], "feature int, fx double, fy double")
    want = {}
    for i, (x, y) in places.items():
        far = {f: math.hypot(x - fx, y - fy) for f, (fx, fy) in spots.items()}
        n = max(0, math.ceil((min(far.values()) / 30 - 1) / 0.05 - 1e-9))
        if n <= route_tables.MOST_STEPS:
            want |= {(i, f): 30 * (1 + 0.05 * n) for f, d in far.items() if d <= 30 * (1 + 0.05 * n) + 1e-9}
    got = {(r.id, r.feature): r.radius for r in route_tables.within_radius(points, features, 30.0).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_substations_at_two_places_have_two_rows(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 3.0), (1, 2.5, 3.0), (2, None, 3.0)], "poi_gid int, poi_lat double, poi_lon double")
    assert sorted(map(tuple, network.substations_of_connections(df).collect())) == [(1, 2.0, 3.0), (1, 2.5, 3.0)]


def test_resuming_needs_values(spark):
    table = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    done = spark.createDataFrame([(1, 0, 7), (1, 1, 8), (2, 0, 9), (None, 5, 1)], "k int, n int, v int")
    assert {r.k: r.v for r in route_tables.resumed(table, done, ["k"], "n", ["v"]).collect()} == {1: 8, 2: 9, 3: None}
    with pytest.raises(Exception, match="cannot resume"):
        route_tables.resumed(table, done.withColumn("v", F.when(F.col("k") != 2, F.col("v"))), ["k"], "n", ["v"]).collect()


def test_dissolving_keeps_equal_geometries_and_the_first_attributes(spark):
    df = spark.createDataFrame([(1, "b", 3, "POINT (1 1)"), (1, "a", 9, "POINT (1 1)"), (1, "a", 4, "POINT (0 0)"), (2, None, 1, None)], "gid int, category string, o int, wkt string")
    got = {r.gid: (r.category, r.o, r.wkt) for r in finalize.dissolved(df, "gid").collect()}
    assert got[1] == ("a", 4, "GEOMETRYCOLLECTION (POINT (0 0), POINT (1 1), POINT (1 1))") and got[2][:2] == (None, 1)
    assert {r.gid: r.category for r in finalize.dissolved(df, "gid", order=["o"]).collect()}[1] == "b"


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app-1"

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ConfigError):
        shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://shared/"
    assert shared_dir(Session()).startswith("hdfs://shared/rasterway-app-1/")
    Session.conf.clear()
    Context.master = "local[4]"
    assert "rasterway-app-1" in shared_dir(Session()) and Session.conf["spark.checkpoint.dir"]


def test_a_wrong_table_is_not_an_empty_one(spark):
    base = shared_dir(spark)
    append(spark.createDataFrame([(1, "a")], "k int, v string"), base)
    append(spark.createDataFrame([(2,)], "k int"), base)
    assert sorted(map(tuple, spark.read.parquet(base).collect()), key=str) == [(1, "a"), (2, None)]


def test_shapes_of_several_parts(spark, tmp_path):
    outer, hole, other = [(0, 0), (60, 0), (60, 60), (0, 60), (0, 0)], [(20, 20), (40, 20), (40, 40), (20, 40), (20, 20)], [(100, 0), (120, 0), (120, 30), (100, 30), (100, 0)]
    text = lambda r: "(" + ", ".join(f"{x} {y}" for x, y in r) + ")"
    shapes = {
        "POLYGON": f"POLYGON ({text(outer)}, {text(hole)})",
        "MULTIPOLYGON": f"MULTIPOLYGON (({text(outer[::-1])}, {text(hole)}), ({text(other)}))",
        "MULTILINESTRING": f"MULTILINESTRING ({text(outer[:2])}, {text(other[:2])})",
        "POINT": "POINT (3 4)",
    }
    rows = spark.createDataFrame(list(shapes.items()), "kind string, wkt string").withColumn("p", G.parse_wkt(F.col("wkt")))
    got = {r.kind: r for r in rows.select("kind", "p", G.area(F.col("p")).alias("a"), F.size(G.parts(F.col("p"))).alias("n"), G.contains(F.col("p"), F.lit(30.0), F.lit(30.0)).alias("hole"), G.contains(F.col("p"), F.lit(110.0), F.lit(5.0)).alias("far"), G.line_distance(F.lit(80.0), F.lit(0.0), F.col("p")).alias("d"), G.clipped_area(F.col("p"), F.lit(10.0), F.lit(10.0), F.lit(110.0), F.lit(30.0)).alias("cut")).collect()}
    assert {k: (r.a, r.n, r.hole, r.far) for k, r in got.items() if "POLYGON" in k} == {"POLYGON": (3200.0, 2, False, False), "MULTIPOLYGON": (3800.0, 3, False, True)}
    assert (got["MULTILINESTRING"].d, got["MULTILINESTRING"].n, got["POINT"].n, got["POLYGON"].cut, got["MULTIPOLYGON"].cut) == (20.0, 2, 1, 800.0, 1000.0)
    for r in got.values():
        signs = [math.copysign(1, sum(a.x * b.y - b.x * a.y for a, b in zip(part, part[1:]))) for part in _split(r.p)] if "POLYGON" in r.kind else []
        assert signs == {"POLYGON": [1, -1], "MULTIPOLYGON": [1, -1, 1]}.get(r.kind, [])
    path = tmp_path / "shapes.geojsonl"
    path.write_text("\n".join(
        f'{{"type":"Feature","properties":{{"k":"{k}"}},"geometry":{{"type":"{k}","coordinates":{c}}}}}'
        for k, c in {"Polygon": [outer, hole], "MultiPolygon": [[outer[::-1], hole], [other]], "MultiLineString": [outer[:2], other[:2]], "Point": (3, 4), "LineString": outer[:3]}.items()
    ).replace("(", "[").replace(")", "]"))
    read = {r.type.upper(): r.points for r in read_features(spark, str(path)).collect()}
    assert {k: read[k] for k in shapes} == {k: got[k].p for k in shapes} and len(read["LINESTRING"]) == 3


def _split(points):
    out = [[]]
    for p in points:
        out[-1].append(p) if p is not None else out.append([])
    return out


def test_zones_with_holes_over_many_squares(spark):
    grid = Grid(100, 90, a=1.0, c=0.0, e=-1.0, f=100.0)
    ring = "POLYGON ((3.2 4.1, 80.5 7.3, 70.2 95.5, 10.1 88.8, 3.2 4.1), (40 40, 60 40, 60 75.5, 40 75.5, 40 40))"
    zone = spark.createDataFrame([(1, ring)], "id int, wkt string").select("id", G.parse_wkt(F.col("wkt")).alias("ring"))
    outer = [(3.2, 4.1), (80.5, 7.3), (70.2, 95.5), (10.1, 88.8)]

    def inside(x, y):
        turns = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(outer, outer[1:] + outer[:1])]
        return min(turns) > 0 and not (40 < x < 60 and 40 < y < 75.5)

    want = {(i, j) for i in range(100) for j in range(90) if inside(j + 0.5, 99.5 - i)}
    assert {(r.row, r.col) for r in zonal.zone_cells(zone, grid, all_touched=False).collect()} == want
    shares = zonal.zone_cells(zone, grid, fraction=True).agg(F.sum("fraction").alias("s"), F.count("*").alias("n")).first()
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(outer, outer[1:] + outer[:1]))) / 2 - 20 * 35.5
    assert abs(shares.s - area) < 1e-6 and shares.n > len(want)


def test_route_table_adds_up_options_and_layers(spark):
    config = {"routing_options": {"air": {"cost_layers": [{"layer_name": "a"}, {"layer_name": "i", "is_invariant": True}], "tracked_layers": [{"layer_name": "a", "agg_method": "max"}]}, "sea way": {"cost_layers": [{"layer_name": "b"}], "friction_layers": [{"multiplier_layer": "i", "include_in_report": True}]}}, "transition_costs": {"default": 7}}
    s = P.Scenario.from_json(config)
    rng = random.Random(5)
    values = {(i, j): {k: float(rng.randint(1, 9)) for k in "abi"} for i in range(4) for j in range(4)}
    grid = Grid(4, 4, a=500.0, c=0.0, e=-500.0, f=2000.0)
    table = spark.createDataFrame([(i, j, v["a"], v["b"], v["i"]) for (i, j), v in values.items()], "row int, col int, a double, b double, i double")
    walks = {1: [(0, 0, 0), (0, 1, 0), (1, 2, 1), (2, 2, 1)], 2: [(3, 3, 1), (3, 2, 1)]}
    steps = spark.createDataFrame([(k, *w[0], n, *p) for k, w in walks.items() for n, p in enumerate(w)], "route_id int, start_row int, start_col int, start_option int, step int, row int, col int, option int")
    found = spark.createDataFrame([(k, *w[0], ["wall"] if k == 2 else []) for k, w in walks.items()], "route_id int, start_row int, start_col int, start_option int, dropped array<string>")
    more = spark.createDataFrame([(1, "x"), (2, "y")], "route_id int, label string")
    got = {r.route_id: r for r in reports.route_table(found, steps, table, s, grid, more).collect()}
    for k, w in walks.items():
        gap = lambda p, q: math.hypot(p[0] - q[0], p[1] - q[1]) / 2
        lens = [(gap(p, w[n - 1]) if n else 0) + (gap(p, w[n + 1]) if n + 1 < len(w) else 0) for n, p in enumerate(w)]
        of = lambda f, o: sum(f(values[p[:2]], x) for p, x in zip(w, lens) if p[2] == o)
        air, sea = of(lambda v, x: v["a"] * x + v["i"], 0), of(lambda v, x: v["b"] * x, 1)
        switches = 7.0 * sum(p[2] != q[2] for p, q in zip(w, w[1:]))
        r = got[k]
        assert [r.air_cost, r.sea_way_cost, r.cost, r.length_km, r.total_transition_costs] == pytest.approx([air, sea, air + sea + switches, sum(lens) / 2, switches])
        assert [r.a_air_cost, r.i_air_cost, r.b_sea_way_cost, r.i_sea_way_cost] == pytest.approx([of(lambda v, x: v["a"] * x, 0), of(lambda v, x: v["i"], 0), sea, of(lambda v, x: v["i"] * x, 1)])
        assert r.a_air_max == max((values[p[:2]]["a"] for p in w if p[2] == 0), default=None)
        assert (r.label, r.dropped_barrier_layers) == ("xy"[k - 1], '["wall"]' if k == 2 else None)


def test_plans_skip_what_a_store_was_built_from(spark):
    store = Store(spark, shared_dir(spark))
    grid = Grid(2, 2, a=10.0, c=0.0, e=-10.0, f=20.0)
    source = cells(spark, [[1, 2], [3, 4]], "s")
    plan = layer_file.Plan([L.Layer("a", [L.Component("s", pass_through=True)]), L.Layer("b", [L.Component("s", bins=[L.Bin(5, max=3)])]), L.Layer("aside", [L.Component("s", pass_through=True)], include_in_file=False)])
    assert layer_file.build(store, plan, source, grid) == ["a", "b"]
    assert layer_file.build(store, plan, source) == []
    plan.layers[1].build[0].bins[0].value = 6
    assert layer_file.build(store, plan, source) == ["b"]
    assert array(store.cells(["a", "b"]), "b") == [[6.0, 6.0], [0.0, 0.0]] and store.layers() == ["a", "b"]
    with pytest.raises(ConfigError):
        layer_file.build(store, layer_file.Plan(), source)
    with pytest.raises(ConfigError):
        L.check_masks(store.cells(["a"]), ("a",))
    two = [L.Layer("c", [L.Component("v", rasterize=1.0), L.Component("v", rasterize=2.0)])]
    with pytest.raises(ConfigError):
        L.burned(source, two, {"v": source}, grid)
    with pytest.raises(MissingLayerError):
        L.burned(source, two[:1], {}, grid)


def test_capacities_and_voltages_are_inverse():
    t = Transmission()
    for name in t.power_classes:
        kv = t.capacity_to_kv(name)
        assert t.capacity_to_kv(t.kv_to_capacity(kv)) == kv == t.capacity_to_kv(name.removesuffix("MW"))

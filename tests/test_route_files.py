import pytest

from rasterway.grid import Grid
from rasterway.operators import network, reports

GRID = Grid(10, 10, 2.0, 0.0, 0.0, 0.0, -2.0, 20.0)


def test_runs_of_options_as_lines(spark):
    steps = [(0, k, 1, k, o) for k, o in enumerate([0, 0, 0, 1, 1, 0])] + [(1, 0, 4, 4, 1)]
    runs = reports.segments(spark.createDataFrame(steps, "route_id int, step int, row int, col int, option int"), ["route_id"])
    got = {(r.route_id, r.option): r.wkt for r in reports.option_wkt(runs, ["route_id"], GRID).collect()}
    # Straight runs keep their ends; where options change both share the midpoint.
    assert got == {
        (0, 0): "MULTILINESTRING ((1.0 17.0, 6.0 17.0), (10.0 17.0, 11.0 17.0))",
        (0, 1): "MULTILINESTRING ((6.0 17.0, 10.0 17.0))",
        (1, 1): "POINT (9.0 11.0)",
    }
    assert reports.option_wkt(runs.limit(0), ["route_id"], GRID).collect() == []


def test_two_files(spark, tmp_path):
    routes = spark.createDataFrame([(1, "LINESTRING (0 0, 1 1)")], "route_id int, wkt string")
    options = spark.createDataFrame([(1, "a", "MULTILINESTRING ((0 0, 1 1))"), (1, "b", None)], "route_id int, routing_option string, wkt string")
    with pytest.warns(UserWarning, match="parquet"):
        paths = reports.write_routes(routes, options, f"{tmp_path}/all.v2/out.csv", "wkt")
    assert paths == (f"{tmp_path}/all.v2/out.parquet", f"{tmp_path}/all.v2/out_routing_options.parquet")
    assert spark.read.parquet(paths[0]).collect() == routes.collect()
    assert [r.routing_option for r in spark.read.parquet(paths[1]).collect()] == ["a"]
    paths = reports.write_routes(routes.drop("wkt"), options.drop("wkt"), f"{tmp_path}/out.csv")
    assert sorted(r.routing_option for r in spark.read.option("header", True).csv(paths[1]).collect()) == ["a", "b"]


def test_substations_of_a_category(spark):
    rows = [(1, "TransLine", None, 100.0, "x"), (2, "TransLine", None, 50.0, None), (3, "Substation", "[1, 2]", None, None), (4, "Substation", "[2]", None, None), (5, "Other", "[1]", None, None), (6, "Substation", None, None, None)]
    features = spark.createDataFrame(rows, "gid long, category string, trans_gids string, voltage double, owner string")
    got = network.substations_of_category(features)
    assert "owner" not in got.columns and "voltage" not in got.columns
    assert [(r.trans_gid, r.min_volts, r.max_volts) for r in got.collect()] == [(3, 50.0, 100.0)]
    assert [r.trans_gid for r in network.substations_of_category(features, "Other").collect()] == [5]

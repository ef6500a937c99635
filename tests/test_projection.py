import math

import pytest
from pyspark.sql import functions as F

from rasterway.errors import UnsupportedError
from rasterway.functions import projection as P
from rasterway.grid import Grid, empty, resampled, with_coordinates
from rasterway.operators import route_tables

dms = lambda d, m, s=0.0: math.copysign(abs(d) + m / 60 + s / 3600, d)
#: System, longitude, latitude, and the published coordinates of worked examples.
EXAMPLES = [
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k_0=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", 0.5, 50.5, 577274.99, 69740.50),
    ("+proj=lcc +lat_1=18 +lat_0=18 +lon_0=-77 +k_0=1 +x_0=250000 +y_0=150000 +ellps=clrk66", -dms(76, 56, 37.26), dms(17, 55, 55.80), 255966.58, 142493.51),
    ("+proj=lcc +lat_0=27.8333333333333 +lon_0=-99 +lat_1=28.3833333333333 +lat_2=30.2833333333333 +x_0=609601.2192024384 +y_0=0 +ellps=clrk66 +units=us-ft", -96.0, 28.5, 2963503.91, 254759.80),
    ("+proj=merc +lon_0=110 +k=0.997 +x_0=3900000 +y_0=900000 +ellps=bessel", 120.0, -3.0, 5009726.58, 569150.82),
    ("EPSG:3857", -dms(100, 20), dms(24, 22, 54.433), -11169055.58, 2800000.00),
    ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", -75.0, 35.0, 1885472.7, 1535925.0),
]


@pytest.mark.parametrize("text, lon, lat, x, y", EXAMPLES)
def test_worked_examples_both_ways(spark, text, lon, lat, x, y):
    base = spark.range(1)
    own = replace_system(text)
    r = P.moved(base, F.lit(lon), F.lit(lat), own, text).first()
    slack = 0.06 if "aea" in text else 0.01
    assert abs(r.x - x) < slack and abs(r.y - y) < slack
    back = P.moved(base, F.lit(r.x), F.lit(r.y), text, own).first()
    assert abs(back.x - lon) < 1e-11 and abs(back.y - lat) < 1e-11


def replace_system(text):
    """Longitude and latitude on the ellipsoid of a system."""
    kept = [p for p in text.split() if p.startswith(("+ellps", "+datum"))]
    return " ".join(["+proj=longlat", *kept]) if kept else "EPSG:4326"


@pytest.mark.parametrize("text", ["EPSG:32618", "EPSG:32733", "EPSG:26915", "EPSG:5070", "EPSG:3857", "+proj=lcc +lat_1=-20 +lat_2=-40 +lat_0=-30 +lon_0=20", "+proj=aea +lat_1=-10 +lat_2=-35 +lat_0=-20 +lon_0=25 +ellps=GRS80", "+proj=merc +lat_ts=40", "+proj=tmerc +lon_0=10 +R=6371000"])
def test_round_trips(spark, text):
    s = P.system(text)
    rows = [(s.lon_0 + dx, s.lat_0 + dy) for dx in (-9.0, -1.5, 0.0, 3.0, 8.0) for dy in (-12.0, -0.5, 0.0, 7.0, 15.0)]
    frame = spark.createDataFrame(rows, "lon double, lat double")
    there = P.moved(frame, F.col("lon"), F.col("lat"), "EPSG:4326", text)
    for r in P.moved(there, F.col("x"), F.col("y"), text, "EPSG:4326", ("u", "v")).collect():
        assert abs(r.u - r.lon) < 1e-10 and abs(r.v - r.lat) < 1e-10
    points = frame.groupBy().agg(F.collect_list(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y"))).alias("p")).select(F.concat("p", F.array(F.lit(None).cast("struct<x:double,y:double>"))).alias("p"))
    got = points.select(P.transformed_points(F.col("p"), "EPSG:4326", text).alias("q"), "p").first()
    known = {(r.lon, r.lat): (r.x, r.y) for r in there.collect()}
    assert got.q[-1] is None and all(known[p.x, p.y] == (q.x, q.y) for p, q in zip(got.p[:-1], got.q[:-1]))


def test_meridians_keep_their_lengths():
    L = P.latitudes(*P.ELLIPSOIDS["wgs84"])
    # Fixed value: the quarter of a meridian, in metres.
    assert abs(L.radius * math.pi / 2 - 10001965.729) < 1e-3


def test_systems_are_read_and_compared():
    utm = 'PROJCS["zone 15N",GEOGCS["NAD83",DATUM["d",SPHEROID["GRS 1980",6378137,298.257222101]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",-93],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1]]'
    assert P.same(utm, "EPSG:26915") and P.same("EPSG:26915", "+proj=utm +zone=15 +datum=NAD83") and P.same("epsg:4326", "WGS84") and P.same("EPSG:4326", "EPSG:4269")
    assert not P.same("EPSG:26915", "EPSG:26916") and P.utm_of(-71.4, 41.7) == "EPSG:32619" and P.utm_of(18.5, -33.9) == "EPSG:32734"
    for bad in ("EPSG:1", "", "+proj=stere", "+proj=tmerc +ellps=no", "+proj=utm +zone=3 +towgs84=1,2,3"):
        assert not P.known(bad)
        with pytest.raises(UnsupportedError):
            P.system(bad)


def test_grids_have_places_on_earth_and_are_warped(spark):
    target = Grid(40, 50, a=900.0, c=300000.0, e=-900.0, f=4620000.0, crs="EPSG:32619")
    source = Grid(30, 90, a=0.01, c=-71.6, e=-0.01, f=41.8, crs="EPSG:4326")
    here = {(r.row, r.col): (r.longitude, r.latitude) for r in with_coordinates(empty(spark, target), target).collect()}
    cells = empty(spark, source).withColumn("v", F.col("row") * 1000 + F.col("col"))
    got = resampled(cells, source, target, ["v"], fill=-1).collect()
    exact = {(r.row, r.col): (r.x, r.y) for r in P.moved(empty(spark, target), target.x(F.col("col")), target.y(F.col("row")), target.crs, source.crs).collect()}
    assert len(got) == 2000 and any(r.v == -1 for r in got) and any(r.v >= 0 for r in got)
    for r in got:
        x, y = exact[r.row, r.col]
        assert abs(x - here[r.row, r.col][0]) < 1e-4 and abs(y - here[r.row, r.col][1]) < 1e-4
        i, j = math.floor((y - 41.8) / -0.01), math.floor((x + 71.6) / 0.01)
        assert r.v == (i * 1000 + j if 0 <= i < 30 and 0 <= j < 90 else -1)


def test_nearest_region_measures_degrees_in_metres(spark):
    # A degree of longitude is half a degree of latitude here.
    ring = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    regions = spark.createDataFrame([(1, ring(11.0, 60.0, 11.2, 60.1)), (2, ring(10.0, 60.7, 10.1, 60.8))], "rid int, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(7, 10.05, 60.05)], "id int, x double, y double")
    assert route_tables.nearest_region(points, regions, crs="EPSG:4326").first().rid == 1
    assert route_tables.nearest_region(points, regions).first().rid == 2


def test_points_of_another_system_find_their_cells(spark):
    grid = Grid(40, 50, a=900.0, c=300000.0, e=-900.0, f=4620000.0, crs="EPSG:32619")
    centres = with_coordinates(empty(spark, grid), grid).withColumnRenamed("longitude", "start_lon").withColumnRenamed("latitude", "start_lat")
    found = route_tables.on_grid(centres.drop("x", "y"), grid, ("start",))
    assert found.where("start_row = row AND start_col = col").count() == 2000
    assert route_tables.in_domain(found.withColumn("start_row", F.col("start_row") - 1), grid, ("start",)).count() == 1950

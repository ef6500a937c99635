"""Queries of reference systems and raster files over grids and places derived from the tables, with their SQL.

The SQL projects by the closed forms of the conformal latitude and by sine series of its own
reading of the same coefficients; what goes there and back has to give the original again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterway import grid as gridlib
from rasterway.functions import geometry as G
from rasterway.functions import projection
from rasterway.grid import Grid
from rasterway.operators import shapes, simplify
from rasterway.oracles import _C
from rasterway.queries import _cells, _points, _t
from rasterway.sources.geotiff import read_geotiff, write_geotiff
from rasterway.sources.store import Store
from rasterway.sources.zarr import grid_of, read_zarr, write_zarr
from rasterway.storage import shared_dir

UTM, ALBERS, MERCATOR = "EPSG:26915", "EPSG:5070", "EPSG:3857"
LAMBERT = "+proj=lcc +lat_1=33 +lat_2=45 +lat_0=39 +lon_0=-96 +x_0=1000 +y_0=2000 +datum=NAD83"
NAMES = {"utm": UTM, "albers": ALBERS, "lambert": LAMBERT, "mercator": MERCATOR}
#: The 32 by 32 grid of lineitem, laid out in a UTM zone, and one in degrees that covers most of it.
LAID = Grid(32, 32, 900.0, 0.0, 480000.0, 0.0, -900.0, 4650000.0, UTM)
DEGREES = Grid(36, 40, 0.009, 0.0, -93.22, 0.0, -0.008, 41.99, "EPSG:4326")


def _places(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", (F.lit(-105.0) + k % 1000 * F.lit(0.02)).alias("lon"), (F.lit(25.0) + k * 7 % 1000 * F.lit(0.02)).alias("lat"))


def places_projected(spark, sf_dir):
    out = _places(spark, sf_dir)
    for name, system in NAMES.items():
        out = projection.moved(out, F.col("lon"), F.col("lat"), "EPSG:4269", system, (f"{name}_x", f"{name}_y"))
    return out.select("c_custkey", *(F.round(f"{n}_{c}", 3).alias(f"{n}_{c}") for n in NAMES for c in "xy"))


def places_inverted(spark, sf_dir):
    out = _places(spark, sf_dir)
    x, y = F.col("lon"), F.col("lat")
    for own, other in (("EPSG:4269", UTM), (UTM, ALBERS), (ALBERS, LAMBERT), (LAMBERT, "EPSG:4269")):
        out = projection.moved(out, x, y, own, other)
        x, y = F.col("x"), F.col("y")
    return out.select("c_custkey", F.round("x", 8).alias("lon"), F.round("y", 8).alias("lat"))


def grid_places(spark, sf_dir):
    """Longitude and latitude of every cell of a projected grid, as a store keeps them."""
    store = Store(spark, shared_dir(spark)).create(LAID)
    store.write("c1", _cells(spark, sf_dir).select("row", "col", "c1"))
    return store.cells(["c1", "longitude", "latitude"]).select("row", "col", "c1", F.round(F.col("longitude").cast("double"), 4).alias("longitude"), F.round(F.col("latitude").cast("double"), 4).alias("latitude"))


def grid_warped(spark, sf_dir):
    return gridlib.resampled(_cells(spark, sf_dir), LAID, DEGREES, ["c1", "nlcd"], fill=-1)


def raster_files(spark, sf_dir):
    """A layer through a folder of GeoTIFF files; a window of it is read."""
    path = shared_dir(spark)
    write_geotiff(_cells(spark, sf_dir).where("nlcd <> 90"), LAID, path, "c1", nodata=-5.0, side=16, block=16)
    cells, own = read_geotiff(spark, path, "c1")
    own.check(LAID)
    return cells.where("row >= 10 AND col < 20")


def raster_chunks(spark, sf_dir):
    """Two layers through a Zarr store; one is replaced, a window of both is read."""
    path = shared_dir(spark)
    cells = _cells(spark, sf_dir)
    write_zarr(cells.where("nlcd <> 90"), LAID, path, ["c1", "nlcd"], {"c1": -2.0}, side=12)
    write_zarr(cells.select("row", "col", (F.col("c1") * 2).alias("c1")), LAID, path, overwrite=True, side=12)
    grid_of(path).check(LAID)
    return read_zarr(spark, path, ["c1", "nlcd"]).where("row BETWEEN 5 AND 25")


def united_features(spark, sf_dir):
    """Boxes of all parts of a size and kind as one shape, with its area and number of rings' points."""
    k = F.col("p_partkey")
    box = G.box((k * 37 % 300).cast("double"), (k * 53 % 280).cast("double"), (k * 37 % 300 + k % 11 + 2).cast("double"), (k * 53 % 280 + k % 7 + 2).cast("double"))
    made = _t(spark, sf_dir, "part").select(F.col("p_size").alias("size"), k.alias("p_partkey"), box.alias("ring"))
    return shapes.united(made, "size", order=["p_partkey"]).select("size", "p_partkey", F.round(G.area(F.col("ring")), 3).alias("area"))


def repaired_shapes(spark, sf_dir):
    """Bow ties and squares with a hole that runs the wrong way."""
    k = F.col("s_suppkey")
    w, h = (k % 9 + 2).cast("double"), (k % 5 + 2).cast("double")
    at = lambda *p: F.array(*(G.point(F.lit(x) * w, F.lit(y) * h) for x, y in p))
    bow = at((0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0))
    holed = G.joined(F.array(at((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)), at((1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0))))
    made = _t(spark, sf_dir, "supplier").select(k.alias("s_suppkey"), F.when(k % 2 == 0, bow).otherwise(holed).alias("ring"))
    return shapes.repaired(made).select("s_suppkey", F.size(G.parts(F.col("ring"))).alias("n_parts"), F.round(G.area(F.col("ring")), 6).alias("area"))


def simplified_regions(spark, sf_dir):
    """A row of regions whose shared borders bend by up to 0.8; bends of half a unit or less go from both neighbours."""
    k = F.col("s_suppkey")
    x, bend = k * 10.0, lambda n: (n * 7 % 9 - 4) * F.lit(0.2)
    ring = F.array(G.point(x, F.lit(0)), G.point(x + 10, F.lit(0)), G.point(x + 10 + bend(k + 1), F.lit(5)), G.point(x + 10, F.lit(10)), G.point(x, F.lit(10)), G.point(x + bend(k), F.lit(5)), G.point(x, F.lit(0)))
    made = _t(spark, sf_dir, "supplier").select(k.alias("s_suppkey"), ring.alias("ring"))
    return simplify.simplified(made, 0.5).select("s_suppkey", (F.size("ring") - 1).alias("n_corners"), F.round(G.area(F.col("ring")), 6).alias("area"))


def shapes_in_radius(spark, sf_dir):
    """Level lines and boxes that lie near customers, with what is left of lines in the circle."""
    k = F.col("s_suppkey")
    x, y, size = (k * 97 % 2880).cast("double"), (k * 61 % 2880).cast("double"), (k % 90 + 10).cast("double")
    line = F.array(G.point(x, y), G.point(x + size, y))
    f = _t(spark, sf_dir, "supplier").select(k.alias("feature"), (k % 2 == 0).alias("areal"), F.when(k % 2 == 0, G.box(x, y, x + size, y + size)).otherwise(line).alias("points"))
    found = shapes.shapes_within_radius(_points(spark, sf_dir), f, 60.0)
    length = F.when(F.size("points") == 2, F.abs(F.col("points")[1]["x"] - F.col("points")[0]["x"]))
    return found.select("id", "feature", F.round("distance", 6).alias("distance"), F.round("radius", 6).alias("radius"), F.when(F.col("feature") % 2 == 1, F.round(F.coalesce(length, F.lit(0.0)), 6)).alias("length"))


def queries() -> dict:
    return {f.__name__: f for f in (united_features, repaired_shapes, simplified_regions, shapes_in_radius, places_projected, places_inverted, grid_places, grid_warped, raster_files, raster_chunks)}


# SQL ------------------------------------------------------------------------------


def _n(v: float) -> str:
    return f"({float(v)!r}::DOUBLE)"


def _series(x: str, coefficients: list[float]) -> str:
    return " + ".join([x, *(f"{_n(c)} * sin({2 * (k + 1)} * {x})" for k, c in enumerate(coefficients))])


def _chi(e: float) -> str:
    return f"atan(sinh(asinh(tan(phi)) - {_n(e)} * atanh({_n(e)} * sin(phi))))"


def _tm_onto(source: str, lon: str, lat: str, name: str, s: projection.System, keep: str) -> str:
    """CTEs from ``source`` to ``name`` with transverse Mercator x and y."""
    L = projection.latitudes(s.a, s.inverse_flattening)
    scale = s.k_0 * L.radius
    return f"""{name}1 AS (SELECT {keep}, radians({lon} - {_n(s.lon_0)}) AS lam, radians({lat}) AS phi FROM {source}), {name}2 AS (SELECT {keep}, lam, {_chi(L.e)} AS chi FROM {name}1),
      {name}3 AS (SELECT {keep}, atanh(cos(chi) * sin(lam)) AS eta, atan2(sin(chi), cos(chi) * cos(lam)) AS xi FROM {name}2),
      {name} AS (SELECT {keep}, {_n(s.x_0)} + {_n(scale)} * ({' + '.join(['eta', *(f'{_n(c)} * cos({2 * (k + 1)} * xi) * sinh({2 * (k + 1)} * eta)' for k, c in enumerate(L.mu_of_chi))])}) AS x,
        {_n(s.y_0)} + {_n(scale)} * ({' + '.join(['xi', *(f'{_n(c)} * sin({2 * (k + 1)} * xi) * cosh({2 * (k + 1)} * eta)' for k, c in enumerate(L.mu_of_chi))])}) AS y FROM {name}3)"""


def _tm_off(source: str, name: str, s: projection.System, keep: str) -> str:
    """CTEs from x and y of ``source`` to ``name`` with longitude and latitude."""
    L = projection.latitudes(s.a, s.inverse_flattening)
    scale = s.k_0 * L.radius
    return f"""{name}1 AS (SELECT {keep}, (x - {_n(s.x_0)}) / {_n(scale)} AS eta, (y - {_n(s.y_0)}) / {_n(scale)} AS xi FROM {source}),
      {name}2 AS (SELECT {keep}, {' + '.join(['eta', *(f'{_n(c)} * cos({2 * (k + 1)} * xi) * sinh({2 * (k + 1)} * eta)' for k, c in enumerate(L.chi_of_mu))])} AS eta, {' + '.join(['xi', *(f'{_n(c)} * sin({2 * (k + 1)} * xi) * cosh({2 * (k + 1)} * eta)' for k, c in enumerate(L.chi_of_mu))])} AS xi FROM {name}1),
      {name}3 AS (SELECT {keep}, atan2(sinh(eta), cos(xi)) AS lam, asin(sin(xi) / cosh(eta)) AS chi FROM {name}2),
      {name} AS (SELECT {keep}, {_n(s.lon_0)} + degrees(lam) AS longitude, degrees({_series('chi', L.phi_of_chi)}) AS latitude FROM {name}3)"""


def _cones() -> tuple[str, str, str]:
    """SQL of Albers, Lambert and Mercator x and y of lam and phi columns: (albers, lambert, mercator)."""
    a, l = projection.system(ALBERS), projection.system(LAMBERT)
    L = projection.latitudes(a.a, a.inverse_flattening)
    r = [math.radians(v) for v in (a.lat_1, a.lat_2, a.lat_0)]
    q = [float(L.q(np.array([v]))[0]) for v in r]
    m = [math.cos(v) / math.sqrt(1 - L.e2 * math.sin(v) ** 2) for v in r]
    n = (m[0] ** 2 - m[1] ** 2) / (q[1] - q[0])
    c = m[0] ** 2 + n * q[0]
    rho = f"({_n(a.a / n)} * sqrt({_n(c)} - {_n(n)} * ({_n(1 - L.e2)} * (sin(phi) / (1 - {_n(L.e2)} * sin(phi) * sin(phi)) + atanh({_n(L.e)} * sin(phi)) / {_n(L.e)}))))"
    turn = f"({_n(n)} * (lam - {_n(math.radians(a.lon_0))}))"
    albers = f"round({rho} * sin{turn}, 3) AS albers_x, round({_n(a.a / n * math.sqrt(c - n * q[2]))} - {rho} * cos{turn}, 3) AS albers_y"
    r = [math.radians(v) for v in (l.lat_1, l.lat_2, l.lat_0)]
    m = [math.cos(v) / math.sqrt(1 - L.e2 * math.sin(v) ** 2) for v in r]
    t = [math.tan(math.pi / 4 - float(L.chi(np.array([v]))[0]) / 2) for v in r]
    n = math.log(m[0] / m[1]) / math.log(t[0] / t[1])
    scale = l.a * m[0] / (n * t[0] ** n)
    rho = f"({_n(scale)} * pow(tan({_n(math.pi / 4)} - {_chi(L.e)} / 2), {_n(n)}))"
    turn = f"({_n(n)} * (lam - {_n(math.radians(l.lon_0))}))"
    lambert = f"round({_n(l.x_0)} + {rho} * sin{turn}, 3) AS lambert_x, round({_n(l.y_0)} + {_n(scale * t[2] ** n)} - {rho} * cos{turn}, 3) AS lambert_y"
    R = _n(projection.system(MERCATOR).a)
    return albers, lambert, f"round({R} * lam, 3) AS mercator_x, round({R} * asinh(tan(phi)), 3) AS mercator_y"


def oracle_sql() -> dict[str, str]:
    places = "places AS (SELECT c_custkey, -105.0::DOUBLE + c_custkey % 1000 * 0.02::DOUBLE AS lon, 25.0::DOUBLE + c_custkey * 7 % 1000 * 0.02::DOUBLE AS lat FROM customer)"
    utm = projection.system(UTM)
    albers, lambert, mercator = _cones()
    q = {}
    q["places_projected"] = f"""WITH {places}, {_tm_onto('places', 'lon', 'lat', 'tm', utm, 'c_custkey')}, cones AS (SELECT c_custkey, {albers}, {lambert}, {mercator} FROM (SELECT c_custkey, radians(lon) AS lam, radians(lat) AS phi FROM places))
      SELECT c.*, round(tm.x, 3) AS utm_x, round(tm.y, 3) AS utm_y FROM cones c JOIN tm ON tm.c_custkey = c.c_custkey"""
    q["places_inverted"] = f"WITH {places} SELECT c_custkey, round(lon, 8) AS lon, round(lat, 8) AS lat FROM places"
    centres = f'spots AS (SELECT a.range::INTEGER AS "row", b.range::INTEGER AS col, {_n(LAID.c)} + (b.range + 0.5::DOUBLE) * {_n(LAID.a)} AS x, {_n(LAID.f)} + (a.range + 0.5::DOUBLE) * {_n(LAID.e)} AS y FROM range(32) a, range(32) b)'
    q["grid_places"] = f"""{_C}, {centres}, {_tm_off('spots', 'll', utm, '"row", col')} SELECT ll."row", ll.col, c1, round(longitude::FLOAT::DOUBLE, 4) AS longitude, round(latitude::FLOAT::DOUBLE, 4) AS latitude
      FROM ll LEFT JOIN cells c ON c."row" = ll."row" AND c.col = ll.col"""
    degrees = f'spots AS (SELECT a.range::INTEGER AS "row", b.range::INTEGER AS col, {_n(DEGREES.c)} + (b.range + 0.5::DOUBLE) * {_n(DEGREES.a)} AS lon, {_n(DEGREES.f)} + (a.range + 0.5::DOUBLE) * {_n(DEGREES.e)} AS lat FROM range({DEGREES.nrows}) a, range({DEGREES.ncols}) b)'
    q["grid_warped"] = f"""{_C}, {degrees}, {_tm_onto('spots', 'lon', 'lat', 'tm', utm, '"row", col')}
      SELECT tm."row", tm.col, coalesce(c1, -1)::FLOAT AS c1, coalesce(nlcd, -1)::INTEGER AS nlcd FROM tm LEFT JOIN cells c ON c."row" = floor((y - {_n(LAID.f)}) / {_n(LAID.e)}) AND c.col = floor((x - {_n(LAID.c)}) / {_n(LAID.a)})"""
    everywhere = 'allcells AS (SELECT a.range::INTEGER AS "row", b.range::INTEGER AS col FROM range(32) a, range(32) b)'
    q["raster_files"] = f"""{_C}, {everywhere} SELECT a."row", a.col, c1 FROM allcells a LEFT JOIN (SELECT * FROM cells WHERE nlcd <> 90) c ON c."row" = a."row" AND c.col = a.col WHERE a."row" >= 10 AND a.col < 20"""
    q["raster_chunks"] = f"""{_C}, {everywhere} SELECT a."row", a.col, c.c1 * 2 AS c1, coalesce(CASE WHEN nlcd <> 90 THEN nlcd END, 0)::INTEGER AS nlcd FROM allcells a LEFT JOIN cells c ON c."row" = a."row" AND c.col = a.col WHERE a."row" BETWEEN 5 AND 25"""
    q["united_features"] = """WITH b AS (SELECT p_size AS size, p_partkey, p_partkey * 37 % 300 AS x0, p_partkey * 53 % 280 AS y0, p_partkey * 37 % 300 + p_partkey % 11 + 2 AS x1, p_partkey * 53 % 280 + p_partkey % 7 + 2 AS y1 FROM part),
      c AS (SELECT DISTINCT size, x, y FROM (SELECT size, unnest(range(x0, x1)) AS x, y0, y1 FROM b) t, range(0, 300) r(y) WHERE y >= y0 AND y < y1), n AS (SELECT size, count(*) AS area FROM c GROUP BY size)
      SELECT n.size, p_partkey, area::DOUBLE AS area FROM n JOIN (SELECT size, min(p_partkey) AS p_partkey FROM b GROUP BY size) m ON m.size = n.size"""
    q["repaired_shapes"] = """SELECT s_suppkey, 2 AS n_parts, CASE WHEN s_suppkey % 2 = 0 THEN 0.5 ELSE 15.0 END::DOUBLE * (s_suppkey % 9 + 2) * (s_suppkey % 5 + 2) AS area FROM supplier"""
    q["simplified_regions"] = """WITH b AS (SELECT s_suppkey, (s_suppkey * 7 % 9 - 4) * 0.2::DOUBLE AS l, ((s_suppkey + 1) * 7 % 9 - 4) * 0.2::DOUBLE AS r FROM supplier),
      k AS (SELECT s_suppkey, CASE WHEN abs(l) > 0.5 THEN l ELSE 0 END AS l, CASE WHEN abs(r) > 0.5 THEN r ELSE 0 END AS r FROM b)
      SELECT s_suppkey, (4 + (l <> 0)::INTEGER + (r <> 0)::INTEGER)::INTEGER AS n_corners, round(100 + 5 * r - 5 * l, 6) AS area FROM k"""
    q["shapes_in_radius"] = """WITH p AS (SELECT c_custkey AS id, (c_custkey * 37 % 2880)::DOUBLE AS x, (c_custkey * 53 % 2880)::DOUBLE AS y FROM customer),
      f AS (SELECT s_suppkey AS feature, (s_suppkey * 97 % 2880)::DOUBLE AS x0, (s_suppkey * 61 % 2880)::DOUBLE AS y0, (s_suppkey % 90 + 10)::DOUBLE AS size FROM supplier),
      d AS (SELECT id, feature, x, y, x0, x0 + size AS x1, y0, greatest(x0 - x, 0, x - x0 - size) AS dx, greatest(y0 - y, 0, y - y0 - CASE WHEN feature % 2 = 0 THEN size ELSE 0 END) AS dy FROM p, f),
      e AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance, min(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY id) AS least FROM d),
      r AS (SELECT *, 60 * (1 + 0.05::DOUBLE * greatest(0, ceil((least / 60 - 1) / 0.05::DOUBLE - 1e-9::DOUBLE))) AS radius FROM e)
      SELECT id, feature, round(distance, 6) AS distance, round(radius, 6) AS radius,
        CASE WHEN feature % 2 = 1 THEN round(greatest(0, least(x1, x + sqrt(greatest(0, radius * radius - dy * dy))) - greatest(x0, x - sqrt(greatest(0, radius * radius - dy * dy)))), 6) END AS length
      FROM r WHERE distance <= radius + 1e-9 * radius"""
    return q

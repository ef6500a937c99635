import sqlite3
import struct

import pytest

from rasterway.errors import ConfigError, MissingFileError, MissingLayerError
from rasterway.functions import geometry as G
from rasterway.sources import geopackage as P
from rasterway.sources.store import read_features


def wkb(kind, body, order="<", plus=0):
    return (b"\1" if order == "<" else b"\0") + struct.pack(order + "I", kind + plus) + body


def line(points, order="<"):
    return struct.pack(order + "I", len(points)) + b"".join(struct.pack(order + "d" * len(p), *p) for p in points)


def polygon(rings, order="<", plus=0):
    return wkb(3, struct.pack(order + "I", len(rings)) + b"".join(line(r, order) for r in rings), order, plus)


def many(kind, parts, order="<"):
    return wkb(kind, struct.pack(order + "I", len(parts)) + b"".join(parts), order)


def blob(body, envelope=0, size=0):
    return b"GP\0" + bytes([1 | envelope << 1]) + struct.pack("<i", 26915) + b"\0" * size + body


SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
HOLE = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]
SHAPES = [
    (1, "Point", blob(wkb(1, struct.pack("<dd", 3, 4))), [(3.0, 4.0)]),
    (2, "LineString", blob(wkb(2, line([(0.0, 0.0), (5.0, 5.0), (9.0, 1.0)]))), [(0.0, 0.0), (5.0, 5.0), (9.0, 1.0)]),
    (3, "Polygon", blob(polygon([SQUARE, HOLE]), 1, 32), [*SQUARE, None, *HOLE[::-1]]),
    (4, "Polygon", blob(polygon([SQUARE[::-1]], ">"), 4, 64), SQUARE),
    (5, "MultiPolygon", blob(many(6, [polygon([SQUARE]), polygon([HOLE])])), [*SQUARE, None, *HOLE]),
    (6, "MultiLineString", blob(many(5, [wkb(2, line([(1.0, 1.0), (2.0, 2.0)])), wkb(2, line([(50.0, 50.0), (60.0, 60.0)]))])), [(1.0, 1.0), (2.0, 2.0), None, (50.0, 50.0), (60.0, 60.0)]),
    (7, "MultiPoint", blob(many(4, [wkb(1, struct.pack("<dd", 7, 7)), wkb(1, struct.pack(">dd", 8, 8), ">")])), [(7.0, 7.0), None, (8.0, 8.0)]),
    (8, "LineString", blob(wkb(2, line([(0.0, 0.0, 9.0), (1.0, 2.0, 9.0)]), plus=1000), 2, 48), [(0.0, 0.0), (1.0, 2.0)]),
    (9, "LineString", blob(wkb(2, line([(0.0, 0.0, 9.0, 8.0), (3.0, 4.0, 9.0, 8.0)]), plus=3000)), [(0.0, 0.0), (3.0, 4.0)]),
    (10, "Point", blob(wkb(1, struct.pack("<dd", float("nan"), float("nan")))), None),
    (11, "GeometryCollection", blob(many(7, [wkb(1, struct.pack("<dd", 1, 1))])), None),
    (12, None, None, None),
]


def build(path, features, extra="voltage_kv REAL, name TEXT, type INTEGER, ok BOOLEAN, none REAL", index=True):
    con = sqlite3.connect(path)
    con.executescript(f"""
      CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT, srs_id INTEGER PRIMARY KEY, organization TEXT, organization_coordsys_id INTEGER, definition TEXT);
      CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INTEGER, m INTEGER);
      INSERT INTO gpkg_spatial_ref_sys VALUES ('x', 26915, 'EPSG', 26915, 'undefined'), ('own', 99, 'own', 99, '+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96');
      CREATE TABLE "my lines" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{', ' + extra if extra else ''});
      INSERT INTO gpkg_geometry_columns VALUES ('my lines', 'geom', 'GEOMETRY', 26915, 0, 0);""")
    if index:
        con.execute('CREATE VIRTUAL TABLE "rtree_my lines_geom" USING rtree(id, minx, maxx, miny, maxy)')
    for fid, body, values, points in features:
        marks = ", ".join("?" * (2 + len(values)))
        con.execute(f'INSERT INTO "my lines" VALUES ({marks})', (fid, body, *values))
        real = [p for p in points or () if p]
        if index and real:
            con.execute('INSERT INTO "rtree_my lines_geom" VALUES (?, ?, ?, ?, ?)', (fid, min(p[0] for p in real), max(p[0] for p in real), min(p[1] for p in real), max(p[1] for p in real)))
    con.commit()
    con.close()


@pytest.fixture
def small(tmp_path):
    path = str(tmp_path / "a b.gpkg")
    build(path, [(fid, body, (fid * 1.5 if fid % 3 else None, f"n{fid}é", fid, fid % 2, None), points) for fid, _, body, points in SHAPES])
    return path


@pytest.mark.parametrize("rows", [1, 5, 100])
def test_every_kind_of_geometry_in_ranges_of_any_size(spark, small, rows):
    frame = P.read_geopackage(spark, small, rows=rows)
    assert frame.dtypes[:6] == [("fid", "bigint"), ("voltage_kv", "double"), ("name", "string"), ("type_", "bigint"), ("ok", "boolean"), ("none", "double")]
    assert frame.rdd.getNumPartitions() == -(-len(SHAPES) // rows)
    got = {r.fid: r for r in frame.collect()}
    assert len(got) == len(SHAPES)
    for fid, kind, _, points in SHAPES:
        r = got[fid]
        assert r.type == kind and (None if r.points is None else [None if p is None else tuple(p) for p in r.points]) == points
        assert (r.voltage_kv, r.name, r.type_, r.ok, r.none) == (fid * 1.5 if fid % 3 else None, f"n{fid}é", fid, bool(fid % 2), None)
    assert frame.where("type = 'Polygon'").select(G.area(frame.points).alias("a")).agg({"a": "sum"}).first()[0] == 196.0


def test_count_and_system(small, tmp_path):
    assert P.count(small) == sum(1 for *_, p in SHAPES if p) and P.crs(small) == "EPSG:26915"
    build(str(tmp_path / "no_index.gpkg"), [(3, SHAPES[0][2], (), None)], extra="", index=False)
    assert P.count(str(tmp_path / "no_index.gpkg")) == 1
    con = sqlite3.connect(small)
    con.execute("UPDATE gpkg_geometry_columns SET srs_id = 99")
    con.commit()
    con.close()
    assert P.crs(small).startswith("+proj=aea")


def test_boxes_and_attributes_choose_rows_in_the_file(spark, small):
    frame = P.read_geopackage(spark, small, box=(45.0, 45.0, 70.0, 70.0))
    assert [r.fid for r in frame.collect()] == [6]
    assert P.read_geopackage(spark, small, box=(100.0, 100.0, 101.0, 101.0)).count() == 0
    frame = P.read_geopackage(spark, small).where("voltage_kv > 6 AND name IN ('n5é', 'n7é', 'n6é') AND fid < 7")
    assert [r.fid for r in frame.collect()] == [5]
    reader = P.GeoPackageReader(small, P.table_of(P.connected(small)), None, 100)
    list(reader.pushFilters([P.GreaterThan(("voltage_kv",), 6.0), P.EqualTo(("name",), "n5é"), P.EqualTo(("points",), 1), P.EqualTo(("type_",), "text")]))
    assert reader.wheres == ['"voltage_kv" > ?', '"name" = ?']
    assert [(p.low, p.high) for p in reader.partitions()] == [(5, 5)]


def test_empty_files_and_other_files(spark, tmp_path):
    path = str(tmp_path / "empty.gpkg")
    build(path, [])
    assert P.read_geopackage(spark, path).count() == 0 and P.count(path) == 0
    con = sqlite3.connect(path)
    con.execute("DELETE FROM gpkg_geometry_columns")
    con.commit()
    con.close()
    assert P.read_geopackage(spark, path).columns == ["fid", "type", "points"] and P.count(path) == 0 and P.crs(path) == ""
    with pytest.raises(MissingLayerError):
        P.read_geopackage(spark, path, "other")
    with pytest.raises(MissingFileError):
        P.count(str(tmp_path / "none.gpkg"))
    (tmp_path / "text.gpkg").write_text("hello, this is a text of some length, not a database at all" * 20)
    with pytest.raises(ConfigError):
        P.count(str(tmp_path / "text.gpkg"))


def test_feature_files_of_this_kind(spark, small):
    assert read_features(spark, small, "voltage_kv >= 15").count() == 2

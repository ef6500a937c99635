"""GeoPackage files as a data source: features by ranges of their row ids.

The driver reads what the file says of its tables and cuts the ids into ranges; each task
opens the file read-only and decodes its own range.  A box goes through the file's R-tree,
and comparisons of attributes with values of the same kind go into the task's SQL (Spark
applies them again), so other rows are never decoded.  Geometries become the library's
shapes: arrays of points with a null between two parts, outer rings against the clock.
Files that are not on a local disk are held in memory, so they should not exceed a worker's.
"""

from __future__ import annotations

import re
import sqlite3
import struct
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from rasterway.errors import ConfigError, MissingFileError, MissingLayerError
from rasterway.functions import projection
from rasterway.sources.geotiff import opened

#: Features of a range, and of a batch within it.
RANGE, BATCH = 50_000, 4096
# Fixed values of the format: geometry types, and Spark's types of declared ones.
_NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
_KINDS = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "mediumint": "long", "int": "long", "integer": "long", "float": "double", "double": "double", "real": "double", "blob": "binary"}
_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_PYTHON = {"int": int, "long": int, "double": float, "string": str}


def connected(path: str) -> sqlite3.Connection:
    store, name = opened(path)
    if store.get_file_info(name).type != arrow_fs.FileType.File:
        raise MissingFileError(f"no file at {path}")
    if isinstance(store, arrow_fs.LocalFileSystem):
        return sqlite3.connect(f"file:{name.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro&immutable=1", uri=True)
    con = sqlite3.connect(":memory:")
    with store.open_input_file(name) as f:
        con.deserialize(f.read())
    return con


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class Table:
    """A table of features: its key, its geometry, and its attributes with their Spark types."""

    name: str
    geometry: str
    key: str
    columns: tuple[tuple[str, str, str], ...]
    rtree: str | None
    crs: str

    @property
    def schema(self) -> str:
        return ", ".join(["fid long", *(f"`{shown}` {kind}" for _, shown, kind in self.columns), "type string", "points array<struct<x:double,y:double>>"])


def table_of(con: sqlite3.Connection, name: str | None = None) -> Table | None:
    """The named table of features, or the first; None where the file has none."""
    try:
        known = con.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
    except sqlite3.DatabaseError as e:
        raise ConfigError(f"not a GeoPackage: {e}") from e
    if name is not None:
        known = [k for k in known if k[0] == name]
        if not known:
            raise MissingLayerError(name)
    if not known:
        return None
    own, geometry, srs = known[0]
    info = con.execute(f"PRAGMA table_info({quoted(own)})").fetchall()
    key = next((c for _, c, kind, _, _, pk in info if pk == 1 and kind.upper() in ("INTEGER", "MEDIUMINT", "INT")), "rowid")
    taken, columns = {"fid", "type", "points"}, []
    for _, c, kind, _, _, _ in info:
        if c in (key, geometry):
            continue
        shown = c
        while shown.lower() in taken:
            shown += "_"
        taken.add(shown.lower())
        columns.append((c, shown, _KINDS.get(re.split(r"[ (]", kind.lower())[0], "string")))
    rtree = f"rtree_{own}_{geometry}"
    if not con.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (rtree,)).fetchone():
        rtree = None
    place = con.execute("SELECT organization, organization_coordsys_id, definition FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (srs,)).fetchone()
    crs = ""
    if place:
        code = f"{place[0]}:{place[1]}"
        crs = code if place[0].upper() == "EPSG" and projection.known(code) or not projection.known(place[2] or "") and place[1] and place[1] > 0 else place[2] if projection.known(place[2] or "") else ""
    return Table(own, geometry, key, tuple(columns), rtree, crs)


def count(path: str) -> int:
    """Features of the first table; those in its R-tree where there is one."""
    with closing(connected(path)) as con:
        t = table_of(con)
        if t is None:
            return 0
        what = f"count(DISTINCT id) FROM {quoted(t.rtree)}" if t.rtree else f"count(*) FROM {quoted(t.name)}"
        return con.execute(f"SELECT {what}").fetchone()[0]


def crs(path: str, table: str | None = None) -> str:
    """The reference system of a table of features."""
    with closing(connected(path)) as con:
        t = table_of(con, table)
        return t.crs if t else ""


# Geometries -----------------------------------------------------------------------


def _area(part: np.ndarray) -> float:
    x, y = part[:, 0], part[:, 1]
    return float(x[:-1] @ y[1:] - x[1:] @ y[:-1])


def _wkb(data: bytes, at: int, parts: list[np.ndarray]) -> tuple[int, int]:
    """(type, where the geometry ends); adds its parts."""
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    extra = bool(code & 0x80000000) + bool(code & 0x40000000)
    has_id, code = bool(code & 0x20000000), code & 0x0FFFFFFF
    extra += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
    kind, at = code % 1000, at + 5 + 4 * has_id
    width = 2 + extra

    def run(at: int, n: int) -> tuple[np.ndarray, int]:
        return np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)[:, :2].astype(float), at + 8 * n * width

    if kind == 1:
        part, at = run(at, 1)
        if not np.isnan(part).all():  # an empty point
            parts.append(part)
        return kind, at
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if kind == 2:
        part, at = run(at, n)
        if n:
            parts.append(part)
    elif kind == 3:
        for k in range(n):
            (m,) = struct.unpack_from(order + "I", data, at)
            part, at = run(at + 4, m)
            if m:
                parts.append(part[::-1] if (_area(part) < 0) != (k > 0) else part)
    elif kind in (4, 5, 6, 7):
        for _ in range(n):
            _, at = _wkb(data, at, parts)
    else:
        raise ConfigError(f"geometries of type {code} are not plain ones")
    return kind, at


def geometry(blob: bytes | None) -> tuple[str | None, list[np.ndarray] | None]:
    """(type, parts) of a GeoPackage blob; collections and empty geometries have no parts."""
    if blob is None:
        return None, None
    if blob[:2] != b"GP":
        raise ConfigError("a geometry lacks the GeoPackage header")
    flags = blob[3]
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[flags >> 1 & 7]
    parts: list[np.ndarray] = []
    kind, _ = _wkb(blob, 8 + envelope, parts)
    return _NAMES[kind], None if kind == 7 or not parts else parts


def _shapes(found: list[list[np.ndarray] | None]) -> pa.Array:
    """Arrays of points with a null between two parts."""
    gap = np.full((1, 2), np.nan)
    flat, gaps, sizes = [], [], []
    for parts in found:
        size = 0
        for k, p in enumerate(parts or ()):
            if k:
                flat.append(gap)
                gaps.append(np.ones(1, bool))
                size += 1
            flat.append(p)
            gaps.append(np.zeros(len(p), bool))
            size += len(p)
        sizes.append(size)
    xy = np.concatenate(flat) if flat else np.zeros((0, 2))
    none = np.concatenate(gaps) if gaps else np.zeros(0, bool)
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"], mask=pa.array(none))
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, points, type=_POINTS, mask=pa.array([p is None for p in found]))


# The source -----------------------------------------------------------------------


@dataclass
class Ids(InputPartition):
    low: int
    high: int

    def __init__(self, low: int, high: int):
        super().__init__(None)
        self.low, self.high = low, high


@dataclass
class GeoPackageReader(DataSourceReader):
    path: str
    table: Table | None
    box: tuple[float, float, float, float] | None
    size: int
    wheres: list[str] = field(default_factory=list)
    values: list = field(default_factory=list)

    def pushFilters(self, filters) -> Iterator:
        shown = {s: (c, kind) for c, s, kind in (self.table.columns if self.table else ())}
        if self.table:
            shown["fid"] = (self.table.key, "long")
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            yield f
            column, kind = shown.get(".".join(f.attribute) if hasattr(f, "attribute") else "", (None, None))
            if column is None or kind not in _PYTHON:
                continue
            name = column if column == "rowid" else quoted(column)
            if isinstance(f, (IsNull, IsNotNull)):
                # A value that Spark's type can't hold becomes null, so only what is null already may go.
                if isinstance(f, IsNotNull):
                    self.wheres.append(f"{name} IS NOT NULL")
            elif type(f) in signs and isinstance(f.value, _PYTHON[kind]):
                self.wheres.append(f"{name} {signs[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and f.value and len(f.value) < 500 and all(isinstance(v, _PYTHON[kind]) for v in f.value):
                self.wheres.append(f"{name} IN ({', '.join('?' * len(f.value))})")
                self.values += list(f.value)

    def _where(self) -> tuple[str, list]:
        t, wheres, values = self.table, list(self.wheres), list(self.values)
        if self.box is not None and t.rtree:
            wheres.append(f"{t.key if t.key == 'rowid' else quoted(t.key)} IN (SELECT id FROM {quoted(t.rtree)} WHERE maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)")
            x0, y0, x1, y1 = self.box
            values += [x0, x1, y0, y1]
        return " AND ".join(wheres) or "1", values

    def partitions(self) -> list[Ids]:
        if self.table is None:
            return []
        where, values = self._where()
        key = self.table.key if self.table.key == "rowid" else quoted(self.table.key)
        numbered = f"SELECT {key} AS k, (row_number() OVER (ORDER BY {key}) - 1) / {self.size} AS part FROM {quoted(self.table.name)} WHERE {where}"
        with closing(connected(self.path)) as con:
            return [Ids(a, b) for a, b in con.execute(f"SELECT min(k), max(k) FROM ({numbered}) GROUP BY part ORDER BY 1", values)]

    def read(self, partition: Ids | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        t = self.table
        where, values = self._where()
        key = t.key if t.key == "rowid" else quoted(t.key)
        picked = ", ".join([key, *(quoted(c) for c, _, _ in t.columns), quoted(t.geometry)])
        names = ["fid", *(shown for _, shown, _ in t.columns), "type", "points"]
        with closing(connected(self.path)) as con:
            con.text_factory = lambda b: b.decode("utf-8", "replace")
            rows = con.execute(f"SELECT {picked} FROM {quoted(t.name)} WHERE {key} BETWEEN ? AND ? AND {where} ORDER BY {key}", [partition.low, partition.high, *values])
            while batch := rows.fetchmany(BATCH):
                columns = list(zip(*batch))
                arrays = [pa.array(columns[0], pa.int64())]
                arrays += [pa.array([_value(v, kind) for v in column], _ARROW[kind]) for column, (_, _, kind) in zip(columns[1:-1], t.columns)]
                found = [geometry(b) for b in columns[-1]]
                if self.box is not None:
                    x0, y0, x1, y1 = self.box
                    keep = [k for k, (_, p) in enumerate(found) if p is not None and _meets(p, x0, y0, x1, y1)]
                    arrays = [a.take(pa.array(keep, pa.int64())) for a in arrays]
                    found = [found[k] for k in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([n for n, _ in found], pa.string()), _shapes([p for _, p in found])], names)


def _meets(parts: list[np.ndarray], x0: float, y0: float, x1: float, y1: float) -> bool:
    """Whether the box of the parts meets a box, as the R-tree holds rounded ones."""
    low, high = np.min([p.min(0) for p in parts], 0), np.max([p.max(0) for p in parts], 0)
    return bool(high[0] >= x0 and low[0] <= x1 and high[1] >= y0 and low[1] <= y1)


def _value(v, kind: str):
    """A value as its column's declared type; what is not of that kind is null."""
    if v is None or kind == "binary" and isinstance(v, bytes):
        return v
    try:
        if kind == "string":
            return v if isinstance(v, str) else str(v)
        if kind == "boolean":
            return bool(v)
        if kind == "double":
            return float(v)
        whole = int(v)
        return whole if whole == v and -(2**63 if kind == "long" else 2**31) <= whole < (2**63 if kind == "long" else 2**31) else None
    except (TypeError, ValueError):
        return None


class GeoPackageSource(DataSource):
    """format("geopackage"): fid, attributes, type and points; options table, box ("x0,y0,x1,y1") and range."""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def _table(self) -> Table | None:
        with closing(connected(self.options["path"])) as con:
            return table_of(con, self.options.get("table"))

    def schema(self) -> str:
        t = self._table()
        return t.schema if t else Table("", "", "", (), None, "").schema

    def reader(self, schema) -> GeoPackageReader:
        box = self.options.get("box")
        return GeoPackageReader(self.options["path"], self._table(), tuple(float(v) for v in box.split(",")) if box else None, int(self.options.get("range", RANGE)))


def read_geopackage(spark: SparkSession, path: str, table: str | None = None, box: tuple[float, float, float, float] | None = None, rows: int = RANGE) -> DataFrame:
    """fid, attributes, type and points of the features of a table (the first one), those whose boxes meet ``box``.

    Attributes named like the other columns get an underscore; a file without features
    gives an empty table.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoPackageSource)
    with closing(connected(path)) as con:
        table_of(con, table)
    reader = spark.read.format("geopackage").option("path", path).option("range", rows)
    if table is not None:
        reader = reader.option("table", table)
    return (reader if box is None else reader.option("box", ",".join(repr(float(v)) for v in box))).load()

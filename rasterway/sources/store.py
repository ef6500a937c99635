"""Layered stores: Parquet cell tables beside the grid they share and what is known of each layer."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterway.errors import ConfigError, LayerExistsError, MissingFileError, MissingLayerError
from rasterway.functions.geometry import parse_geojson, parse_wkt
from rasterway.grid import Grid, empty, layers, resampled, with_coordinates
from rasterway.sources.geopackage import read_geopackage

#: Cells along a side of the tiles that a store is partitioned by.
TILE = 512


class Store:
    """A folder with Parquet tables of cells and a one-row table of metadata a version.

    Layers are columns.  Layers that are written together share a table, which holds all
    cells, and metadata name the table of each: a change writes its own layers alone, a
    deletion no cells at all.  Metadata come last, so readers see the old or the new
    version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Metadata -----------------------------------------------------------------

    def _meta_path(self, version: int) -> str:
        return f"{self.path}/meta/v={version}"

    def exists(self) -> bool:
        return bool(self._versions())

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith("v="))

    def meta(self) -> dict:
        versions = self._versions()
        if not versions:
            raise MissingFileError(f"no store at {self.path}")
        return json.loads(self.spark.read.text(self._meta_path(versions[-1])).first()[0])

    @property
    def grid(self) -> Grid:
        return Grid.from_json(json.dumps(self.meta()["grid"]))

    def _commit(self, meta: dict) -> None:
        version = (self._versions() or [0])[-1] + 1
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(self._meta_path(version))

    def _table(self, cells: DataFrame) -> str:
        path = f"{self.path}/cells/{uuid.uuid4().hex}"
        keyed = cells.withColumn("tile", F.concat_ws("_", F.expr(f"row div {TILE}"), F.expr(f"col div {TILE}")))
        keyed.repartition("tile").write.partitionBy("tile").parquet(path)
        return path

    # Reading -------------------------------------------------------------------

    def _joined(self, names: Iterable[str] | None, tiles: list[str] | None = None) -> DataFrame:
        """row, col and ``names`` (None: all); only their tables, and these tiles, are read."""
        meta = self.meta()
        tables = {**dict.fromkeys(meta["coordinates"], meta["base"]), **meta["tables"]}
        names = list(tables) if names is None else list(names)
        if missing := [n for n in names if n not in tables]:
            raise MissingLayerError(f"no layers {missing} in {self.path}")
        by_table: dict[str, list[str]] = {}
        for n in names:
            by_table.setdefault(tables[n], []).append(n)

        def read(path: str, some: list[str]) -> DataFrame:
            table = self.spark.read.parquet(path)
            return (table if tiles is None else table.where(F.col("tile").isin(tiles))).select("row", "col", *some)

        frames = [read(path, some) for path, some in by_table.items()] or [read(meta["base"], [])]
        return reduce(lambda x, y: x.join(y, ["row", "col"]), frames).select("row", "col", *names)

    def cells(self, names: Iterable[str] | None = None) -> DataFrame:
        """The cell table, or row, col and some layers; only these are read."""
        return self._joined(names)

    def layers(self) -> list[str]:
        return list(self.meta()["tables"])

    def profile(self, name: str) -> dict:
        """Grid, type, no-data value and attributes of a layer."""
        meta = self.meta()
        if name not in self.layers():
            raise MissingLayerError(name)
        kind = dict(self.cells([name]).dtypes)[name]
        return {**meta["grid"], "dtype": kind, "count": 1, **meta["layers"].get(name, {})}

    def window(self, rows: tuple[int, int], cols: tuple[int, int], names: list[str]) -> DataFrame:
        """Cells of a window, missing outside the grid; only the tiles that it meets are read."""
        tiles = [f"{i}_{j}" for i in range(max(0, rows[0]) // TILE, max(0, rows[1] - 1) // TILE + 1) for j in range(max(0, cols[0]) // TILE, max(0, cols[1] - 1) // TILE + 1)]
        table = self._joined(names, tiles)
        wanted = empty(self.spark, Grid(rows[1] - rows[0], cols[1] - cols[0])).select((F.col("row") + rows[0]).alias("row"), (F.col("col") + cols[0]).alias("col"))
        return wanted.join(table, ["row", "col"], "left")

    # Writing -------------------------------------------------------------------

    def create(self, grid: Grid, overwrite: bool = False) -> "Store":
        """An empty store with coordinates of all cells."""
        if self.exists() and not overwrite:
            raise LayerExistsError(f"{self.path} exists")
        cells = with_coordinates(empty(self.spark, grid), grid)
        self._commit({"grid": json.loads(grid.to_json()), "layers": {}, "tables": {}, "base": self._table(cells), "coordinates": [c for c in cells.columns if c not in ("row", "col")]})
        return self

    def write(self, name: str, values: DataFrame, overwrite: bool = False, nodata: float | None = None, grid: Grid | None = None, **attributes) -> None:
        """``values`` (row, col, ``name``) as a layer; cells it lacks are missing."""
        self.write_all(values.select("row", "col", name), overwrite, {name: {"nodata": nodata, **attributes}}, grid)

    def write_all(self, values: DataFrame, overwrite: bool = False, attributes: dict[str, dict] | None = None, grid: Grid | None = None) -> None:
        """All layers of ``values`` in one join."""
        meta = self.meta()
        if grid is not None:
            self.grid.check(grid)
        names = layers(values)
        if (taken := [n for n in names if n in meta["tables"]]) and not overwrite:
            raise LayerExistsError(f"layers {taken} exist in {self.path}")
        path = self._table(self._joined([]).join(values.select("row", "col", *names), ["row", "col"], "left"))
        meta["layers"] = {**meta["layers"], **{n: (attributes or {}).get(n, {}) for n in names}}
        meta["tables"] = {**meta["tables"], **dict.fromkeys(names, path)}
        self._commit(meta)

    def delete(self, name: str) -> None:
        meta = self.meta()
        if name not in meta["tables"]:
            raise MissingLayerError(name)
        meta["layers"].pop(name, None)
        meta["tables"].pop(name)
        self._commit(meta)

    def write_resampled(self, source: DataFrame, own: Grid, names: list[str], overwrite: bool = False, fill: float | None = 0.0) -> None:
        """Layers of another grid in the same reference system, by the nearest cell."""
        self.write_all(resampled(source.select("row", "col", *names), own, self.grid, names, fill), overwrite)

    def built(self, name: str, config: dict) -> bool:
        """Whether the layer was built from this very definition."""
        return self.meta()["layers"].get(name, {}).get("build") == fingerprint(config)

    def extract(self, path: str, names: list[str] | None = None) -> None:
        """Each layer as a table (row, col, value) below ``path``."""
        for n in names or self.layers():
            self.cells([n]).withColumnRenamed(n, "value").write.parquet(f"{path}/{n}")


def fingerprint(config: dict) -> str:
    """sha1 of a definition, whatever the order of its keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()


def output_name(job: str, polarity, voltage, config: dict) -> str:
    """Name of a stored routing surface."""
    return f"{job}_p-{polarity}_v-{voltage}_h-{fingerprint(config)[:12]}"


def read_points(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; an empty file gives an empty table."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_features(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """A GeoPackage, GeoJSON lines, or a CSV with a wkt column, with points parsed into
    arrays (parts parted by nulls; a geometry collection has none)."""
    if path.endswith(".gpkg"):
        out = read_geopackage(spark, path)
        return out.where(where) if where else out
    if path.endswith((".geojsonl", ".json", ".geojson")):
        raw = spark.read.text(path)
        kind = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
        parsed = raw.select(F.from_json("value", kind).alias("f")).where("f.geometry IS NOT NULL")
        out = parsed.select("f.properties", F.col("f.geometry.type").alias("type"), parse_geojson(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("points"))
    elif path.endswith(".csv"):
        out = spark.read.option("header", True).csv(path).withColumn("points", parse_wkt(F.col("wkt")))
    else:
        raise ConfigError(f"unknown kind of feature file: {path}")
    return out.where(where) if where else out


#: Conditions of a table that nothing was written to yet.
NOTHING_STORED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def append(df: DataFrame, path: str) -> None:
    """Appends to a table whose first chunk has fixed the columns."""
    spark = df.sparkSession
    try:
        columns = spark.read.parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() not in NOTHING_STORED:
            raise
        df.write.parquet(path)
        return
    have = {f.name for f in df.schema}
    df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns]).write.mode("append").parquet(path)

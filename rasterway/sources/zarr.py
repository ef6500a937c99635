"""Layered rasters in Zarr (version 3) folders: a source and a sink that work chunk by chunk.

A store is a group of arrays over (y, x) or (band, y, x).  Layers that share their chunks
are read side by side, so a row has all of them without a join.  A partition takes some
chunks; filters on row and col choose chunks before any is opened, and a chunk that was
never written is its fill value.  Writing makes each chunk whole in one task, under
the name that the chunk always has, so a task that runs again leaves the same file; the
metadata that make an array a part of its store are written last.
"""

from __future__ import annotations

import gzip
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from rasterway.errors import ConfigError, LayerExistsError, MissingFileError, MissingLayerError, UnsupportedError
from rasterway.functions import projection
from rasterway.grid import Grid, layers
from rasterway.sources.geotiff import PARTITION_CELLS, Limits, opened

#: Cells along a side of written chunks.
CHUNK_SIDE = 512
META = "zarr.json"
#: Arrays of a store that are no layers.
PLACES = ("x", "y", "latitude", "longitude", "band", "spatial_ref")
# Fixed values of the format: data types, and Spark's for them.
_TYPES = {"bool": ("?", "boolean"), "int8": ("i1", "int"), "uint8": ("u1", "int"), "int16": ("i2", "int"), "uint16": ("u2", "int"), "int32": ("i4", "int"), "uint32": ("u4", "long"), "int64": ("i8", "long"), "uint64": ("u8", "long"), "float32": ("f4", "float"), "float64": ("f8", "double")}
_ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}
_WRITTEN = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


def _json(store, name: str) -> dict | None:
    if store.get_file_info(name).type != arrow_fs.FileType.File:
        return None
    with store.open_input_file(name) as f:
        return json.loads(f.read())


def _put(store, name: str, data: bytes) -> None:
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name) as f:
        f.write(data)


@dataclass(frozen=True)
class Array:
    """What an array's metadata say."""

    name: str
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    dtype: str
    kind: str
    fill: float
    codecs: tuple[str, ...]
    separator: str
    default_keys: bool
    attributes: str

    def key(self, at: tuple[int, ...]) -> str:
        name = self.separator.join(map(str, at))
        return f"{self.name}/c{self.separator}{name}" if self.default_keys else f"{self.name}/{name}"

    def decoded(self, data: bytes) -> np.ndarray:
        """A chunk, which is always whole."""
        order, axes = "<", None
        for text in self.codecs:
            c = json.loads(text)
            if c["name"] == "bytes":
                order = ">" if c.get("configuration", {}).get("endian") == "big" else "<"
            elif c["name"] == "transpose":
                axes = c["configuration"]["order"]
        for text in reversed(self.codecs):
            name = json.loads(text)["name"]
            if name == "zstd":
                data = _unzstd(data)
            elif name == "gzip":
                data = gzip.decompress(data)
            elif name == "crc32c":
                data = data[:-4]
        cells = np.frombuffer(data, np.dtype(self.dtype).newbyteorder(order), math.prod(self.chunk))
        shape = self.chunk if axes is None else tuple(self.chunk[a] for a in axes)
        cells = cells.reshape(shape)
        if axes is not None:
            cells = cells.transpose(np.argsort(axes))
        return cells.astype(np.dtype(self.dtype).newbyteorder("="))


def _unzstd(data: bytes) -> bytes:
    """A frame, whether it tells its size or not."""
    return pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()


def _fill(value, dtype: str):
    if isinstance(value, str):
        if value.startswith("0x"):
            size = np.dtype(dtype).itemsize
            return np.frombuffer(int(value, 16).to_bytes(size, "little"), dtype)[0].item()
        return float(value.replace("Infinity", "inf"))
    return value or 0


def array(path: str, name: str) -> Array:
    store, root = opened(path.rstrip("/"))
    m = _json(store, f"{root}/{name}/{META}")
    if m is None:
        raise MissingLayerError(f"no layer {name} in {path}")
    if m.get("zarr_format") != 3 or m.get("node_type") != "array" or m["data_type"] not in _TYPES or m["chunk_grid"]["name"] != "regular":
        raise UnsupportedError(f"{path}/{name} is not a plain array of version 3")
    codecs = [json.dumps(c) for c in m["codecs"]]
    unknown = {json.loads(c)["name"] for c in codecs} - {"bytes", "transpose", "zstd", "gzip", "crc32c"}
    if unknown:
        raise UnsupportedError(f"{path}/{name}: no codec {sorted(unknown)}")
    dtype, kind = _TYPES[m["data_type"]]
    keys = m.get("chunk_key_encoding", {"name": "default"})
    default = keys["name"] == "default"
    separator = keys.get("configuration", {}).get("separator", "/" if default else ".")
    return Array(name, tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), dtype, kind, _fill(m.get("fill_value"), dtype), tuple(codecs), separator, default, json.dumps(m.get("attributes", {})))


def layer_names(path: str) -> list[str]:
    """The finished layers of a store, by name."""
    store, root = opened(path.rstrip("/"))
    if _json(store, f"{root}/{META}") is None:
        raise MissingFileError(f"no store at {path}")
    names = [f.base_name for f in store.get_file_info(arrow_fs.FileSelector(root)) if f.type == arrow_fs.FileType.Directory]
    return sorted(n for n in names if n not in PLACES and _json(store, f"{root}/{n}/{META}") is not None)


def attributes(path: str, name: str) -> dict:
    return json.loads(array(path, name).attributes)


def grid_of(path: str) -> Grid:
    """The grid of a store: its spatial reference, or else what its coordinates give."""
    store, root = opened(path.rstrip("/"))
    names = layer_names(path)
    x = _json(store, f"{root}/x/{META}")
    y = _json(store, f"{root}/y/{META}")
    if x and y:
        ncols, nrows = x["shape"][0], y["shape"][0]
    elif names:
        nrows, ncols = array(path, names[0]).shape[-2:]
    else:
        raise ConfigError(f"{path} has neither coordinates nor layers")
    own = (_json(store, f"{root}/spatial_ref/{META}") or {}).get("attributes", {})
    crs = own.get("rasterway_crs") or own.get("crs_wkt", "") if own.get("rasterway_crs") or projection.known(own.get("crs_wkt", "")) else ""
    if "GeoTransform" in own:
        c, a, b, f, d, e = (float(v) for v in own["GeoTransform"].split())
        return Grid(nrows, ncols, a, b, c, d, e, f, crs)
    if not (x and y):
        return Grid(nrows, ncols, crs=crs)
    xs, ys = (_line(store, root, array(path, n)) for n in ("x", "y"))
    a = float(xs[-1] - xs[0]) / max(ncols - 1, 1) or 1.0
    e = float(ys[-1] - ys[0]) / max(nrows - 1, 1) or -1.0
    return Grid(nrows, ncols, a, 0.0, float(xs[0]) - a / 2, 0.0, e, float(ys[0]) - e / 2, crs)


def _line(store, root: str, own: Array) -> np.ndarray:
    """An array of one dimension."""
    out = np.full(own.shape[0], own.fill, own.dtype)
    for k in range(-(-own.shape[0] // own.chunk[0])):
        name = f"{root}/{own.key((k,))}"
        if store.get_file_info(name).type == arrow_fs.FileType.File:
            with store.open_input_file(name) as f:
                part = own.decoded(f.read())
            out[k * own.chunk[0] : (k + 1) * own.chunk[0]] = part[: own.shape[0] - k * own.chunk[0]]
    return out


# Reading --------------------------------------------------------------------------


@dataclass
class Chunks(InputPartition):
    chunks: tuple[tuple[int, int], ...]

    def __init__(self, chunks: tuple[tuple[int, int], ...]):
        super().__init__(None)
        self.chunks = chunks


class ZarrReader(DataSourceReader):
    def __init__(self, path: str, arrays: list[Array], band: int):
        self.path, self.arrays, self.band, self.limits = path.rstrip("/"), arrays, band, Limits()

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            self.limits.take(f)
            yield f

    def partitions(self) -> list[Chunks]:
        one = self.arrays[0]
        (nrows, ncols), (h, w) = one.shape[-2:], one.chunk[-2:]
        low, high = self.limits.low, self.limits.high
        spans = []
        for name, total, side in (("row", nrows, h), ("col", ncols, w)):
            spans.append(range(max(0, low[name]) // side, min(-(-total // side) - 1, high[name] // side) + 1))
        found = [(i, j) for i in spans[0] for j in spans[1]]
        each = max(1, PARTITION_CELLS // (h * w))
        return [Chunks(tuple(found[k : k + each])) for k in range(0, len(found), each)]

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.path)
        for i, j in partition.chunks if partition else ():
            one = self.arrays[0]
            (nrows, ncols), (h, w) = one.shape[-2:], one.chunk[-2:]
            top, left = i * h, j * w
            rows, cols = min(h, nrows - top), min(w, ncols - left)
            columns = [pa.array(np.repeat(np.arange(top, top + rows, dtype=np.int32), cols)), pa.array(np.tile(np.arange(left, left + cols, dtype=np.int32), rows))]
            for own in self.arrays:
                columns.append(pa.array(self._chunk(store, root, own, i, j)[:rows, :cols].ravel()).cast(_ARROW[own.kind], safe=False))
            yield pa.RecordBatch.from_arrays(columns, ["row", "col", *(a.name for a in self.arrays)])

    def _chunk(self, store, root: str, own: Array, i: int, j: int) -> np.ndarray:
        lead = len(own.shape) - 2
        at = ((self.band - 1) // own.chunk[0],) if lead else ()
        name = f"{root}/{own.key((*at, i, j))}"
        if store.get_file_info(name).type != arrow_fs.FileType.File:
            return np.full(own.chunk[-2:], own.fill, own.dtype)
        with store.open_input_file(name) as f:
            cells = own.decoded(f.read())
        return cells[(self.band - 1) % own.chunk[0]] if lead else cells


# Writing --------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    chunks: int


class ZarrWriter(DataSourceArrowWriter):
    """Rows of row, col and layers, those of a chunk together, to chunks of one array a layer."""

    def __init__(self, path: str, grid: Grid, names: list[str], kinds: list[str], fills: dict, own: dict, side: int, overwrite: bool):
        self.path, self.grid, self.names, self.kinds, self.side = path.rstrip("/"), grid, names, kinds, side
        self.fills = {n: fills.get(n, "NaN" if _TYPES[k][0].startswith("f") else 0) for n, k in zip(names, kinds)}
        self.own = own
        store, root = opened(self.path)
        taken = [n for n in names if _json(store, f"{root}/{n}/{META}") is not None]
        if taken and not overwrite:
            raise LayerExistsError(f"layers {taken} exist in {path}")
        for n in taken:  # until the end the old layer is not read with new chunks
            store.delete_dir(f"{root}/{n}")

    def _save(self, tile: tuple[int, int], parts: list[tuple]) -> None:
        store, root = opened(self.path)
        for k, (name, kind) in enumerate(zip(self.names, self.kinds)):
            dtype = np.dtype(_TYPES[kind][0])
            cells = np.full((self.side, self.side), _fill(self.fills[name], dtype.str), dtype)
            for rows, cols, values in parts:
                v = values[k]
                if v.null_count:
                    v = v.fill_null(pa.scalar(_fill(self.fills[name], dtype.str)).cast(v.type))
                cells[rows - tile[0] * self.side, cols - tile[1] * self.side] = v.to_numpy(zero_copy_only=False)
            data = pa.Codec("zstd", 3).compress(cells.astype(dtype.newbyteorder("<")).tobytes(), asbytes=True)
            _put(store, f"{root}/{name}/c/0/{tile[0]}/{tile[1]}", data)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        tile, parts, n = None, [], 0
        for batch in iterator:
            rows, cols = (batch.column(k).to_numpy() for k in (0, 1))
            i, j = rows // self.side, cols // self.side
            cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(rows))):
                if a == b:
                    continue
                own = int(i[a]), int(j[a])
                if tile is not None and own != tile:
                    self._save(tile, parts)
                    parts, n = [], n + 1
                tile = own
                parts.append((rows[a:b], cols[a:b], [batch.column(2 + k).slice(a, b - a) for k in range(len(self.names))]))
        if tile is not None:
            self._save(tile, parts)
            n += 1
        return Written(n)

    def commit(self, messages: list) -> None:
        store, root = opened(self.path)
        g = self.grid
        if _json(store, f"{root}/{META}") is None:
            for name, n, first, step in (("x", g.ncols, g.c + g.a / 2, g.a), ("y", g.nrows, g.f + g.e / 2, g.e)):
                _put(store, f"{root}/{name}/c/0", (first + step * np.arange(n)).astype("<f8").tobytes())
                _put(store, f"{root}/{name}/{META}", _meta([n], [n], "float64", 0.0, [name], {}, [_BYTES]))
            place = {"GeoTransform": " ".join(repr(v) for v in (g.c, g.a, g.b, g.f, g.d, g.e)), "rasterway_crs": g.crs, "crs_wkt": g.crs}
            _put(store, f"{root}/spatial_ref/{META}", _meta([], [], "int64", 0, [], place, [_BYTES]))
            _put(store, f"{root}/{META}", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}).encode())
        for name, kind in zip(self.names, self.kinds):
            own = {**self.own.get(name, {}), "grid_mapping": "spatial_ref"}
            _put(store, f"{root}/{name}/{META}", _meta([1, g.nrows, g.ncols], [1, self.side, self.side], kind, self.fills[name], ["band", "y", "x"], own, [_BYTES, {"name": "zstd", "configuration": {"level": 3, "checksum": False}}]))

    def abort(self, messages: list) -> None:
        """Chunks without metadata are no layer; the next write replaces them."""


_BYTES = {"name": "bytes", "configuration": {"endian": "little"}}


def _meta(shape, chunk, kind, fill, dims, own, codecs) -> bytes:
    return json.dumps(
        {
            "zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}},
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": codecs, "attributes": own, "dimension_names": dims,
        }
    ).encode()


class ZarrSource(DataSource):
    """format("zarr"): row, col and the layers of option layers (JSON list); option band from 1."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _arrays(self) -> list[Array]:
        arrays = [array(self.options["path"], n) for n in json.loads(self.options["layers"])]
        if len({(a.shape[-2:], a.chunk[-2:]) for a in arrays}) > 1:
            raise ConfigError("layers of other chunks are read apart")
        return arrays

    def schema(self) -> str:
        return ", ".join(["row int, col int", *(f"`{a.name}` {a.kind}" for a in self._arrays())])

    def reader(self, schema) -> ZarrReader:
        return ZarrReader(self.options["path"], self._arrays(), int(self.options.get("band", 1)))

    def writer(self, schema, overwrite: bool) -> ZarrWriter:
        names = [f.name for f in schema.fields[2:]]
        kinds = [f.dataType.simpleString() for f in schema.fields[2:]]
        if unknown := set(kinds) - set(_WRITTEN):
            raise UnsupportedError(f"no arrays of {sorted(unknown)}")
        return ZarrWriter(self.options["path"], Grid.from_json(self.options["grid"]), names, [_WRITTEN[k] for k in kinds], json.loads(self.options.get("fills", "{}")), json.loads(self.options.get("attributes", "{}")), int(self.options.get("side", CHUNK_SIDE)), overwrite)


def _registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZarrSource)


def read_zarr(spark: SparkSession, path: str, names: list[str] | None = None, band: int = 1) -> DataFrame:
    """row, col and some layers (None: all) of a store; those with the same chunks are read together, others join."""
    _registered(spark)
    names = layer_names(path) if names is None else names
    by_chunks: dict[tuple, list[str]] = {}
    for n in names:
        a = array(path, n)
        by_chunks.setdefault((a.shape[-2:], a.chunk[-2:]), []).append(n)
    if len({shape for shape, _ in by_chunks}) > 1:
        raise ConfigError(f"layers {names} have several shapes")
    out = None
    for some in by_chunks.values():
        frame = spark.read.format("zarr").option("path", path).option("band", band).option("layers", json.dumps(some)).load()
        out = frame if out is None else out.join(frame, ["row", "col"])
    if out is None:
        raise MissingLayerError(f"{path} has no layers")
    return out.select("row", "col", *names)


def write_zarr(cells: DataFrame, grid: Grid, path: str, names: list[str] | None = None, fills: dict | None = None, attributes: dict[str, dict] | None = None, side: int = CHUNK_SIDE, overwrite: bool = False) -> None:
    """Layers of ``cells`` into a store, which is made if it is not there; missing cells take the layer's fill value (NaN, or 0 for integers)."""
    _registered(cells.sparkSession)
    store, root = opened(path.rstrip("/"))
    if _json(store, f"{root}/{META}") is not None:
        grid_of(path).check(grid)
    tile = [F.expr(f"row div {side}"), F.expr(f"col div {side}")]
    dealt = cells.select(F.col("row").cast("int"), F.col("col").cast("int"), *(names or layers(cells))).where(grid.inside(F.col("row"), F.col("col")))
    out = dealt.repartition(*tile).sortWithinPartitions(*tile).write.format("zarr").option("path", path).option("grid", grid.to_json()).option("side", side)
    out.option("fills", json.dumps(fills or {})).option("attributes", json.dumps(attributes or {})).mode("overwrite" if overwrite else "append").save()

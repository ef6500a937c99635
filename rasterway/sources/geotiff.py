"""GeoTIFF rasters as a data source, read and written by blocks.

Reading parses the directory of a file once, on the driver, and deals its strips or tiles
to tasks, which fetch and decode only their own byte ranges.  Filters on row, col and band
choose blocks before anything is read.  Writing makes one tiled file for each square of
cells under a name of its own and commits by an index file, written last, which names the
files that count: a task that runs twice leaves one copy, and readers of the folder see
all of a raster or none of it.

Files are opened through Arrow's file systems, so local paths and the stores Arrow knows do.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from rasterway.errors import ConfigError, MissingFileError, UnsupportedError
from rasterway.functions import projection
from rasterway.grid import Grid, layers

#: Cells that a partition should read, and cells along a side of written files and of their blocks.
PARTITION_CELLS, FILE_SIDE, BLOCK_SIDE = 1 << 22, 512, 256
INDEX = "index.json"
# Fixed values of the format: sizes and codes of field types; sample kinds; geographic keys.
_FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_SAMPLE = {1: "u", 2: "i", 3: "f"}
_MODEL, _RASTER, _CITATION, _GEOGRAPHIC, _PROJECTED, _METHOD = 1024, 1025, 1026, 2048, 3072, 3075
_PROJ_KEYS = {3078: "lat_1", 3079: "lat_2", 3080: "lon_0", 3081: "lat_0", 3082: "x_0", 3083: "y_0", 3084: "lon_0", 3085: "lat_0", 3086: "x_0", 3087: "y_0", 3088: "lon_0", 3089: "lat_0", 3092: "k_0"}
_METHODS = {1: "tmerc", 7: "merc", 8: "lcc", 9: "lcc", 11: "aea"}
_TYPES = {"u1": "int", "i1": "int", "u2": "int", "i2": "int", "i4": "int", "u4": "long", "u8": "long", "i8": "long", "f4": "float", "f8": "double"}


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system of a path, and the path there."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Layout:
    """What a file's directory says: where blocks lie and how their bytes are to be read."""

    path: str
    height: int
    width: int
    bands: int
    dtype: str
    compression: int
    predictor: int
    block_height: int
    block_width: int
    separate: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    nodata: float | None
    transform: tuple[float, ...]
    crs: str
    row0: int = 0
    col0: int = 0

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.block_height)

    @property
    def grid(self) -> Grid:
        return Grid(self.height, self.width, *self.transform, crs=self.crs)

    def box(self, block: int) -> tuple[int, int, int, int, int]:
        """(first band, row0, row1, col0, col1) of a block."""
        band, at = divmod(block, self.across * self.down)
        i, j = divmod(at, self.across)
        top, left = i * self.block_height, j * self.block_width
        return band if self.separate else 0, top, min(top + self.block_height, self.height), left, min(left + self.block_width, self.width)


def _fields(f, order: str) -> dict[int, tuple]:
    """Tags of the first directory and their values."""
    f.seek(0)
    head = f.read(16)
    if struct.unpack(order + "H", head[2:4])[0] == 43:
        (at,), count, entry, inline, offset = struct.unpack(order + "Q", head[8:16]), "Q", 20, 8, "Q"
    else:
        (at,), count, entry, inline, offset = struct.unpack(order + "I", head[4:8]), "H", 12, 4, "I"
    f.seek(at)
    (n,) = struct.unpack(order + count, f.read(struct.calcsize(count)))
    body, out = f.read(n * entry), {}
    for k in range(n):
        raw = body[k * entry : (k + 1) * entry]
        tag, kind = struct.unpack(order + "HH", raw[:4])
        (number,) = struct.unpack(order + offset, raw[4 : 4 + inline])
        if kind not in _FIELD:
            continue
        code = _FIELD[kind]
        form = f"{order}{number}s" if code == "s" else order + code * number if len(code) > 1 else f"{order}{number}{code}"
        size = struct.calcsize(form)
        data = raw[4 + inline : 4 + inline + size]
        if size > inline:
            f.seek(struct.unpack(order + offset, raw[4 + inline :])[0])
            data = f.read(size)
        out[tag] = struct.unpack(form, data)
    return out


def _crs(t: dict[int, tuple]) -> str:
    keys = t.get(34735, (1, 1, 0, 0))
    found: dict[int, object] = {}
    for k in range(4, 4 + 4 * keys[3], 4):
        key, place, number, value = keys[k : k + 4]
        if place == 0:
            found[key] = value
        elif place == 34737:
            found[key] = t[34737][0][value : value + number].decode("latin-1").rstrip("|\0")
        elif place == 34736:
            found[key] = t[34736][value]
    for key in (_PROJECTED, _GEOGRAPHIC):
        code = found.get(key)
        if isinstance(code, int) and 0 < code < 32767:
            return f"EPSG:{code}"
    if projection.known(str(found.get(_CITATION, ""))):
        return str(found[_CITATION])
    if found.get(_METHOD) in _METHODS:
        given = "".join(f" +{name}={found[key]}" for key, name in _PROJ_KEYS.items() if key in found)
        axis = f" +a={found[2057]} +rf={found[2059]}" if 2057 in found and 2059 in found else ""
        return f"+proj={_METHODS[found[_METHOD]]}{given}{axis}"
    return ""


def layout(path: str) -> Layout:
    """The layout of one file."""
    store, name = opened(path)
    if store.get_file_info(name).type != arrow_fs.FileType.File:
        raise MissingFileError(f"no file at {path}")
    with store.open_input_file(name) as f:
        magic = f.read(4)
        order = {b"II": "<", b"MM": ">"}.get(magic[:2])
        if order is None or struct.unpack(order + "H", magic[2:])[0] not in (42, 43):
            raise ConfigError(f"{path} is not a TIFF file")
        t = _fields(f, order)
    one = lambda tag, default=None: t[tag][0] if tag in t else default
    height, width, bands = one(257), one(256), one(277, 1)
    bits, kinds = set(t.get(258, (1,))), set(t.get(339, (1,)))
    if len(bits) > 1 or len(kinds) > 1 or next(iter(bits)) not in (8, 16, 32, 64) or next(iter(kinds)) not in _SAMPLE:
        raise UnsupportedError(f"{path}: samples of {bits} bits, kinds {kinds}")
    dtype = _SAMPLE[kinds.pop()] + str(bits.pop() // 8)
    if one(259, 1) not in (1, 5, 8, 32946) or dtype not in _TYPES:
        raise UnsupportedError(f"{path}: compression {one(259, 1)}, samples {dtype}")
    tiled = 322 in t
    block_height, block_width = (one(323), one(322)) if tiled else (min(one(278, height), height), width)
    offsets, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    if 34264 in t:
        m = t[34264]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in t and 33922 in t:
        (sx, sy), (i, j, _, x, y) = t[33550][:2], t[33922][:5]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    nodata = t[42113][0].split(b"\0")[0].strip() if 42113 in t else b""
    return Layout(path, height, width, bands, order + dtype, one(259, 1), one(317, 1), block_height, block_width, one(284, 1) == 2 and bands > 1, tuple(offsets), tuple(sizes), float(nodata) if nodata else None, transform, _crs(t))


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that change width one entry early."""
    out, table, previous = [], [], b""
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    held = bits = 0
    width, at = 9, 0
    while True:
        while bits < width and at < len(data):
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFFFF, bits + 8, at + 1
        if bits < width:
            break
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == 257:
            break
        if code == 256:
            table, width, previous = list(start), 9, b""
            continue
        if not table:
            table = list(start)
        entry = table[code] if code < len(table) else previous + previous[:1]
        if previous:
            table.append(previous + entry[:1])
        out.append(entry)
        previous = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def decoded(raw: bytes, own: Layout, rows: int) -> np.ndarray:
    """Samples (row, col, band) of a block of so many rows, padding of tiles included."""
    bands = 1 if own.separate else own.bands
    data = raw if own.compression == 1 else _lzw(raw) if own.compression == 5 else zlib.decompress(raw)
    dtype = np.dtype(own.dtype)
    need = rows * own.block_width * bands
    if own.predictor == 3:
        planes = np.frombuffer(data, np.uint8, need * dtype.itemsize).reshape(rows, -1, bands)
        planes = np.cumsum(planes, 1, dtype=np.uint8).reshape(rows, dtype.itemsize, own.block_width * bands)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, own.block_width, bands).astype(dtype.newbyteorder("="))
    out = np.frombuffer(data, dtype, need).reshape(rows, own.block_width, bands).astype(dtype.newbyteorder("="))
    return np.cumsum(out, 1, dtype=out.dtype) if own.predictor == 2 else out


@dataclass
class Blocks(InputPartition):
    """Blocks of one file for one task."""

    own: Layout
    blocks: tuple[int, ...]

    def __init__(self, own: Layout, blocks: tuple[int, ...]):
        super().__init__(None)
        # A task needs the places of its own blocks only.
        self.places = tuple((own.offsets[b], own.sizes[b]) for b in blocks)
        self.own, self.blocks = Layout(**{**asdict(own), "offsets": (), "sizes": ()}), blocks


class Limits:
    """Least and greatest row, column and band that filters leave."""

    def __init__(self):
        self.low, self.high = dict.fromkeys(("row", "col", "band"), -(2**62)), dict.fromkeys(("row", "col", "band"), 2**62)

    def take(self, f) -> None:
        name = ".".join(f.attribute) if hasattr(f, "attribute") else None
        if name not in self.low:
            return
        if isinstance(f, In):
            low, high = (min(f.value), max(f.value)) if f.value else (1, 0)
        elif isinstance(f, EqualTo):
            low = high = f.value
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low, high = f.value + isinstance(f, GreaterThan), 2**62
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            low, high = -(2**62), f.value - isinstance(f, LessThan)
        else:
            return
        self.low[name], self.high[name] = max(self.low[name], low), min(self.high[name], high)

    def meets(self, own: Layout, block: int) -> bool:
        band, top, bottom, left, right = own.box(block)
        spans = {"row": (top + own.row0, bottom + own.row0 - 1), "col": (left + own.col0, right + own.col0 - 1), "band": (band + 1, band + 1 if own.separate else own.bands)}
        return all(a <= self.high[k] and b >= self.low[k] for k, (a, b) in spans.items())


def _files(path: str) -> tuple[list[Layout], Grid]:
    """The files of a raster, a single one or those of an index, and its grid."""
    store, name = opened(path)
    if store.get_file_info(name).type != arrow_fs.FileType.Directory:
        own = layout(path)
        return [own], own.grid
    at = f"{name.rstrip('/')}/{INDEX}"
    if store.get_file_info(at).type != arrow_fs.FileType.File:
        raise MissingFileError(f"no finished raster at {path}")
    with store.open_input_file(at) as f:
        index = json.loads(f.read())
    grid = Grid(**index["grid"])
    # Tiles share all but their places; a file's directory is read by the task that needs its blocks.
    return [Layout(**{**index["layout"], "path": f"{path.rstrip('/')}/{t['file']}", "offsets": (), "sizes": (), **{k: t[k] for k in ("height", "width", "row0", "col0")}, "transform": tuple(index["layout"]["transform"])}) for t in index["files"]], grid


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, mask: bool):
        self.files, self.mask, self.limits = _files(path)[0], mask, Limits()

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            self.limits.take(f)
            yield f

    def partitions(self) -> list[Blocks]:
        out = []
        for own in self.files:
            blocks = [b for b in range(own.across * own.down * (own.bands if own.separate else 1)) if self.limits.meets(own, b)]
            each = max(1, PARTITION_CELLS // (own.block_height * own.block_width))
            if own.offsets:
                out += [Blocks(own, tuple(blocks[k : k + each])) for k in range(0, len(blocks), each)]
            elif blocks:
                out.append(Indexed(own, tuple(blocks)))
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no partition at all is read as one
            return
        if isinstance(partition, Indexed):
            whole = layout(partition.own.path)
            partition = Blocks(Layout(**{**asdict(whole), "row0": partition.own.row0, "col0": partition.own.col0}), partition.blocks)
        own = partition.own
        store, name = opened(own.path)
        with store.open_input_file(name) as f:
            for block, (offset, size) in zip(partition.blocks, partition.places):
                band, top, bottom, left, right = own.box(block)
                if size:
                    f.seek(offset)
                    raw = f.read(size)
                    cells = self._cells(raw, own, bottom - top)[: bottom - top, : right - left]
                else:
                    cells = np.full((bottom - top, right - left, 1 if own.separate else own.bands), own.nodata or 0, np.dtype(own.dtype).newbyteorder("="))
                yield self._batch(own, cells, band, top, left)

    @staticmethod
    def _cells(raw: bytes, own: Layout, least: int) -> np.ndarray:
        """Last strips may be short, tiles never are."""
        try:
            return decoded(raw, own, own.block_height)
        except ValueError:
            return decoded(raw, own, least)

    def _batch(self, own: Layout, cells: np.ndarray, band: int, top: int, left: int) -> pa.RecordBatch:
        h, w, b = cells.shape
        kind = {"int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}[_TYPES[own.dtype[1:]]]
        values = cells.ravel()
        empty = values == own.nodata if self.mask and own.nodata is not None else None
        if empty is not None and own.nodata != own.nodata:
            empty = np.isnan(values)
        rows = np.repeat(np.arange(h, dtype=np.int32) + np.int32(top + own.row0), w * b)
        cols = np.tile(np.repeat(np.arange(w, dtype=np.int32) + np.int32(left + own.col0), b), h)
        bands = np.tile(np.arange(b, dtype=np.int32) + np.int32(band + 1), h * w)
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols), pa.array(bands), pa.array(values, mask=empty).cast(kind, safe=False)], ["row", "col", "band", "value"])


@dataclass
class Indexed(InputPartition):
    """Blocks of a file whose directory is still to be read."""

    own: Layout
    blocks: tuple[int, ...]

    def __init__(self, own: Layout, blocks: tuple[int, ...]):
        super().__init__(None)
        self.own, self.blocks = own, blocks


# Writing --------------------------------------------------------------------------


def _geo_keys(crs: str) -> tuple[tuple[int, ...], str]:
    """The directory of geographic keys and its text."""
    geographic = not projection.known(crs) or projection.system(crs).geographic
    keys = [(_MODEL, 0, 1, 2 if geographic else 1), (_RASTER, 0, 1, 1)]
    text = f"{crs}|" if crs else ""
    if crs:
        keys.append((_CITATION, 34737, len(text), 0))
        code = crs.upper().removeprefix("EPSG:")
        keys.append((_GEOGRAPHIC if geographic else _PROJECTED, 0, 1, int(code) if code.isdigit() and int(code) < 32767 else 32767))
    return (1, 1, 0, len(keys), *(x for k in sorted(keys) for x in k)), text


def encoded(cells: np.ndarray, grid: Grid, nodata: float | None, side: int = BLOCK_SIDE) -> bytes:
    """A tiled file of one band, compressed by deflate."""
    height, width = cells.shape
    dtype = cells.dtype.newbyteorder("<")
    blocks = []
    for top in range(0, height, side):
        for left in range(0, width, side):
            block = np.zeros((side, side), dtype)
            part = cells[top : top + side, left : left + side]
            block[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(block.tobytes(), 6))
    keys, text = _geo_keys(grid.crs)
    at = np.cumsum([8] + [len(b) + len(b) % 2 for b in blocks]).tolist()
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    tags: list[tuple[int, str, tuple]] = [
        (256, "I", (width,)), (257, "I", (height,)), (258, "H", (dtype.itemsize * 8,)), (259, "H", (8,)), (262, "H", (1,)), (277, "H", (1,)), (322, "I", (side,)), (323, "I", (side,)),
        (324, "I", tuple(at[:-1])), (325, "I", tuple(map(len, blocks))), (339, "H", (kind,)), (33550, "d", (grid.a, -grid.e, 0.0)), (33922, "d", (0.0, 0.0, 0.0, grid.c, grid.f, 0.0)), (34735, "H", keys),
    ]
    if grid.b or grid.d or grid.e > 0:
        tags = [t for t in tags if t[0] not in (33550, 33922)] + [(34264, "d", (grid.a, grid.b, 0.0, grid.c, grid.d, grid.e, 0.0, grid.f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))]
    if text:
        tags.append((34737, "s", (text.encode() + b"\0",)))
    if nodata is not None:
        tags.append((42113, "s", (f"{nodata:.17g}".encode() + b"\0",)))
    entries, extra, begin = [], b"", at[-1] + 2 + 12 * len(tags) + 4
    for tag, code, values in sorted(tags):
        data = values[0] if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        number = len(data) if code == "s" else len(values)
        place = data.ljust(4, b"\0")
        if len(data) > 4:
            place = struct.pack("<I", begin + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        entries.append(struct.pack("<HHI", tag, {"H": 3, "I": 4, "d": 12, "s": 2}[code], number) + place)
    body = b"".join(b + b"\0" * (len(b) % 2) for b in blocks)
    return b"II*\0" + struct.pack("<I", at[-1]) + body + struct.pack("<H", len(tags)) + b"".join(entries) + b"\0\0\0\0" + extra


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class GeoTiffWriter(DataSourceArrowWriter):
    """Rows of row, col and value, those of a square together, to files."""

    def __init__(self, path: str, grid: Grid, dtype: str, nodata: float | None, overwrite: bool, side: int, block: int):
        self.path, self.grid, self.dtype, self.nodata = path.rstrip("/"), grid, dtype, nodata
        self.side, self.block = side, block
        store, name = opened(self.path)
        if store.get_file_info(f"{name}/{INDEX}").type == arrow_fs.FileType.File and not overwrite:
            raise ConfigError(f"{path} holds a raster")
        store.create_dir(name, recursive=True)

    def _save(self, tile: tuple[int, int], parts: list[tuple]) -> dict:
        i, j = tile
        top, left = i * self.side, j * self.side
        height, width = min(self.side, self.grid.nrows - top), min(self.side, self.grid.ncols - left)
        cells = np.full((height, width), self.nodata or 0, np.dtype(self.dtype))
        for rows, cols, values in parts:
            cells[rows - top, cols - left] = values
        g = self.grid
        own = Grid(height, width, g.a, g.b, g.c + g.a * left + g.b * top, g.d, g.e, g.f + g.d * left + g.e * top, g.crs)
        file = f"tile_{i}_{j}-{uuid.uuid4().hex}.tif"
        store, name = opened(self.path)
        with store.open_output_stream(f"{name}/{file}") as f:
            f.write(encoded(cells, own, self.nodata, self.block))
        return {"file": file, "height": height, "width": width, "row0": top, "col0": left}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, tile, parts = [], None, []
        for batch in iterator:
            rows, cols = (batch.column(k).to_numpy() for k in (0, 1))
            values = batch.column(2)
            if values.null_count:
                if self.nodata is None:
                    raise ConfigError("missing cells need a no-data value")
                values = values.fill_null(pa.scalar(self.nodata, values.type))
            values = values.to_numpy()
            i, j = rows // self.side, cols // self.side
            cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(rows))):
                if a == b:
                    continue
                own = int(i[a]), int(j[a])
                if tile is not None and own != tile:
                    files.append(self._save(tile, parts))
                    parts = []
                tile = own
                parts.append((rows[a:b], cols[a:b], values[a:b]))
        if tile is not None:
            files.append(self._save(tile, parts))
        return Written(files)

    def commit(self, messages: list) -> None:
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: (f["row0"], f["col0"]))
        g = self.grid
        one = Layout("", self.side, self.side, 1, "<" + self.dtype, 8, 1, self.block, self.block, False, (), (), self.nodata, (g.a, g.b, g.c, g.d, g.e, g.f), g.crs)
        store, name = opened(self.path)
        with store.open_output_stream(f"{name}/{INDEX}") as f:
            f.write(json.dumps({"grid": asdict(g), "layout": asdict(one), "files": files}).encode())
        # What failed attempts and former rasters have left.
        keep = {f["file"] for f in files}
        for left in store.get_file_info(arrow_fs.FileSelector(name)):
            if left.base_name.endswith(".tif") and left.base_name not in keep:
                store.delete_file(left.path)

    def abort(self, messages: list) -> None:
        store, name = opened(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                store.delete_file(f"{name}/{f['file']}")


class GeoTiffSource(DataSource):
    """format("geotiff"): row, col, band (from 1) and value; option mask turns no-data values into nulls."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        files, _ = _files(self.options["path"])
        kinds = {_TYPES[f.dtype[1:]] for f in files}
        return f"row int, col int, band int, value {kinds.pop() if len(kinds) == 1 else 'double'}"

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(self.options["path"], self.options.get("mask", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> GeoTiffWriter:
        kinds = {"integer": "i4", "int": "i4", "long": "i8", "bigint": "i8", "short": "i2", "smallint": "i2", "byte": "i1", "tinyint": "i1", "float": "f4", "double": "f8"}
        kind = schema.fields[2].dataType.simpleString()
        if kind not in kinds:
            raise UnsupportedError(f"no samples of type {kind}")
        nodata = self.options.get("nodata")
        return GeoTiffWriter(self.options["path"], Grid.from_json(self.options["grid"]), kinds[kind], None if nodata is None else float(nodata), overwrite, int(self.options.get("side", FILE_SIDE)), int(self.options.get("block", BLOCK_SIDE)))


def _registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)


def read_geotiff(spark: SparkSession, path: str, name: str = "value", band: int | None = 1, mask: bool = True) -> tuple[DataFrame, Grid]:
    """(cells, grid) of a file or of a folder written here: row, col and the band as ``name``, or all bands with band None.

    Cells that hold the no-data value are null (with ``mask``); so a file has every cell of
    its grid, while a folder lacks squares that nothing was written to.
    """
    grid = _files(path)[1]
    _registered(spark)
    cells = spark.read.format("geotiff").option("path", path).option("mask", str(mask).lower()).load()
    if band is not None:
        cells = cells.where(F.col("band") == band).drop("band")
    return cells.withColumnRenamed("value", name), grid


def write_geotiff(cells: DataFrame, grid: Grid, path: str, name: str | None = None, nodata: float | None = None, overwrite: bool = False, side: int = FILE_SIDE, block: int = BLOCK_SIDE) -> None:
    """A layer of ``cells`` as a folder of tiled files with an index; missing cells take the no-data value."""
    _registered(cells.sparkSession)
    name = name or layers(cells)[0]
    tile = [F.expr(f"row div {side}"), F.expr(f"col div {side}")]
    dealt = cells.select(F.col("row").cast("int"), F.col("col").cast("int"), F.col(name).alias("value"))
    dealt = dealt.where(grid.inside(F.col("row"), F.col("col"))).repartition(*tile).sortWithinPartitions(*tile)
    out = dealt.write.format("geotiff").option("path", path).option("grid", grid.to_json()).option("side", side).option("block", block)
    (out if nodata is None else out.option("nodata", repr(nodata))).mode("overwrite" if overwrite else "append").save()

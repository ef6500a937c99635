import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterway.errors import ConfigError, MissingFileError, UnsupportedError
from rasterway.grid import Grid
from rasterway.sources import geotiff as T


def lzw(data):
    """A plain encoder: codes grow, and the table starts anew before it is full."""
    bits, table, width, w = [], {}, 9, b""

    def put(code):
        bits.extend(code >> k & 1 for k in range(width - 1, -1, -1))

    def clear():
        nonlocal table, width
        put(256)
        table, width = {bytes([k]): k for k in range(256)}, 9

    clear()
    size = 258
    for b in data:
        c = w + bytes([b])
        if c in table:
            w = c
            continue
        put(table[w])
        table[c] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size > 4093:
            clear()
            size = 258
        w = bytes([b])
    if w:
        put(table[w])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    bits += [0] * (-len(bits) % 8)
    return bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))


def tiff(cells, order="<", big=False, tile=None, strip=None, compression=1, predictor=1, separate=False, extra=(), gap=None):
    """A file of cells (row, col, band), byte by byte."""
    h, w, n = cells.shape
    dt = cells.dtype.newbyteorder(order)
    blocks = []
    for band in range(n) if separate else [None]:
        part = cells if band is None else cells[:, :, band : band + 1]
        bh, bw = tile or (strip or h, w)
        for i in range(0, h, bh):
            for j in range(0, w, bw):
                b = part[i : i + bh, j : j + bw]
                if tile:
                    full = np.zeros((bh, bw, b.shape[2]), cells.dtype)
                    full[: b.shape[0], : b.shape[1]] = b
                    b = full
                if predictor == 2:
                    d = b.copy()
                    d[:, 1:] = b[:, 1:] - b[:, :-1]
                    raw = d.astype(dt).tobytes()
                elif predictor == 3:
                    rows = []
                    for r in b:
                        planes = np.frombuffer(r.astype(b.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(-1, b.dtype.itemsize).T.ravel()
                        planes = planes.reshape(-1, b.shape[2]) if b.shape[2] > 1 else planes.reshape(-1, 1)
                        d = planes.copy()
                        d[1:] = planes[1:] - planes[:-1]
                        rows.append(d.tobytes())
                    raw = b"".join(rows)
                else:
                    raw = b.astype(dt).tobytes()
                blocks.append({1: bytes, 5: lzw, 8: zlib.compress, 32946: zlib.compress}[compression](raw))
    if gap is not None:
        blocks[gap] = b""
    kind = {"u": 1, "i": 2, "f": 3}[cells.dtype.kind]
    q, start = ("Q", 16) if big else ("I", 8)
    places = np.cumsum([start] + [len(b) for b in blocks])[:-1].tolist()
    if gap is not None:
        places[gap] = 0
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [cells.dtype.itemsize * 8] * n), (259, "H", [compression]), (277, "H", [n]), (284, "H", [2 if separate else 1]), (317, "H", [predictor]), (339, "H", [kind] * n), *extra]
    tags += [(322, "I", [tile[1]]), (323, "I", [tile[0]]), (324, q, places), (325, q, [len(b) for b in blocks])] if tile else [(273, q, places), (278, "I", [strip or h]), (279, q, [len(b) for b in blocks])]
    body = b"".join(blocks)
    at = start + len(body)
    width = 8 if big else 4
    begin = at + (8 if big else 2) + len(tags) * (20 if big else 12) + width
    out, tail = b"", b""
    for tag, code, values in sorted(tags, key=lambda t: t[0]):
        data = values if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        n_values = len(data) if code == "s" else len(values)
        place = data.ljust(width, b"\0") if len(data) <= width else struct.pack(order + q, begin + len(tail))
        tail += data if len(data) > width else b""
        out += struct.pack(order + "HH" + q, tag, {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}[code], n_values) + place
    name = b"II" if order == "<" else b"MM"
    head = name + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return head + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + out + b"\0" * width + tail


GEO = [(33550, "d", [90.0, 90.0, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 1000.0, 5000.0, 0.0]), (34735, "H", [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 26915]), (42113, "s", b"7\0")]
LAYOUTS = [
    dict(), dict(strip=5), dict(strip=4, compression=8, predictor=2), dict(tile=(16, 16)), dict(tile=(16, 32), compression=5, predictor=2), dict(order=">", strip=6, compression=32946), dict(big=True, tile=(16, 16), compression=8),
    dict(order=">", big=True, strip=7, compression=5), dict(strip=9, compression=8, predictor=3), dict(tile=(16, 16), order=">", predictor=3, compression=5), dict(tile=(16, 16), separate=True, compression=8), dict(strip=5, separate=True),
]


@pytest.mark.parametrize("k", range(len(LAYOUTS)))
def test_reads_every_layout(spark, tmp_path, k):
    how = LAYOUTS[k]
    rng = np.random.default_rng(k)
    for bands, dtype in ((1, "f4" if how.get("predictor") == 3 else "i2"), (3, "f8" if how.get("predictor") == 3 else "u1")):
        cells = rng.integers(0, 100, (23, 37, bands)).astype(dtype)
        if how.get("predictor") == 3:
            cells = cells * cells.dtype.type(0.37) - 5
        path = str(tmp_path / f"{bands}.tif")
        with open(path, "wb") as f:
            f.write(tiff(cells, extra=GEO, **how))
        frame, grid = T.read_geotiff(spark, path, band=None, mask=False)
        got = np.zeros_like(cells)
        rows = frame.collect()
        assert len(rows) == cells.size
        for r in rows:
            got[r.row, r.col, r.band - 1] = r.value
        assert (got == cells).all()
        assert grid == Grid(23, 37, 90.0, 0.0, 1000.0, 0.0, -90.0, 5000.0, "EPSG:26915")


def test_filters_choose_blocks_and_no_data_is_missing(spark, tmp_path, monkeypatch):
    cells = np.arange(64 * 64, dtype="i4").reshape(64, 64, 1) % 50
    path = str(tmp_path / "a.tif")
    with open(path, "wb") as f:
        f.write(tiff(cells, tile=(16, 16), extra=GEO, gap=5))
    frame, _ = T.read_geotiff(spark, path, "v")
    got = {(r.row, r.col): r.v for r in frame.where("row >= 20 AND row < 30 AND col = 40").collect()}
    assert got == {(i, 40): None if cells[i, 40, 0] == 7 else cells[i, 40, 0] for i in range(20, 30)}
    assert frame.where("row BETWEEN 16 AND 31 AND col BETWEEN 16 AND 31 AND v IS NOT NULL").count() == 0 and frame.count() == 4096
    reader = T.GeoTiffReader(path, True)
    name = lambda c: (c,)
    assert len(list(reader.pushFilters([T.GreaterThanOrEqual(name("row"), 20), T.LessThan(name("row"), 30), T.EqualTo(name("col"), 40)]))) == 3
    assert [b for p in reader.partitions() for b in p.blocks] == [6]
    monkeypatch.setattr(T, "PARTITION_CELLS", 1)
    assert len(T.GeoTiffReader(path, True).partitions()) == 16


def test_writes_a_folder_that_reads_back(spark, tmp_path):
    grid = Grid(50, 70, 30.0, 0.0, 500.0, 0.0, -30.0, 900.0, "EPSG:5070")
    rows = [(i, j, None if (i + j) % 9 == 0 else i * 100.0 + j) for i in range(50) for j in range(70) if not (i < 20 and j < 20)]
    cells = spark.createDataFrame(rows, "row int, col int, v double").repartition(5)
    path = str(tmp_path / "out")
    with pytest.raises(MissingFileError):
        T.read_geotiff(spark, path)
    T.write_geotiff(cells, grid, path, nodata=-1.5, side=20, block=16)
    frame, own = T.read_geotiff(spark, path, "v")
    assert own == grid and sorted(map(tuple, frame.select("row", "col", "v").collect())) == sorted(rows)
    assert frame.where("row = 25 AND col = 45").first().v == 2545.0
    with open(f"{path}/{T.INDEX}") as f:
        files = json.load(f)["files"]
    assert len(files) == 11 and {(f["height"], f["width"]) for f in files} == {(20, 20), (20, 10), (10, 20), (10, 10)}
    # Each file stands for itself, too.
    one, place = T.read_geotiff(spark, f"{path}/{next(f['file'] for f in files if (f['row0'], f['col0']) == (40, 60))}", "v", mask=False)
    assert place == Grid(10, 10, 30.0, 0.0, 500.0 + 60 * 30, 0.0, -30.0, 900.0 - 40 * 30, "EPSG:5070") and one.where("row = 1 AND col = 2").first().v == 4162.0


def test_attempts_that_fail_or_run_twice_leave_one_copy(spark, tmp_path):
    grid, path = Grid(4, 4, crs="EPSG:4326"), str(tmp_path / "out")
    cells = spark.createDataFrame([(i, j, i * 4 + j) for i in range(4) for j in range(4)], "row int, col int, v int")
    T.write_geotiff(cells, grid, path)
    (tmp_path / "out" / "tile_0_0-of-a-lost-task.tif").write_bytes(b"x")
    with pytest.raises(Exception, match="holds a raster"):
        T.write_geotiff(cells, grid, path)
    T.write_geotiff(cells.withColumn("v", F.col("v") + 1), grid, path, overwrite=True)
    assert len(list((tmp_path / "out").glob("*.tif"))) == 1
    assert T.read_geotiff(spark, path)[0].agg(F.sum("value")).first()[0] == sum(range(1, 17))
    T.write_geotiff(cells.limit(0), grid, str(tmp_path / "none"))
    assert T.read_geotiff(spark, str(tmp_path / "none"), mask=False)[0].count() == 0


def test_refuses_what_it_cannot_read(tmp_path):
    with pytest.raises(MissingFileError):
        T.layout(str(tmp_path / "no.tif"))
    (tmp_path / "a.tif").write_bytes(b"not a raster at all")
    with pytest.raises(ConfigError):
        T.layout(str(tmp_path / "a.tif"))
    (tmp_path / "b.tif").write_bytes(tiff(np.zeros((4, 4, 1), "f4"), extra=[(259, "H", [7])]))
    with pytest.raises(UnsupportedError):
        T.layout(str(tmp_path / "b.tif"))

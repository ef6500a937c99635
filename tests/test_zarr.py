import gzip
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterway.errors import MissingFileError, MissingLayerError, ProfileError, UnsupportedError
from rasterway.grid import Grid
from rasterway.sources import zarr as Z

GRID = Grid(50, 70, 30.0, 0.0, 500.0, 0.0, -30.0, 900.0, "EPSG:5070")


def cells_of(spark):
    rows = [(i, j, None if (i + j) % 9 == 0 else i * 100.0 + j, i * j) for i in range(50) for j in range(70) if not (i < 20 and j < 20)]
    return spark.createDataFrame(rows, "row int, col int, v float, k int").repartition(4), rows


def test_what_was_written_reads_back(spark, tmp_path):
    path = str(tmp_path / "s.zarr")
    with pytest.raises(MissingFileError):
        Z.layer_names(path)
    cells, rows = cells_of(spark)
    Z.write_zarr(cells, GRID, path, fills={"v": -1.0}, attributes={"v": {"unit": "usd"}}, side=20)
    assert Z.layer_names(path) == ["k", "v"] and Z.grid_of(path) == GRID and Z.attributes(path, "v") == {"unit": "usd", "grid_mapping": "spatial_ref"}
    got = {(r.row, r.col): (r.v, r.k) for r in Z.read_zarr(spark, path, ["v", "k"]).collect()}
    known = {(i, j): (-1.0 if v is None else v, k) for i, j, v, k in rows}
    # A chunk that nothing was written to is the fill value.
    assert len(got) == 3500 and all(got[c] == known.get(c, (-1.0, 0)) for c in got)
    assert not (tmp_path / "s.zarr" / "v" / "c" / "0" / "0" / "0").exists()


def test_filters_open_only_their_chunks(spark, tmp_path):
    path = str(tmp_path / "s.zarr")
    cells, _ = cells_of(spark)
    Z.write_zarr(cells, GRID, path, side=20)
    (tmp_path / "s.zarr" / "v" / "c" / "0" / "0" / "2").write_bytes(b"broken")
    assert Z.read_zarr(spark, path, ["v"]).where("row BETWEEN 21 AND 22 AND col >= 65").count() == 10
    reader = Z.ZarrReader(path, [Z.array(path, "v")], 1)
    list(reader.pushFilters([Z_filter("row", 21, ">="), Z_filter("col", 19, "<=")]))
    assert [c for p in reader.partitions() for c in p.chunks] == [(1, 0), (2, 0)]
    list(reader.pushFilters([Z_filter("row", 90, ">=")]))
    assert reader.partitions() == []


def Z_filter(name, value, sign):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

    return {">=": GreaterThanOrEqual, "<=": LessThanOrEqual}[sign]((name,), value)


def test_layers_are_added_and_replaced_and_half_written_ones_are_none(spark, tmp_path):
    path = str(tmp_path / "s.zarr")
    cells, _ = cells_of(spark)
    Z.write_zarr(cells.select("row", "col", "k"), GRID, path, side=20)
    with pytest.raises(Exception, match="exist"):
        Z.write_zarr(cells.select("row", "col", "k"), GRID, path, side=20)
    Z.write_zarr(cells.select("row", "col", (F.col("k") + 1).alias("k")), GRID, path, side=20, overwrite=True)
    Z.write_zarr(cells.select("row", "col", "v"), GRID, path, side=16)
    both = Z.read_zarr(spark, path)
    assert both.columns == ["row", "col", "k", "v"] and both.where("row = 40 AND col = 30").first()[:] == (40, 30, 1201, 4030.0)
    with pytest.raises(ProfileError):
        Z.write_zarr(cells.select("row", "col", "v"), Grid(50, 71), path)
    (tmp_path / "s.zarr" / "late" / "c" / "0" / "0").mkdir(parents=True)
    (tmp_path / "s.zarr" / "late" / "c" / "0" / "0" / "0").write_bytes(b"a chunk of a task that was lost")
    assert Z.layer_names(path) == ["k", "v"]
    with pytest.raises(MissingLayerError):
        Z.read_zarr(spark, path, ["late"])


CODECS = [
    ([{"name": "bytes", "configuration": {"endian": "big"}}], lambda a: a.astype(">i4").tobytes()),
    ([{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 5}}], lambda a: gzip.compress(a.astype("<i4").tobytes())),
    ([{"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 1}}], lambda a: pa.Codec("zstd").compress(a.T.astype("<i4").tobytes(), asbytes=True)),
    ([{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}, {"name": "zstd", "configuration": {}}], lambda a: pa.Codec("zstd").compress(a.astype("<i4").tobytes() + b"sums", asbytes=True)),
    ([{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {}}, {"name": "crc32c"}], lambda a: pa.Codec("zstd").compress(a.astype("<i4").tobytes(), asbytes=True) + b"sums"),
]


@pytest.mark.parametrize("k", range(len(CODECS)))
@pytest.mark.parametrize("keys", [{"name": "default"}, {"name": "v2", "configuration": {"separator": "."}}])
def test_reads_what_others_wrote(spark, tmp_path, k, keys):
    codecs, encode = CODECS[k]
    cells = np.random.default_rng(k).integers(0, 1000, (7, 9)).astype("i4")
    root = tmp_path / "o.zarr"
    (root / "a").mkdir(parents=True)
    (root / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group"}))
    for i in range(2):
        for j in range(3):
            if (i, j) == (1, 1):
                continue
            block = np.full((4, 3), 5, "i4")
            part = cells[i * 4 : i * 4 + 4, j * 3 : j * 3 + 3]
            block[: part.shape[0], : part.shape[1]] = part
            name = root / "a" / (f"c/{i}/{j}" if keys["name"] == "default" else f"{i}.{j}")
            name.parent.mkdir(parents=True, exist_ok=True)
            name.write_bytes(encode(block))
    meta = {"zarr_format": 3, "node_type": "array", "shape": [7, 9], "data_type": "int32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 3]}}, "chunk_key_encoding": keys, "fill_value": -3, "codecs": codecs}
    (root / "a" / "zarr.json").write_text(json.dumps(meta))
    cells[4:, 3:6] = -3
    got = np.zeros((7, 9), "i4")
    for r in Z.read_zarr(spark, str(root)).collect():
        got[r.row, r.col] = r.a
    assert (got == cells).all() and Z.grid_of(str(root)) == Grid(7, 9)
    meta["codecs"] = [{"name": "blosc"}]
    (root / "a" / "zarr.json").write_text(json.dumps(meta))
    with pytest.raises(UnsupportedError):
        Z.array(str(root), "a")

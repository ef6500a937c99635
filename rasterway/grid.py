"""Grids as DataFrames of cells.

A grid has a row per cell: row, col and one column a layer.  What holds for all cells,
shape, reference system and the affine transform, is a small ``Grid`` beside it.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterway.errors import ProfileError
from rasterway.functions import projection

#: Columns of a cell table that are not layers.
RESERVED = ("row", "col", "x", "y", "latitude", "longitude", "band", "spatial_ref", "tile")
#: Largest difference at which two transforms count as equal.
TRANSFORM_TOLERANCE = 0.01


@dataclass(frozen=True)
class Grid:
    """x = c + a * col + b * row and y = f + d * col + e * row, at a cell's upper left corner."""

    nrows: int
    ncols: int
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0
    crs: str = ""

    @property
    def cell(self) -> float:
        """Width of a cell."""
        return abs(self.a)

    def x(self, col: Column, row: Column | None = None) -> Column:
        """Centre of a cell."""
        out = F.lit(self.c) + (col + F.lit(0.5)) * F.lit(self.a)
        return out if self.b == 0 else out + (row + F.lit(0.5)) * F.lit(self.b)

    def y(self, row: Column, col: Column | None = None) -> Column:
        out = F.lit(self.f) + (row + F.lit(0.5)) * F.lit(self.e)
        return out if self.d == 0 else out + (col + F.lit(0.5)) * F.lit(self.d)

    def col_of(self, x: Column) -> Column:
        """The column that holds x, for grids that are not rotated."""
        return F.floor((x - F.lit(self.c)) / F.lit(self.a)).cast("int")

    def row_of(self, y: Column) -> Column:
        return F.floor((y - F.lit(self.f)) / F.lit(self.e)).cast("int")

    def inside(self, row: Column, col: Column) -> Column:
        return row.between(0, self.nrows - 1) & col.between(0, self.ncols - 1)

    def check(self, other: "Grid") -> None:
        """Raises unless both grids have the same shape, system and transform."""
        if (self.nrows, self.ncols) != (other.nrows, other.ncols):
            raise ProfileError(f"shapes differ: {self.nrows, self.ncols} and {other.nrows, other.ncols}")
        if not projection.same(self.crs, other.crs):
            raise ProfileError(f"reference systems differ: {self.crs} and {other.crs}")
        if any(abs(getattr(self, k) - getattr(other, k)) > TRANSFORM_TOLERANCE for k in "abcdef"):
            raise ProfileError("transforms differ")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Grid":
        return Grid(**json.loads(text))


def layers(cells: DataFrame) -> list[str]:
    """The layers of a cell table."""
    return [c for c in cells.columns if c.lower() not in RESERVED]


def empty(spark: SparkSession, grid: Grid) -> DataFrame:
    """All cells of ``grid`` without layers."""
    row, col = F.expr(f"cast(id div {grid.ncols} as int)"), F.expr(f"cast(id % {grid.ncols} as int)")
    return spark.range(grid.nrows * grid.ncols).select(row.alias("row"), col.alias("col"))


def with_coordinates(cells: DataFrame, grid: Grid) -> DataFrame:
    """Cell centres x and y; also longitude and latitude where the reference system is known."""
    out = cells.withColumn("x", grid.x(F.col("col"), F.col("row"))).withColumn("y", grid.y(F.col("row"), F.col("col")))
    if projection.known(grid.crs):
        out = projection.moved(out, F.col("x"), F.col("y"), grid.crs, "EPSG:4326", ("longitude", "latitude"))
        out = out.withColumns({c: F.col(c).cast("float") for c in ("longitude", "latitude")})
    return out


def tile(size: int) -> Column:
    """The square of ``size`` cells that a cell belongs to."""
    return F.struct(F.expr(f"row div {size}").alias("i"), F.expr(f"col div {size}").alias("j"))


def from_long(cells: DataFrame, names: list[str]) -> DataFrame:
    """(row, col, layer, value) to one column a layer; ``names`` avoids a pass to find them."""
    return cells.groupBy("row", "col").pivot("layer", names).agg(F.first("value"))


def resampled(source: DataFrame, own: Grid, target: Grid, columns: list[str] | None = None, fill: float | None = 0.0) -> DataFrame:
    """``source`` on the cells of ``target``: the source cell that holds each centre.

    Centres go to the source's reference system where it is another one.  Of the source only
    the rows and columns between the least and the greatest that a target cell needs are
    read.  Cells without a source get ``fill``.
    """
    columns = columns or layers(source)
    at = empty(source.sparkSession, target)
    at = projection.moved(at, target.x(F.col("col"), F.col("row")), target.y(F.col("row"), F.col("col")), target.crs, own.crs)
    at = at.select("row", "col", own.row_of(F.col("y")).alias("_r"), own.col_of(F.col("x")).alias("_c"))
    inside = own.inside(F.col("_r"), F.col("_c"))
    need = at.agg(*(f(F.when(inside, F.col(c))).alias(f"{c}{k}") for c in ("_r", "_c") for k, f in enumerate((F.min, F.max)))).first()
    window = F.lit(False) if need["_r0"] is None else F.col("row").between(need["_r0"], need["_r1"]) & F.col("col").between(need["_c0"], need["_c1"])
    picked = source.where(window).select(F.col("row").alias("_r"), F.col("col").alias("_c"), *columns)
    out = at.join(picked, ["_r", "_c"], "left").drop("_r", "_c")
    return out if fill is None else out.na.fill(fill, columns)

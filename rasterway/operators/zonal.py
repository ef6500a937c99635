"""Statistics of raster values by zone.

Zones (id and a ring of points) meet cells in steps that stay distributed: a zone lists
the squares of its bounding box, drops those outside, takes those inside whole and tests
the cells of those on its border; an equi-join brings the values.  Sums, counts and
percentiles are Spark's own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterway.errors import ConfigError
from rasterway.functions import geometry as G
from rasterway.grid import Grid, empty
from rasterway.operators.shapes import repaired
from rasterway.operators.simplify import half_cell, simplified

DEFAULT = ("count", "min", "max", "mean")
BASIC = ("count", "min", "max", "mean", "sum", "std", "median", "majority", "minority", "unique", "range", "nodata", "pixel_count")
#: Cells along a side of the squares that zones are cut into before single cells are tested.
SQUARE = 32
FRACTIONAL = ("fractional_pixel_count", "fractional_area", "value_multiplied_by_fractional_area")


@dataclass
class Stats:
    basic: list[str] = field(default_factory=list)
    fractional: list[str] = field(default_factory=list)
    percentiles: dict[str, float] = field(default_factory=dict)


def parse_stats(stats=None) -> Stats:
    """From None, '*' or 'ALL', a string with spaces, or a list of names."""
    names = list(DEFAULT) if stats is None else stats.split() if isinstance(stats, str) else list(stats)
    if names in (["*"], ["ALL"]):
        names = [*BASIC, *FRACTIONAL]
    out = Stats()
    for n in names:
        if n.startswith("percentile_"):
            try:
                q = float(n.removeprefix("percentile_"))
            except ValueError as e:
                raise ConfigError(f"not a percentile: {n}") from e
            if not 0 <= q <= 100:
                raise ConfigError(f"percentile out of range: {n}")
            out.percentiles[n] = q
        elif n in BASIC:
            out.basic.append(n)
        elif n in FRACTIONAL:
            out.fractional.append(n)
        else:
            raise ConfigError(f"unknown statistic {n!r}")
    return out


def _squares(boxed: DataFrame, grid: Grid) -> DataFrame:
    """``boxed`` (_r0, _r1, _c0, _c1) by squares of its cells: _i, _j and the edges _x0, _y0, _x1, _y1."""
    span = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {SQUARE}"), F.expr(f"{b} div {SQUARE}")))
    out = boxed.withColumn("_i", span("_r0", "_r1")).withColumn("_j", span("_c0", "_c1"))
    xs = [grid.x(F.col("_j") * SQUARE + k) for k in (0, SQUARE - 1)]
    ys = [grid.y(F.col("_i") * SQUARE + k) for k in (0, SQUARE - 1)]
    w, h = abs(grid.a) / 2, abs(grid.e) / 2
    return out.withColumns({"_x0": F.least(*xs) - w, "_x1": F.greatest(*xs) + w, "_y0": F.least(*ys) - h, "_y1": F.greatest(*ys) + h})


def _cells_of(squares: DataFrame) -> DataFrame:
    """The cells (row, col) of squares within the box they were cut from."""
    low = lambda at, first: F.greatest(F.col(at) * SQUARE, F.col(first))
    high = lambda at, last: F.least(F.col(at) * SQUARE + SQUARE - 1, F.col(last))
    rows = squares.withColumn("row", F.explode(F.sequence(low("_i", "_r0"), high("_i", "_r1")).cast("array<int>")))
    return rows.withColumn("col", F.explode(F.sequence(low("_j", "_c0"), high("_j", "_c1")).cast("array<int>")))


def _boxed(shapes: DataFrame, grid: Grid, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """``shapes`` that have cells of the grid in their box, with its first and last rows and columns."""
    r, c = [grid.row_of(y1), grid.row_of(y0)], [grid.col_of(x0), grid.col_of(x1)]
    first, last = lambda k: F.greatest(F.least(*k), F.lit(0)), lambda k, n: F.least(F.greatest(*k), F.lit(n - 1))
    return shapes.withColumns({"_r0": first(r), "_r1": last(r, grid.nrows), "_c0": first(c), "_c1": last(c, grid.ncols)}).where("_r0 <= _r1 AND _c0 <= _c1")


def zone_cells(zones: DataFrame, grid: Grid, all_touched: bool = True, fraction: bool = False) -> DataFrame:
    """(id, row, col[, fraction]) of ``zones`` (id, ring): cells by centre, or all that a zone touches."""
    b = _boxed(zones.select("id", "ring", G.bounds(F.col("ring")).alias("_b")), grid, *(F.col(f"_b.{k}") for k in ("x0", "y0", "x1", "y1")))
    on_border = G.touches_box(F.col("ring"), *(F.col(k) for k in ("_x0", "_y0", "_x1", "_y1")))
    within = G.contains(F.col("ring"), (F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2)
    squares = _squares(b, grid).withColumn("_edge", on_border).where(F.col("_edge") | within)
    # A square that no side crosses lies inside whole, so its cells need neither test nor ring.
    at = _cells_of(squares.withColumn("ring", F.when(F.col("_edge"), F.col("ring"))))
    x, y = grid.x(F.col("col")), grid.y(F.col("row"))
    w, h = abs(grid.a) / 2, abs(grid.e) / 2
    edges = (x - w, y - h, x + w, y + h)
    inside = G.contains(F.col("ring"), x, y)
    if all_touched:
        inside = inside | G.touches_box(F.col("ring"), *edges)
    out = at.where(F.when(F.col("_edge"), inside).otherwise(True))
    if fraction:
        share = G.clipped_area(F.col("ring"), *edges) / F.lit(abs(grid.a * grid.e))
        return out.select("id", "row", "col", F.when(F.col("_edge"), share).otherwise(1.0).alias("fraction"))
    return out.select("id", "row", "col")


def crossed_cells(shapes: DataFrame, grid: Grid) -> DataFrame:
    """(id, row, col) of cells that a side of a ring or line (id, ring) passes through."""
    b = _boxed(shapes.select("id", "ring", G.bounds(F.col("ring")).alias("_b")), grid, *(F.col(f"_b.{k}") for k in ("x0", "y0", "x1", "y1")))
    at = _cells_of(_squares(b, grid).where(G.touches_box(F.col("ring"), *(F.col(k) for k in ("_x0", "_y0", "_x1", "_y1")))))
    x, y, w, h = grid.x(F.col("col")), grid.y(F.col("row")), abs(grid.a) / 2, abs(grid.e) / 2
    return at.where(G.touches_box(F.col("ring"), x - w, y - h, x + w, y + h)).select("id", "row", "col")


def line_cells(routes: DataFrame, grid: Grid) -> DataFrame:
    """(id, row, col) of cells whose centre lies within half_width of a line (id, points, half_width), with flat ends."""
    p, reach = F.col("points"), F.col("half_width")
    box = G.bounds(p).alias("_b")
    sized = routes.select("id", "points", "half_width", box)
    b = _boxed(sized, grid, F.col("_b.x0") - reach, F.col("_b.y0") - reach, F.col("_b.x1") + reach, F.col("_b.y1") + reach)
    # A square farther from the line than its half diagonal more than the width has no such cell.
    radius = math.hypot(abs(grid.a) * SQUARE, abs(grid.e) * SQUARE) / 2
    squares = _squares(b, grid)
    squares = squares.where(G.line_distance((F.col("_x0") + F.col("_x1")) / 2, (F.col("_y0") + F.col("_y1")) / 2, p) <= reach + radius * (1 + 1e-9))
    at = _cells_of(squares)
    x, y = grid.x(F.col("col")), grid.y(F.col("row"))

    def beyond(end: Column, towards: Column) -> Column:
        return (x - end["x"]) * (towards["x"] - end["x"]) + (y - end["y"]) * (towards["y"] - end["y"]) < 0

    first, last = G.line_distance(x, y, F.slice(p, 1, 2)), G.line_distance(x, y, F.slice(p, -2, 2))
    near = G.line_distance(x, y, p)
    # What only the round cap of an end would add stays out.
    cap = (beyond(p[0], p[1]) & (near >= first)) | (beyond(F.element_at(p, -1), F.element_at(p, -2)) & (near >= last))
    return at.where((near <= reach) & ~F.coalesce(cap, F.lit(False))).select("id", "row", "col")


def half_width(value: Column, widths: dict[float, float] | None = None, ranges: list[dict] | None = None) -> Column:
    """Half of the right-of-way by voltage; exact voltages win over ranges; missing if none fits."""
    out = F.lit(None).cast("double")
    for r in reversed(ranges or []):
        out = F.when((value >= r["min"]) & (value < r["max"]), F.lit(r["width"] / 2)).otherwise(out)
    for voltage, width in reversed(list((widths or {}).items())):
        v = float(voltage)
        out = F.when(F.abs(value - v) <= 1e-8 + 1e-5 * abs(v), F.lit(width / 2)).otherwise(out)
    return out


def _map_of(counts: DataFrame, value: Column, kind: str, name: str) -> DataFrame:
    """Per id a map from ``value`` to n; where names collide that of the largest value counts."""
    named = counts.groupBy("id", value.alias("k")).agg(F.max_by("n", "v").alias("n"))
    return named.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).cast(f"map<{kind}>").alias(name))


def zonal(zones: DataFrame, cells: DataFrame, layer: str, grid: Grid, stats=None, nodata: float | None = None, all_touched: bool = True, categories: dict[float, str] | None = None, zone_func=None, prefix: str = "", at: DataFrame | None = None) -> DataFrame:
    """One row a zone: id and the statistics asked for.

    The cells of a zone are those of its ring, or ``at`` (id, row, col[, fraction]).

    ``zone_func`` maps the value column to another before anything is counted.  Zones
    without valid cells have counts of 0 and nothing else.
    """
    if zone_func is not None and not callable(zone_func):
        raise TypeError("zone_func must be callable")
    want = parse_stats(stats)
    if at is None:
        at = zone_cells(zones, grid, all_touched, fraction=bool(want.fractional))
    elif want.fractional and "fraction" not in at.columns:
        raise ConfigError("fractional statistics need the fraction of every cell")
    values = at.join(cells.select("row", "col", F.col(layer).cast("double").alias("v")), ["row", "col"])
    missing = F.col("v").isNull() | F.isnan("v")
    void = F.lit(False) if nodata is None else F.coalesce(F.col("v") == nodata, F.lit(False))
    if zone_func is not None:
        values = values.withColumn("v", F.when(void, F.col("v")).otherwise(zone_func(F.col("v"))))
    valid = F.when(~missing & ~void, F.col("v"))
    simple = {
        "count": F.count(valid), "min": F.min(valid), "max": F.max(valid), "mean": F.avg(valid), "sum": F.sum(valid), "std": F.stddev_pop(valid), "median": F.median(valid), "unique": F.count_distinct(valid),
        "range": F.max(valid) - F.min(valid), "nodata": F.sum(F.when(void, 1.0).otherwise(0.0)),
    }
    picked = [simple[n].alias(n) for n in want.basic if n in simple] + [F.percentile(valid, F.lit(q / 100)).alias(n) for n, q in want.percentiles.items()]
    out = zones.select("id")
    if picked:
        out = out.join(values.groupBy("id").agg(*picked), "id", "left")
    counts = values.where(~missing & ~void).groupBy("id", "v").agg(F.count("*").alias("n"))
    name = F.col("v").cast("string")
    for code, text in (categories or {}).items():
        name = F.when(F.col("v") == float(code), F.lit(text)).otherwise(name)
    if "pixel_count" in want.basic:
        out = out.join(_map_of(counts, name, "string,bigint", "pixel_count"), "id", "left")
        out = out.withColumn("pixel_count", F.coalesce("pixel_count", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))))
    if "majority" in want.basic or "minority" in want.basic:
        # Names count as pixels do, so a name that two values share counts once; ties go to the smallest value.
        named = counts.groupBy("id", name.alias("k")).agg(F.max_by("n", "v").alias("n"), F.min("v").alias("v"))
        most = named.groupBy("id").agg(F.min_by("k", F.struct((-F.col("n")).alias("n"), "v")).alias("majority"), F.min_by("k", F.struct("n", "v")).alias("minority"))
        out = out.join(most.select("id", *[n for n in ("majority", "minority") if n in want.basic]), "id", "left")
    if want.fractional:
        shares = values.where(~missing & ~void).groupBy("id", "v").agg(F.sum("fraction").alias("n")).where("n > 0")
        cell = abs(grid.a * grid.e)
        scaled = {"fractional_pixel_count": F.col("n"), "fractional_area": F.col("n") * cell}
        for n in want.fractional:
            if n in scaled:
                out = out.join(_map_of(shares.withColumn("n", scaled[n]), name, "string,double", n), "id", "left")
            else:
                out = out.join(shares.groupBy("id").agg(F.sum(F.col("v") * F.col("n") * cell).alias(n)), "id", "left")
    zeros = {n: 0 for n in ("count", "unique") if n in out.columns} | ({"nodata": 0.0} if "nodata" in out.columns else {})
    out = out.na.fill(zeros) if zeros else out
    return out.withColumnsRenamed({c: f"{prefix}{c}" for c in out.columns if c != "id"}) if prefix else out


def characterized(routes: DataFrame, cells: DataFrame, layer: str, grid: Grid, widths: dict[float, float] | None = None, ranges: list[dict] | None = None, **wanted) -> DataFrame:
    """Statistics of a layer in the right-of-way of routes (id, points, voltage); ``wanted`` goes to ``zonal``.

    A route of a voltage without a width has no cells.
    """
    sized = routes.select("id", "points", half_width(F.col("voltage"), widths, ranges).alias("half_width"))
    return zonal(sized, cells, layer, grid, at=line_cells(sized.where("half_width IS NOT NULL"), grid), **wanted)


def user_stats(zones: DataFrame, cells: DataFrame, layer: str, grid: Grid, functions: dict, all_touched: bool = True) -> DataFrame:
    """Own statistics: each function gets one zone's (row, col, value) frame and returns a number."""
    for f in functions.values():
        if not callable(f):
            raise TypeError("statistics must be callable")
    values = zone_cells(zones, grid, all_touched).join(cells.select("row", "col", F.col(layer).cast("double").alias("value")), ["row", "col"])
    kind = dict(zones.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = pdf[["row", "col", "value"]].sort_values(["row", "col"])
        return pd.DataFrame([{"id": pdf["id"].iloc[0], **{n: float(f(frame)) for n, f in functions.items()}}])

    found = values.groupBy("id").applyInPandas(run, f"id {kind}, " + ", ".join(f"`{n}` double" for n in functions))
    return zones.select("id").join(found, "id", "left")


def flattened(stats: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One column a key of a map column."""
    return stats.select("*", *[F.col(column)[k].alias(f"{column}_{k}") for k in keys]).drop(column)


def rasterized(shapes: DataFrame, grid: Grid, all_touched: bool = False, boundary_only: bool = False, fill: float = 0.0, repair: bool = False, simplify: bool = False) -> DataFrame:
    """(row, col, value) of all cells: ``shapes`` (id, ring, value, order); later ones overwrite.

    On request, polygons that may be invalid are repaired first, and shapes simplified to half a cell.
    """
    shapes = repaired(shapes) if repair else shapes.where("ring IS NOT NULL AND size(ring) > 0")
    shapes = simplified(shapes, half_cell(grid)) if simplify else shapes
    at = crossed_cells(shapes, grid) if boundary_only else zone_cells(shapes, grid, all_touched)
    burned = at.join(shapes.select("id", "value", "order"), "id").groupBy("row", "col").agg(F.max_by("value", "order").alias("value"))
    return empty(shapes.sparkSession, grid).join(burned, ["row", "col"], "left").na.fill(fill, ["value"])

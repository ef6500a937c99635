"""Building layers by raster algebra: every layer is one column expression over the cells.

A component draws on one source layer and on an extent mask; a layer is the sum of its
components, with cells of forced inclusion at zero.  Nothing is evaluated before the
layers are written, and one pass over the cells builds all of them.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterway.errors import ConfigError, MissingLayerError, RasterwayWarning
from rasterway.functions import expressions as X
from rasterway.grid import Grid
from rasterway.operators.shapes import repaired
from rasterway.operators.zonal import rasterized
from rasterway.plans.lookups import Transmission

EXTENTS = ("all", "wet", "wet+", "landfall", "dry+", "dry")
#: Land cover of water, and how much dearer it is.
WATER_CODE, WATER_MULTIPLIER = 11, 10.0
BARRIER_MULTIPLIER = 1e6
_ACTIONS = ("global_value", "map", "bins", "pass_through", "rasterize", "forced_inclusion")


@dataclass
class Bin:
    """value where min <= d < max."""

    value: float
    min: float = -math.inf
    max: float = math.inf


@dataclass
class Component:
    """One term of a layer, drawn from the column ``source``."""

    source: str | None = None
    extent: str = "all"
    global_value: float | None = None
    map: dict[float, float] | None = None
    bins: list[Bin] | None = None
    pass_through: bool = False
    forced_inclusion: bool = False
    na_fill: float = 0.0
    rasterize: float | None = None
    all_touched: bool = False

    def check(self) -> None:
        given = [k for k in ("global_value", "map", "bins", "rasterize") if getattr(self, k) is not None] + [k for k in ("pass_through", "forced_inclusion") if getattr(self, k)]
        if self.extent not in EXTENTS:
            raise ConfigError(f"unknown extent {self.extent!r}")
        if len(given) != 1:
            raise ConfigError(f"a component needs exactly one of {_ACTIONS}, not {given}")
        if self.source is None and self.global_value is None:
            raise ConfigError("a component without a source needs a global value")
        if self.bins is not None:
            check_bins(self.bins)


@dataclass
class Layer:
    name: str
    build: list[Component] = field(default_factory=list)
    values_are_costs_per_mile: bool = False
    description: str = ""
    include_in_file: bool = True


def check_bins(bins: list[Bin]) -> None:
    """Raises for a reversed bin; warns of overlaps, gaps and open ends."""
    for b in bins:
        if b.min > b.max:
            raise ConfigError(f"bin minimum {b.min} is above its maximum {b.max}")
        if b.min == -math.inf and b.max == math.inf:
            warnings.warn("a bin covers all values", RasterwayWarning, stacklevel=2)
    ordered = sorted(bins, key=lambda b: (b.min, b.max))
    for a, b in zip(ordered, ordered[1:]):
        if b.min < a.max:
            warnings.warn(f"bins overlap at {b.min}; their values add up", RasterwayWarning, stacklevel=2)
        elif b.min > a.max:
            warnings.warn(f"no bin covers {a.max} to {b.min}", RasterwayWarning, stacklevel=2)
    if ordered and (ordered[0].min != -math.inf or ordered[-1].max != math.inf):
        warnings.warn("bins do not reach to infinity", RasterwayWarning, stacklevel=2)


def masks(raw_land: Column, boundary: Column) -> dict[str, Column]:
    """Extent masks from land cells (touched by land) and its boundary cells.

    Wet is not land; landfall is the boundary; dry is where exactly one of both holds.
    """
    wet, dry = ~raw_land, boundary != raw_land
    return {"wet": wet, "landfall": boundary, "dry": dry, "wet+": wet | boundary, "dry+": dry | boundary, "all": F.lit(True)}


def land_masks(land: DataFrame, grid: Grid) -> DataFrame:
    """(row, col, wet_mask, dry_mask, landfall_mask, raw_land_mask) of all cells from land polygons (id, ring), 1 inside."""
    burned = repaired(land.select("id", "ring", F.lit(1.0).alias("value"), F.lit(0).alias("order")))
    raw = rasterized(burned, grid, all_touched=True).withColumnRenamed("value", "raw")
    both = raw.join(rasterized(burned, grid, boundary_only=True).withColumnRenamed("value", "coast"), ["row", "col"])
    m = masks(F.col("raw") == 1, F.col("coast") == 1)
    return both.select("row", "col", *(x.cast("int").alias(n) for n, x in {"wet_mask": m["wet"], "dry_mask": m["dry"], "landfall_mask": m["landfall"], "raw_land_mask": F.col("raw") == 1}.items()))


def check_masks(cells: DataFrame, names: tuple[str, ...] = ("wet_mask", "dry_mask", "landfall_mask")) -> None:
    """Raises unless every mask layer holds nothing but 0 and 1."""
    bad = [F.count(F.when(F.col(n).isNull() | ~F.col(n).isin(0, 1), 1)).alias(n) for n in names]
    if wrong := [n for n, k in cells.agg(*bad).first().asDict().items() if k]:
        raise ConfigError(f"masks {wrong} hold values other than 0 and 1")


def stored_masks(wet: Column, dry: Column, landfall: Column) -> dict[str, Column]:
    """The same from mask layers that are 1 inside."""
    wet, dry, landfall = wet == 1, dry == 1, landfall == 1
    return {"wet": wet, "landfall": landfall, "dry": dry, "wet+": wet | landfall, "dry+": dry | landfall, "all": F.lit(True)}


def _binned(d: Column, bins: list[Bin]) -> Column:
    def inside(b: Bin) -> Column:
        low = F.lit(True) if b.min == -math.inf else d >= F.lit(b.min)
        high = F.lit(True) if b.max == math.inf else d < F.lit(b.max)
        return F.coalesce(~F.isnan(d) & low & high, F.lit(False))

    return X.total([F.when(inside(b), F.lit(float(b.value))).otherwise(0.0) for b in bins])


def _mapped(d: Column, table: dict[float, float]) -> Column:
    """0 where no key equals; of equal keys the last counts."""
    out = F.lit(0.0)
    for key, value in table.items():
        out = F.when(d == F.lit(float(key)), F.lit(float(value))).otherwise(out)
    return out


def burned(cells: DataFrame, specs: list[Layer], shapes: dict[str, DataFrame], grid: Grid) -> DataFrame:
    """``cells`` with a column for each vector source (id, ring) that a layer rasterizes, under the source's name."""
    wanted = {}
    for c in (c for spec in specs for c in spec.build if c.rasterize is not None):
        c.check()
        if wanted.setdefault(c.source, c) != c:
            raise ConfigError(f"source {c.source!r} is rasterized in two ways; give it two names")
        if c.source not in shapes:
            raise MissingLayerError(f"no vector source {c.source!r}")
    for name, c in wanted.items():
        value = rasterized(shapes[name].select("id", "ring", F.lit(float(c.rasterize)).alias("value"), F.lit(0).alias("order")), grid, c.all_touched, fill=float(c.na_fill), repair=True)
        cells = cells.join(value.withColumnRenamed("value", name), ["row", "col"], "left")
    return cells


def component(c: Component, extent: dict[str, Column]) -> Column:
    """The value of one component, 0 outside its extent; what is rasterized is a column by now (see ``burned``)."""
    c.check()
    d = F.col(c.source).cast("double") if c.source else None
    if c.global_value is not None:
        value = F.lit(float(c.global_value))
    elif c.bins is not None:
        value = _binned(d, c.bins)
    elif c.map is not None:
        value = _mapped(d, c.map)
    else:
        value = d
    value = F.when(extent[c.extent], value).otherwise(0.0) if c.extent != "all" else value
    return F.coalesce(F.nanvl(value, F.lit(float(c.na_fill))), F.lit(float(c.na_fill)))


def layer(spec: Layer, extent: dict[str, Column] | None = None, cell: float = 1.0) -> Column:
    """The layer as one float column."""
    extent = extent or {"all": F.lit(True)}
    if not spec.build:
        raise ConfigError(f"layer {spec.name!r} has no component")
    terms = [component(c, extent) for c in spec.build if not c.forced_inclusion]
    value = X.total(terms) if terms else F.lit(0.0)
    forced = [component(c, extent) for c in spec.build if c.forced_inclusion]
    if forced:
        value = F.when(X.total(forced) > 0, 0.0).otherwise(value)
    if spec.values_are_costs_per_mile:
        value = X.per_cell(value, cell)
    return value.cast("float")


def build(cells: DataFrame, specs: list[Layer], extent: dict[str, Column] | None = None, cell: float = 1.0) -> DataFrame:
    """``cells`` with every layer of ``specs``, in one projection."""
    return cells.withColumns({s.name: layer(s, extent, cell) for s in specs})


def slope_multiplier(slope: Column, hill_mult: float = 1, mtn_mult: float = 1, hill_slope: float = 2, mtn_slope: float = 8) -> Column:
    return F.when(slope >= mtn_slope, F.lit(float(mtn_mult))).when(slope >= hill_slope, F.lit(float(hill_mult))).otherwise(1.0)


def land_use_multiplier(code: Column, multipliers: dict[str, float], classes: dict[str, list[int]]) -> Column:
    """1 where no class holds the code; of several classes the last listed counts."""
    out = F.lit(1.0)
    for name, value in multipliers.items():
        codes = classes.get(name)
        if codes is None:
            raise ConfigError(f"unknown land use class {name!r}")
        if not isinstance(codes, (list, tuple)):
            raise ConfigError(f"land use class {name!r} needs a list of codes")
        out = F.when(code.isin([int(c) for c in codes]), F.lit(float(value))).otherwise(out)
    return out


def dry_multiplier(iso: Column, land_use: Column, slope: Column, config: Transmission | None = None, default: dict | None = None) -> Column:
    """Land use times slope by region; the default where no region matches; water last."""
    config = Transmission.load(config)

    def of(spec: dict) -> Column:
        lu = land_use_multiplier(land_use, spec.get("land_use") or {}, config.land_use_classes)
        return lu * (slope_multiplier(slope, **spec["slope"]) if spec.get("slope") else F.lit(1.0))

    out = of(default) if default else F.lit(1.0)
    for spec in config.iso_multipliers:
        out = F.when(iso == config.iso_lookup[spec["iso"]], of(spec)).otherwise(out)
    return F.when(land_use == WATER_CODE, F.lit(WATER_MULTIPLIER)).otherwise(out).cast("float")


def base_line_cost(iso: Column, power: int, cell: float, config: Transmission | None = None) -> Column:
    """Dollars a cell by region, 0 outside all."""
    config = Transmission.load(config)
    out = F.lit(0.0)
    for name, costs in config.base_line_costs.items():
        out = F.when(iso == config.iso_lookup[name], F.lit(costs[str(power)] / X.METERS_IN_MILE * cell)).otherwise(out)
    return out.cast("float")


def dry_costs(cells: DataFrame, cell: float, config: Transmission | None = None, iso: str = "iso", land_use: str = "nlcd", slope: str = "slope", mask: Column | None = None, default: dict | None = None) -> DataFrame:
    """``cells`` with dry_multipliers and tie_line_costs_<power>MW of every power class."""
    config = Transmission.load(config)
    mask = F.lit(True) if mask is None else mask
    out = cells.withColumn("dry_multipliers", dry_multiplier(F.col(iso), F.col(land_use), F.col(slope), config, default))
    costs = {f"tie_line_costs_{p}MW": F.when(mask, base_line_cost(F.col(iso), p, cell, config) * F.col("dry_multipliers")).otherwise(F.lit(0.0)).cast("float") for p in config.power_classes.values()}
    return out.withColumns(costs)


def friction_and_barriers(friction: Column, barriers: Column, multiplier: float = BARRIER_MULTIPLIER) -> Column:
    """One layer of friction plus barriers made all but impassable."""
    return (friction + barriers * F.lit(multiplier)).cast("float")

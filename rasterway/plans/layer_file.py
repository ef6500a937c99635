"""Building a layered store from a configuration: masks, layers, dry costs, friction merged with barriers."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterway.errors import ConfigError
from rasterway.grid import Grid
from rasterway.plans import layers as L
from rasterway.plans.lookups import Transmission
from rasterway.sources.store import Store, fingerprint

MASKS = ("wet_mask", "dry_mask", "landfall_mask")


@dataclass
class DryCosts:
    """Names of the source layers of dry costs."""

    iso: str = "iso"
    land_use: str = "nlcd"
    slope: str = "slope"
    default: dict | None = None
    config: Transmission | dict | None = None


@dataclass
class Merge:
    """Friction and barriers made one layer of the store."""

    friction: str
    barriers: str
    output: str
    multiplier: float = L.BARRIER_MULTIPLIER


@dataclass
class Plan:
    layers: list[L.Layer] = field(default_factory=list)
    dry_costs: DryCosts | None = None
    merge: Merge | None = None


def definition(spec: L.Layer) -> dict:
    """What a layer is built from, as it is compared with what a store says it was built from."""
    return {"build": [asdict(c) for c in spec.build], "values_are_costs_per_mile": spec.values_are_costs_per_mile}


def stale(store: Store, specs: list[L.Layer]) -> list[L.Layer]:
    """The layers to build: in the file or already in it, unless built from this very definition."""
    meta = store.meta()
    have = {n: meta["layers"].get(n, {}).get("build") for n in meta["tables"]}
    return [s for s in specs if (s.include_in_file or s.name in have) and have.get(s.name) != fingerprint(definition(s))]


def write_masks(store: Store, land: DataFrame, overwrite: bool = False) -> None:
    """Mask layers of a store from land polygons (id, ring)."""
    store.write_all(L.land_masks(land, store.grid), overwrite)


def build(store: Store, plan: Plan, sources: DataFrame, grid: Grid | None = None, shapes: dict[str, DataFrame] | None = None, validate_masks: bool = False) -> list[str]:
    """Builds what the plan asks for and the store lacks; gives the names of the layers written.

    ``sources`` holds the raster layers on the store's grid, ``shapes`` the vector ones
    (id, ring).  A store that does not exist is created on ``grid``.  All layers are one
    projection over one join of the sources, written once.
    """
    if not (plan.layers or plan.dry_costs or plan.merge):
        raise ConfigError("a plan needs layers, dry costs or a merge")
    if not store.exists():
        if grid is None:
            raise ConfigError(f"{store.path} does not exist and no grid is given")
        store.create(grid)
    grid, done = store.grid, []
    cell = abs(grid.a)
    wanted = stale(store, plan.layers)
    masked = any(c.extent != "all" for s in plan.layers for c in s.build)
    have = set(store.layers())
    if masked or plan.dry_costs and set(MASKS) <= have:
        masks = store.cells(MASKS)
        if validate_masks:
            L.check_masks(masks)
        sources = sources.join(masks, ["row", "col"])
    extent = L.stored_masks(*(F.col(m) for m in MASKS)) if masked else None
    if wanted:
        cells = L.burned(sources, wanted, shapes or {}, grid)
        built = L.build(cells, wanted, extent, cell).select("row", "col", *(s.name for s in wanted))
        store.write_all(built, True, {s.name: {"build": fingerprint(definition(s)), "description": s.description} for s in wanted})
        done += [s.name for s in wanted]
    if d := plan.dry_costs:
        inside = F.col("dry_mask") == 1 if set(MASKS) <= have else None
        costs = L.dry_costs(sources, cell, d.config, d.iso, d.land_use, d.slope, inside, d.default)
        names = [c for c in costs.columns if c == "dry_multipliers" or c.startswith("tie_line_costs_")]
        store.write_all(costs.select("row", "col", *names), True)
        done += names
    if m := plan.merge:
        merged = store.cells([m.friction, m.barriers]).select("row", "col", L.friction_and_barriers(F.col(m.friction), F.col(m.barriers), m.multiplier).alias(m.output))
        store.write(m.output, merged, True)
        done.append(m.output)
    return done

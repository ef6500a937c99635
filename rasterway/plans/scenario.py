"""Routing scenarios: definitions compiled into column expressions over the cells.

A scenario has options in a fixed order; each sums cost layers, weighs them by friction and
knows barriers.  ``surface`` turns a cell table into one row per cell and option:
cost (missing where blocked), inv (the invariant part), driver, hard and soft_rank.
All terms are 32-bit floats, multiplied in the order of the definition.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterway.errors import ConfigError, MissingLayerError
from rasterway.functions import expressions as X
from rasterway.grid import layers as layers_of

# Cost of a cell that may not block although its cost is not positive; friction may
# not reach -1; scale of a polarity multiplier.
HIGH_COST = 1e10
LEAST_FRICTION = -1 + 1e-7
POLARITY_SCALE = 55923.40730136006


def _names(value) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


@dataclass
class CostLayer:
    layer_name: str
    multiplier_layer: str | list[str] | None = None
    multiplier_scalar: float = 1.0
    is_invariant: bool = False
    include_in_final_cost: bool = True
    include_in_report: bool = True
    apply_row_mult: bool = False
    apply_polarity_mult: bool = False


@dataclass
class FrictionLayer:
    multiplier_layer: str | list[str]
    multiplier_scalar: float = 1.0
    include_in_report: bool = False
    apply_row_mult: bool = False
    apply_polarity_mult: bool = False


@dataclass
class BarrierLayer:
    """Cells where ``where`` holds; hard without an importance, else dropped in ascending order."""

    layer_name: str
    where: str
    barrier_importance: int | None = None

    def __post_init__(self):
        X.parse_where(self.where)
        if self.barrier_importance is not None and self.barrier_importance <= 0:
            raise ConfigError("a barrier's importance must be positive")


@dataclass
class TrackedLayer:
    layer_name: str
    agg_method: str
    multiplier_layer: str | list[str] | None = None
    multiplier_scalar: float = 1.0


@dataclass
class Option:
    cost_layers: list[CostLayer]
    friction_layers: list[FrictionLayer] = field(default_factory=list)
    barrier_layers: list[BarrierLayer] = field(default_factory=list)
    tracked_layers: list[TrackedLayer] = field(default_factory=list)
    cost_multiplier_layer: str | list[str] | None = None
    cost_multiplier_scalar: float = 1.0

    def __post_init__(self):
        if not self.cost_layers:
            raise ConfigError("an option needs a cost layer")


@dataclass
class Zone:
    """Where ``where`` holds on ``layer_name``, options have these multipliers, or None if excluded."""

    layer_name: str
    where: str
    options: dict[str, float | None]


@dataclass
class Drivers:
    default: dict[str, float | None] = field(default_factory=dict)
    zones: list[Zone] = field(default_factory=list)

    @property
    def identity(self) -> bool:
        return not self.zones and all(v == 1 for v in self.default.values())


@dataclass
class Transitions:
    """Cost of changing options between neighbouring cells, the same in both directions."""

    default: float = 0.0
    pairwise: dict[tuple[str, str], float] = field(default_factory=dict)

    def cost(self, a: str, b: str) -> float:
        return 0.0 if a == b else self.pairwise.get((a, b), self.pairwise.get((b, a), self.default))


@dataclass
class Scenario:
    options: dict[str, Option]
    drivers: Drivers | None = None
    transitions: Transitions = field(default_factory=Transitions)
    invalid_costs_block_routing: bool = True

    def __post_init__(self):
        if not self.options:
            raise ConfigError("a scenario needs a routing option")

    @property
    def names(self) -> list[str]:
        return list(self.options)

    @property
    def soft_groups(self) -> list[tuple[int, list[str]]]:
        """(importance, layer names) ascending, over all options."""
        groups: dict[int, list[str]] = {}
        for o in self.options.values():
            for b in o.barrier_layers:
                if b.barrier_importance is not None:
                    groups.setdefault(b.barrier_importance, []).append(b.layer_name)
        return sorted(groups.items())

    def dropped(self, k: int) -> list[str]:
        """Layers of the ``k`` least important groups."""
        return [name for _, names in self.soft_groups[:k] for name in names]

    @staticmethod
    def from_json(config: str | dict) -> "Scenario":
        """From the JSON form; unknown keys are errors."""
        config = json.loads(config) if isinstance(config, str) else dict(config)
        try:
            options = {}
            for name, o in config.pop("routing_options").items():
                o = dict(o)
                kinds = {"cost_layers": CostLayer, "friction_layers": FrictionLayer, "barrier_layers": BarrierLayer, "tracked_layers": TrackedLayer}
                options[name] = Option(**{k: [kinds[k](**x) for x in v or []] if k in kinds else v for k, v in o.items()})
            excluded = lambda d: {k: None if v == "excluded" else float(v) for k, v in d.items()}
            drivers = config.pop("drivers", None)
            if drivers is not None:
                zones = []
                for z in drivers.get("zones") or []:
                    z = dict(z)
                    layer, condition, given = z.pop("layer_name"), z.pop("where"), z.pop("options", None)
                    zones.append(Zone(layer, condition, excluded(given if given is not None else z)))
                drivers = Drivers(excluded(drivers.get("default") or {}), zones)
            t = config.pop("transition_costs", None) or {}
            transitions = Transitions(float(t.get("default", 0)), {tuple(p["between"]): float(p["cost"]) for p in t.get("pairwise") or []})
            return Scenario(options, drivers, transitions, **config)
        except (TypeError, KeyError) as e:
            raise ConfigError(f"not a scenario: {e}") from e

    def needed(self) -> list[str]:
        """All layers that any expression reads, once each."""
        found: list[str] = []
        for o in self.options.values():
            for c in o.cost_layers:
                found += [c.layer_name, *_names(c.multiplier_layer)]
            for f in o.friction_layers:
                found += _names(f.multiplier_layer)
            for t in o.tracked_layers:
                found += [t.layer_name, *_names(t.multiplier_layer)]
            found += [b.layer_name for b in o.barrier_layers] + _names(o.cost_multiplier_layer)
        found += [z.layer_name for z in (self.drivers.zones if self.drivers else [])]
        return list(dict.fromkeys(found))

    def check(self, cells: DataFrame) -> None:
        missing = [n for n in self.needed() if n not in cells.columns]
        if missing:
            raise MissingLayerError(f"layers {missing} are not among {layers_of(cells)}")


# Expressions ---------------------------------------------------------------


def _layer(name: str) -> Column:
    return X.single(F.col(name))


def cost_layer(c: CostLayer) -> Column:
    """layer x scalar x multipliers, 0 unless positive."""
    value = X.product([_layer(c.layer_name), X.single(c.multiplier_scalar), *map(_layer, _names(c.multiplier_layer))])
    return F.when(X.compare(value, ">", 0.0), value).otherwise(X.single(0))


def friction(o: Option) -> Column:
    """Summed friction, kept above -1."""
    if not o.friction_layers:
        return X.single(0)
    terms = [X.product([*map(_layer, _names(f.multiplier_layer)), X.single(f.multiplier_scalar)]) for f in o.friction_layers]
    value = X.total(terms)
    return F.when(value <= X.single(-1), X.single(LEAST_FRICTION)).otherwise(value)


def part(s: Scenario, o: Option, invariant: bool) -> Column | None:
    """The option's routing cost of one kind; missing where it blocks; None without layers of that kind anywhere."""
    own = [c for c in o.cost_layers if c.is_invariant == invariant]
    if not any(c.is_invariant == invariant for x in s.options.values() for c in x.cost_layers):
        return None
    value = X.total([cost_layer(c) for c in own]) if own else X.single(0)
    for name in _names(o.cost_multiplier_layer):
        value = value * _layer(name)
    invalid = F.lit(None).cast("float") if s.invalid_costs_block_routing else X.single(HIGH_COST)
    value = F.when(value <= X.single(0), invalid).otherwise(value)
    return value * (X.single(1) + friction(o))


def driver(s: Scenario, name: str) -> Column:
    """The option's multiplier: later zones override, missing is excluded."""
    if s.drivers is None or s.drivers.identity:
        return X.single(1)
    out = F.lit(s.drivers.default.get(name, 1.0)).cast("float")
    for z in s.drivers.zones:
        if name in z.options:
            out = F.when(X.where(_layer(z.layer_name), z.where), F.lit(z.options[name]).cast("float")).otherwise(out)
    return out


def hard(o: Option) -> Column:
    return X.any_of([X.where(_layer(b.layer_name), b.where) for b in o.barrier_layers if b.barrier_importance is None])


def soft_rank(s: Scenario, o: Option) -> Column:
    """The highest soft group that bars the cell, from 1; 0 if none.  Attempt k bars ranks above k."""
    ranks = {importance: i + 1 for i, (importance, _) in enumerate(s.soft_groups)}
    terms = [F.when(X.where(_layer(b.layer_name), b.where), F.lit(ranks[b.barrier_importance])).otherwise(0) for b in o.barrier_layers if b.barrier_importance is not None]
    return (reduce(F.greatest, terms) if terms else F.lit(0)).cast("int")


def surface(cells: DataFrame, s: Scenario) -> DataFrame:
    """(row, col, option, cost, inv, driver, hard, soft_rank): one projection an option, one scan each pruned to its layers."""
    s.check(cells)
    parts = []
    for i, (name, o) in enumerate(s.options.items()):
        cost, inv = part(s, o, False), part(s, o, True)
        cost = X.single(0) if cost is None else cost
        inv = X.single(0) if inv is None else inv
        parts.append(cells.select("row", "col", F.lit(i).alias("option"), cost.alias("cost"), inv.alias("inv"), driver(s, name).alias("driver"), hard(o).alias("hard"), soft_rank(s, o).alias("soft_rank")))
    return reduce(DataFrame.unionByName, parts)


def traversable(attempt: int = 0) -> Column:
    """Whether a surface row may be entered in an attempt."""
    return F.col("cost").isNotNull() & ~F.isnan("cost") & F.col("inv").isNotNull() & F.col("driver").isNotNull() & ~F.col("hard") & (F.col("soft_rank") <= attempt)


def transition_table(s: Scenario) -> list[list[float]]:
    return [[s.transitions.cost(a, b) for b in s.names] for a in s.names]


# Reports ---------------------------------------------------------------------


def report_layer(c: CostLayer | TrackedLayer) -> Column:
    """layer x multiplier layers x scalar, in this order."""
    return X.product([_layer(c.layer_name), *map(_layer, _names(c.multiplier_layer)), X.single(c.multiplier_scalar)])


def report_costs(s: Scenario, name: str) -> tuple[Column, Column]:
    """(cost, invariant cost) of a cell as reported: layers in the final cost, with the option's multipliers."""
    o, out = s.options[name], []
    for invariant in (False, True):
        terms = [report_layer(c) for c in o.cost_layers if c.include_in_final_cost and c.is_invariant == invariant]
        value = X.total([F.coalesce(F.nanvl(t, X.single(0)), X.single(0)) for t in terms]) if terms else X.single(0)
        value = value * X.single(o.cost_multiplier_scalar)
        for layer in _names(o.cost_multiplier_layer):
            value = value * _layer(layer)
        out.append(value)
    return out[0], out[1]


def final_layer(s: Scenario, name: str) -> Column:
    """The exported routing layer: -1 or 1e10 where the cost is not positive, missing behind hard barriers."""
    o = s.options[name]
    value = X.total([report_layer(c) for c in o.cost_layers])
    for layer in _names(o.cost_multiplier_layer):
        value = value * _layer(layer)
    value = value * (X.single(1) + friction(o))
    value = F.when(value <= X.single(0), X.single(-1 if s.invalid_costs_block_routing else HIGH_COST)).otherwise(value)
    return F.when(~hard(o), value)


def final_layers(cells: DataFrame, s: Scenario) -> DataFrame:
    """row, col and one exported layer an option."""
    s.check(cells)
    return cells.select("row", "col", *[final_layer(s, n).alias(n) for n in s.names])


# Voltage and polarity ----------------------------------------------------------


def _looked_up(value, voltage, polarity) -> float | dict:
    """A cost or multiplier given as a number, by voltage, or by voltage and polarity."""
    if isinstance(value, dict):
        if str(voltage) not in value and voltage not in value:
            raise ConfigError(f"no value for voltage {voltage!r}")
        value = value.get(str(voltage), value.get(voltage))
        if isinstance(value, dict):
            if polarity not in value:
                raise ConfigError(f"no value for polarity {polarity!r}")
            value = value[polarity]
    return value


def for_voltage(s: Scenario, voltages: dict[str, object], polarities: dict[str, object], row_multipliers: dict | None = None, polarity_multipliers: dict | None = None) -> Scenario:
    """The scenario of one combination of voltage and polarity by option.

    A right-of-way multiplier that is a number scales a layer; one that maps
    spatial layers to numbers makes one term a layer.
    """

    def expanded(layer, name):
        scale, spatial = 1.0, {None: 1.0}
        if layer.apply_row_mult:
            found = (row_multipliers or {}).get(str(voltages[name]))
            if found is None:
                raise ConfigError(f"no right-of-way multiplier for voltage {voltages[name]!r}")
            if isinstance(found, dict):
                spatial = found
            else:
                scale *= found
        if layer.apply_polarity_mult:
            scale *= _looked_up(polarity_multipliers or {}, voltages[name], polarities[name]) * POLARITY_SCALE
        out = []
        for extra, value in spatial.items():
            change = {"multiplier_scalar": layer.multiplier_scalar * scale * value, "apply_row_mult": False, "apply_polarity_mult": False}
            if extra is not None:
                change["multiplier_layer"] = [*_names(layer.multiplier_layer), extra]
            out.append(type(layer)(**{**layer.__dict__, **change}))
        return out

    options = {}
    for name, o in s.options.items():
        given = dict(o.__dict__)
        for kind in ("cost_layers", "friction_layers"):
            given[kind] = [x for layer in given[kind] for x in expanded(layer, name)]
        options[name] = Option(**given)
    pairs = {}
    for (a, b), cost in s.transitions.pairwise.items():
        found = {_looked_up(cost, voltages[n], polarities[n]) for n in (a, b)} if isinstance(cost, dict) else {cost}
        if len(found) > 1:
            raise ConfigError(f"options {a} and {b} disagree on their transition cost")
        pairs[a, b] = found.pop()
    return Scenario(options, s.drivers, Transitions(s.transitions.default, pairs), s.invalid_costs_block_routing)

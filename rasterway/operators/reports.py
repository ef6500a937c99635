"""Metrics of routes from their steps: lengths, costs, options, segments, geometry.

``steps`` has route keys, step, row, col and option; keys are given by name, so that
any identification of routes works.
"""

from __future__ import annotations

import posixpath
import re
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterway.errors import ConfigError
from rasterway.functions import expressions as X
from rasterway.grid import Grid
from rasterway.plans.scenario import Scenario, TrackedLayer, _names, report_costs, report_layer


def _order(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("step")


def _distance(row: Column, col: Column) -> Column:
    return F.sqrt(row * row + col * col)


def travel_lengths(steps: DataFrame, keys: list[str]) -> DataFrame:
    """``steps`` with len, in cells: half of the step in plus half of the step out."""
    w = _order(keys)
    gap = lambda shift: F.coalesce(_distance(F.col("row") - shift("row").over(w), F.col("col") - shift("col").over(w)), F.lit(0.0)) / 2
    return steps.withColumn("len", gap(F.lag) + gap(F.lead))


def sampled(steps: DataFrame, cells: DataFrame, layers: list[str]) -> DataFrame:
    """``steps`` with the layers' values at their cells."""
    return steps.join(cells.select("row", "col", *layers), ["row", "col"], "left")


def option_metrics(measured: DataFrame, cells: DataFrame, s: Scenario, keys: list[str], grid: Grid) -> DataFrame:
    """Per route and option crossed: cost (without transitions) and length_km, in one join.  ``measured`` has len."""
    costs = [report_costs(s, n) for n in s.names]
    values = cells.select("row", "col", F.array(*(c for c, _ in costs)).alias("_c"), F.array(*(i for _, i in costs)).alias("_i"))
    at = measured.where(F.col("option").between(0, len(s.names) - 1)).join(values, ["row", "col"])
    own = lambda c: F.get(F.col(c), F.col("option"))
    by = at.groupBy(*keys, "option").agg((F.sum(own("_c") * F.col("len")) + F.sum(own("_i"))).alias("cost"), (F.sum("len") * F.lit(grid.cell) / 1000).alias("length_km"))
    name = F.get(F.array(*(F.lit(n) for n in s.names)), F.col("option"))
    return by.select(*keys, name.alias("option_name"), "cost", "length_km")


def transition_costs(steps: DataFrame, s: Scenario, keys: list[str]) -> DataFrame:
    """Per route the summed cost of its option changes."""
    names = F.array([F.lit(n) for n in s.names])
    pairs = [(a, b, s.transitions.cost(a, b)) for a in s.names for b in s.names if a != b]
    before = F.lag("option").over(_order(keys))
    changed = steps.withColumn("_b", before).withColumn("_from", F.get(names, F.col("_b"))).withColumn("_to", F.get(names, F.col("option")))
    cost = F.lit(0.0)
    for a, b, c in pairs:
        cost = F.when((F.col("_from") == a) & (F.col("_to") == b), F.lit(float(c))).otherwise(cost)
    return changed.groupBy(*keys).agg(F.sum(F.when(F.col("_b").isNotNull(), cost).otherwise(0.0)).alias("total_transition_costs"))


def _along(value: Column, grid: Grid, invariant: bool, method: str | None) -> dict[str, Column]:
    """Aggregates of one layer's values along a route: one by name, or cost and length_km where it is positive."""
    if method:
        return {method: X.aggregate(method)(value).cast("float")}
    cost = value if invariant else value * F.col("len")
    length = F.sum(F.when(value > 0, F.col("len")).otherwise(0.0)) * F.lit(grid.cell) / 1000
    return {"cost": F.sum(cost).cast("float"), "length_km": length.cast("float")}


def layer_along(measured: DataFrame, cells: DataFrame, value: Column, keys: list[str], grid: Grid, invariant: bool = False, method: str | None = None) -> DataFrame:
    """One layer along routes: cost and length_km where it is positive, or one aggregate."""
    at = measured.join(cells.select("row", "col", value.alias("_v")), ["row", "col"])
    return at.groupBy(*keys).agg(*(x.alias(n) for n, x in _along(F.col("_v"), grid, invariant, method).items()))


def tracked(s: Scenario) -> list[tuple[str, str, Column, bool, str | None]]:
    """(option, name, value, invariant, method) of all that is reported; equal names and kinds add up."""
    out = []
    for option, o in s.options.items():
        merged: dict[tuple[str, bool], list[Column]] = {}
        for c in o.cost_layers:
            if c.include_in_report:
                merged.setdefault((c.layer_name, c.is_invariant), []).append(report_layer(c))
        out += [(option, name, X.total(v), inv, None) for (name, inv), v in merged.items()]
        for f in o.friction_layers:
            if f.include_in_report:
                names = _names(f.multiplier_layer)
                out.append((option, "_".join(names), X.product([*(X.single(F.col(n)) for n in names), X.single(f.multiplier_scalar)]), False, None))
        for t in o.tracked_layers:
            X.aggregate(t.agg_method)
            out.append((option, t.layer_name, report_layer(TrackedLayer(t.layer_name, t.agg_method, t.multiplier_layer, t.multiplier_scalar)), False, t.agg_method))
    return out


def slug(text: str) -> str:
    """A name as part of a column's name."""
    return re.sub(r"[^0-9a-zA-Z]+", "_", text.strip()).strip("_").lower()


def route_table(solutions: DataFrame, steps: DataFrame, cells: DataFrame, s: Scenario, grid: Grid, attributes: DataFrame | None = None) -> DataFrame:
    """One wide row a route: ends, objective, totals, per option and per layer, and attributes by left join.

    Steps meet the cells once, with the costs of all options and all reported layers.
    """
    keys = ["route_id", "start_row", "start_col", "start_option"]
    costs, layers = [report_costs(s, n) for n in s.names], tracked(s)
    values = cells.select(
        "row", "col",
        *(x.alias(f"_{kind}{i}") for i, pair in enumerate(costs) for kind, x in zip("ci", pair)),
        *(value.alias(f"_v{k}") for k, (_, _, value, _, _) in enumerate(layers)),
    )
    at = travel_lengths(steps, keys).select(*keys, "row", "col", "option", "len").join(values, ["row", "col"])
    own = lambda i, c: F.when(F.col("option") == i, c)
    some = {}
    for i, n in enumerate(s.names):
        cost = F.coalesce(F.sum(own(i, F.col(f"_c{i}") * F.col("len"))) + F.sum(own(i, F.col(f"_i{i}"))), F.lit(0.0))
        some |= {f"{slug(n)}_cost": cost, f"{slug(n)}_length_km": F.coalesce(F.sum(own(i, F.col("len"))), F.lit(0.0)) * F.lit(grid.cell) / 1000}
    for k, (option, name, _, invariant, method) in enumerate(layers):
        found = _along(own(s.names.index(option), F.col(f"_v{k}")), grid, invariant, method)
        some |= {f"{slug(name)}_{slug(option)}_{n}": x if method else F.coalesce(x, F.lit(0.0).cast("float")) for n, x in found.items()}
    wide = at.groupBy(*keys).agg(*(x.alias(n) for n, x in some.items()))
    total = lambda kind: X.total([F.col(f"{slug(n)}_{kind}") for n in s.names])
    wide = wide.withColumn("_cost", total("cost")).withColumn("length_km", total("length_km"))
    out = solutions.join(wide, keys).join(transition_costs(steps, s, keys), keys)
    out = out.withColumn("cost", F.col("_cost") + F.col("total_transition_costs")).drop("_cost")
    out = out.withColumn("poi_lat", grid.y(F.col("start_row"))).withColumn("poi_lon", grid.x(F.col("start_col")))
    out = out.withColumn("dropped_barrier_layers", F.when(F.size("dropped") > 0, F.to_json("dropped"))).drop("dropped")
    if attributes is not None:
        fresh = [c for c in attributes.columns if c not in out.columns or c in keys]
        out = out.join(attributes.select(*fresh), [k for k in keys if k in attributes.columns], "left")
    return out


def companion(by_option: DataFrame, layers: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """One row a route and option; what an option lacks is missing."""
    out = by_option.withColumnRenamed("option_name", "routing_option")
    for name, found in layers:
        out = out.join(found.withColumnsRenamed({"cost": f"{slug(name)}_cost", "length_km": f"{slug(name)}_length_km"}), [*keys], "left")
    return out


def segments(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of one option (segment, option, at, row, col); where options change both runs share the midpoint."""
    w = _order(keys)
    changed = F.coalesce((F.col("option") != F.lag("option").over(w)).cast("int"), F.lit(0))
    runs = steps.withColumn("_new", changed).withColumn("segment", F.sum("_new").over(w)).withColumn("_r", F.lead("row").over(w)).withColumn("_c", F.lead("col").over(w)).withColumn("_next", F.lead("_new").over(w))
    plain = runs.select(*keys, "segment", "option", F.col("step").cast("double").alias("at"), F.col("row").cast("double").alias("row"), F.col("col").cast("double").alias("col"))
    after = F.lead("option").over(w)
    with_next = runs.withColumn("_to", after).where("_next = 1").select(*keys, "segment", "option", "_to", "step", ((F.col("row") + F.col("_r")) / 2).alias("mr"), ((F.col("col") + F.col("_c")) / 2).alias("mc"))
    middle = F.explode(F.array(F.struct(F.col("segment").alias("g"), F.col("option").alias("o")), F.struct((F.col("segment") + 1).alias("g"), F.col("_to").alias("o"))))
    shared = with_next.withColumn("_m", middle).select(*keys, F.col("_m.g").alias("segment"), F.col("_m.o").alias("option"), (F.col("step") + 0.5).alias("at"), F.col("mr").alias("row"), F.col("mc").alias("col"))
    return plain.unionByName(shared)


def simplified(steps: DataFrame, keys: list[str], tolerance: float | None = None) -> DataFrame:
    """Steps where a route turns, with its ends.

    Without a tolerance a point goes if the step out of it equals the step into it.  With
    one, a point goes if the slope (d row over d col, none where vertical) of the step
    out of it differs by less than the tolerance from that of the last kept segment.
    """
    w = _order(keys)
    if tolerance is None:
        same = (F.col("row") - F.lag("row").over(w) == F.lead("row").over(w) - F.col("row")) & (F.col("col") - F.lag("col").over(w) == F.lead("col").over(w) - F.col("col"))
        return steps.withColumn("_s", F.coalesce(same, F.lit(False))).where("NOT _s").drop("_s")
    point = F.struct(F.col("step").cast("int").alias("step"), F.col("row").cast("double").alias("row"), F.col("col").cast("double").alias("col"))
    whole = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("p"))
    slope = lambda a, b: F.when(b["col"] != a["col"], (b["row"] - a["row"]) / (b["col"] - a["col"]))
    kind = "struct<kept:array<struct<step:int,row:double,col:double>>,last:struct<step:int,row:double,col:double>,slope:double,any:boolean>"
    start = F.struct(F.array(F.col("p")[0]).alias("kept"), F.col("p")[0].alias("last"), F.lit(None).cast("double").alias("slope"), F.lit(False).alias("any")).cast(kind)

    def step(acc, x):
        now = slope(acc["last"], x)
        same = acc["any"] & (now.eqNullSafe(acc["slope"]) | F.coalesce(F.abs(now - acc["slope"]) < tolerance, F.lit(False)))
        kept = F.when(same | ~acc["any"], acc["kept"]).otherwise(F.concat(acc["kept"], F.array(acc["last"])))
        running = F.when(same, acc["slope"]).otherwise(now)
        return F.struct(kept.alias("kept"), x.alias("last"), running.alias("slope"), F.lit(True).alias("any")).cast(kind)

    rest = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    end = lambda acc: F.when(acc["any"], F.concat(acc["kept"], F.array(acc["last"]))).otherwise(acc["kept"])
    out = whole.select(*keys, F.explode(F.aggregate(rest, start, step, end)).alias("k"))
    return out.select(*keys, "k.step", F.col("k.row").cast("int").alias("row"), F.col("k.col").cast("int").alias("col"))


def wkt(points: DataFrame, keys: list[str], grid: Grid, order: str = "step") -> DataFrame:
    """Per route a LINESTRING through cell centres, or a POINT."""
    xy = F.concat_ws(" ", grid.x(F.col("col")).cast("string"), grid.y(F.col("row")).cast("string"))
    lines = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), xy.alias("xy")))).alias("p"))
    body = F.array_join(F.transform("p", lambda q: q["xy"]), ", ")
    return lines.select(*keys, F.when(F.size("p") > 1, F.concat(F.lit("LINESTRING ("), body, F.lit(")"))).otherwise(F.concat(F.lit("POINT ("), body, F.lit(")"))).alias("wkt"))


def option_wkt(runs: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """Per route and option a MULTILINESTRING of its runs (as ``segments`` gives them), through ends and turns.

    A route of one cell is a POINT.
    """
    w = Window.partitionBy(*keys, "segment").orderBy("at")
    into = lambda c: F.col(c) - F.lag(c).over(w)
    out = lambda c: F.lead(c).over(w) - F.col(c)
    straight = (into("row") * out("col") == into("col") * out("row")) & (into("row") * out("row") + into("col") * out("col") > 0)
    turns = runs.withColumn("_s", F.coalesce(straight, F.lit(False))).where("NOT _s")
    xy = F.concat_ws(" ", grid.x(F.col("col")).cast("string"), grid.y(F.col("row")).cast("string"))
    lines = turns.groupBy(*keys, "segment", "option").agg(F.array_sort(F.collect_list(F.struct("at", xy.alias("xy")))).alias("p"))
    lines = lines.select(*keys, "segment", "option", F.size("p").alias("n"), F.array_join(F.transform("p", lambda q: q["xy"]), ", ").alias("line"))
    whole = lines.groupBy(*keys, "option").agg(F.array_sort(F.collect_list(F.struct("segment", "line"))).alias("l"), F.max("n").alias("n"))
    several = F.concat(F.lit("MULTILINESTRING ("), F.array_join(F.transform("l", lambda s: F.concat(F.lit("("), s["line"], F.lit(")"))), ", "), F.lit(")"))
    return whole.select(*keys, "option", F.when(F.col("n") > 1, several).otherwise(F.concat(F.lit("POINT ("), F.col("l")[0]["line"], F.lit(")"))).alias("wkt"))


def write_routes(routes: DataFrame, options: DataFrame, path: str, geometry: str | None = None, mode: str = "errorifexists") -> tuple[str, str]:
    """Writes routes and their rows by option; gives both paths, the second with ``_routing_options`` after the stem.

    With a ``geometry`` column the files are Parquet, else CSV; another ending is replaced with a
    warning.  Rows by option without a geometry are left out then.
    """
    want = ".parquet" if geometry else ".csv"
    stem, end = posixpath.splitext(path)
    if end.lower() != want:
        warnings.warn(f"routes {'with' if geometry else 'without'} paths are written as {want}, not as {path!r}", stacklevel=2)
        end = want
    targets = f"{stem}{end}", f"{stem}_routing_options{end}"
    for table, target in zip((routes, options.where(F.col(geometry).isNotNull()) if geometry else options), targets):
        if geometry:
            table.write.mode(mode).parquet(target)
        else:
            table.write.mode(mode).option("header", True).csv(target)
    return targets

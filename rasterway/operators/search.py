"""Least-cost paths over a surface of cells and options.

``edges`` gives the graph as a DataFrame, ``distances`` relaxes it in supersteps of joins.
``find_paths`` relaxes tile by tile: a task settles one tile for one search from
the distances that reached it, and what crosses a border goes to the neighbouring tile
in the next superstep.  A task never holds more than a tile and its border, the
number of supersteps follows the number of tiles that a path crosses, and no route
or surface passes the driver.

Weights are integers in ten-thousandths: a step of half a side (or half a diagonal) in
either cell, plus the invariant cost of the cell entered, cut off; changing the option
adds its own cost, cut off.  Among equal paths the smallest parent wins.

The bidirectional kind also searches backward from all goals at once, over the same
steps turned round (a step keeps the invariant cost of the cell that it enters).  Once
both sides know a place, half of the least sum bounds either of them; among equal paths
it takes the one through the first place where they meet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterway.errors import ConfigError
from rasterway.functions import expressions as X
from rasterway.plans.scenario import Scenario, surface, transition_table, traversable
from rasterway.storage import shared_dir, written

ALGORITHMS = ("dijkstra", "astar", "long_range_dijkstra", "long_range_astar", "bidirectional_long_range_dijkstra")
OFFSETS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
SIDE, CORNER = np.float32(0.5), np.float32(np.sqrt(2) / 2)
NEVER = np.iinfo(np.int64).max
#: Cells along a tile's side.
TILE = 256


def algorithm(name: str) -> str:
    """The canonical name; all of them give exact least-cost paths; the A* kind is led by lower bounds, the bidirectional one searches from both ends."""
    found = name.strip().lower().replace("-", "_").replace("a_star", "astar")
    if found not in ALGORITHMS:
        raise ConfigError(f"unknown algorithm {name!r}")
    return found


def slot(row: Column, col: Column, option: Column, ncols: int, noptions: int) -> Column:
    """The dense number of a cell and option."""
    return (row.cast("long") * ncols + col) * noptions + option


def unslot(s: Column, ncols: int, noptions: int) -> list[Column]:
    """row, col and option of a slot."""
    cell = F.floor(s / noptions)
    return [F.floor(cell / ncols).cast("int").alias("row"), (cell % ncols).cast("int").alias("col"), (s % noptions).cast("int").alias("option")]


def neighbours(cells: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Each cell with its eight neighbours (n_row, n_col, corner), without regard to borders."""
    offsets = F.array([F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in OFFSETS])
    out = cells.withColumn("_o", F.explode(offsets))
    return out.select("*", (F.col("row") + F.col("_o.i")).alias("n_row"), (F.col("col") + F.col("_o.j")).alias("n_col"), ((F.col("_o.i") != 0) & (F.col("_o.j") != 0)).alias("corner")).drop("_o")


def edges(surf: DataFrame, s: Scenario, attempt: int = 0) -> DataFrame:
    """(row, col, option, n_row, n_col, n_option, w): every allowed move with its integer weight."""
    ok = surf.where(traversable(attempt))
    near = neighbours(ok.select("row", "col", "option", "cost", "driver"))
    into = ok.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col("option").alias("n_option"), F.col("cost").alias("n_cost"), F.col("inv").alias("n_inv"), F.col("driver").alias("n_driver"))
    both = near.join(into, ["n_row", "n_col"])
    half = F.when(F.col("corner"), X.single(float(CORNER))).otherwise(X.single(0.5))
    w = half * (F.col("cost") * F.col("driver") + F.col("n_cost") * F.col("n_driver")) + F.col("n_inv") * F.col("n_driver")
    table = F.array([F.array([F.lit(float(x)) for x in row]) for row in transition_table(s)])
    switch = F.when(F.col("option") == F.col("n_option"), F.lit(0).cast("bigint")).otherwise(X.fixed_point(table[F.col("option")][F.col("n_option")]))
    return both.withColumn("_w", w).where((F.col("_w") > 0) & ~F.isnan("_w")).select("row", "col", "option", "n_row", "n_col", "n_option", (X.fixed_point(F.col("_w")) + switch).alias("w"))


def distances(edge: DataFrame, sources: DataFrame, most: int = 100_000) -> DataFrame:
    """Least weights from ``sources`` (id, node) over ``edge`` (src, dst, w): id, node, d.

    Each superstep joins only what improved in the last one with its edges.
    """
    edge = written(edge.select("src", "dst", "w"))
    known = written(sources.select("id", "node", F.lit(0).cast("bigint").alias("d"), F.lit(True).alias("fresh")).distinct())
    for _ in range(most):
        fresh = known.where("fresh")
        reached = fresh.join(edge, F.col("node") == F.col("src")).select("id", F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("n"))
        reached = reached.groupBy("id", "node").agg(F.min("n").alias("n"))
        step = known.select("id", "node", "d").join(reached, ["id", "node"], "full_outer")
        better = F.col("n").isNotNull() & (F.col("d").isNull() | (F.col("n") < F.col("d")))
        known = written(step.select("id", "node", F.least("d", "n").alias("d"), better.alias("fresh")))
        if not known.where("fresh").limit(1).count():
            break
    return known.select("id", "node", "d")


def meeting(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Per id the node where a forward and a backward table meet cheapest (node, total)."""
    both = forward.select("id", "node", "d").join(backward.select("id", "node", F.col("d").alias("b")), ["id", "node"])
    best = both.groupBy("id").agg(F.min(F.struct((F.col("d") + F.col("b")).alias("total"), "node")).alias("m"))
    return best.select("id", "m.node", "m.total")


# Tile by tile -----------------------------------------------------------------


def _tiles(surf: DataFrame, size: int, noptions: int) -> DataFrame:
    """(ti, tj, data): every tile with a border of one cell, packed and in order of tiles.

    A cell goes to its own tile, and to others only where it lies on its tile's edge.
    """

    def owners(at: str) -> Column:
        r = F.expr(f"{at} % {size}")
        return F.array_compact(F.array(F.lit(0), F.when(r == 0, F.lit(-1)), F.when(r == size - 1, F.lit(1))))

    near = surf.where(traversable(10**6)).withColumn("_di", F.explode(owners("row"))).withColumn("_dj", F.explode(owners("col")))
    own_i, own_j = F.expr(f"row div {size}") + F.col("_di"), F.expr(f"col div {size}") + F.col("_dj")
    near = near.select(own_i.cast("long").alias("ti"), own_j.cast("long").alias("tj"), "row", "col", "option", "cost", "inv", "driver", "soft_rank").where("ti >= 0 AND tj >= 0")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(pdf.ti.iloc[0]), int(pdf.tj.iloc[0])
        data = np.full((4, size + 2, size + 2, noptions), np.nan, np.float32)
        i, j, o = pdf.row.to_numpy() - ti * size + 1, pdf.col.to_numpy() - tj * size + 1, pdf.option.to_numpy()
        for k, name in enumerate(("cost", "inv", "driver", "soft_rank")):
            data[k, i, j, o] = pdf[name].to_numpy()
        return pd.DataFrame({"ti": [ti], "tj": [tj], "data": [data.tobytes()]})

    # Ranges of tiles keep a tile together, and let a superstep skip files far from its messages.
    return near.repartitionByRange("ti", "tj").groupBy("ti", "tj").applyInPandas(packed, "ti long, tj long, data binary")


class _Tile:
    """One tile's surface and the moves within it and over its border."""

    def __init__(self, data: bytes, ti: int, tj: int, size: int, noptions: int, ncols: int, switch: list[list[int]]):
        self.side, self.n, self.size, self.ti, self.tj, self.ncols = size + 2, noptions, size, ti, tj, ncols
        cost, inv, driver, soft = np.frombuffer(data, np.float32).reshape(4, -1)
        self.weighed, self.entry, self.soft, self.switch = (cost * driver), (inv * driver), soft, switch
        self.steps = [((i * self.side + j) * noptions, CORNER if i and j else SIDE) for i, j in OFFSETS]
        within = np.zeros((self.side, self.side, noptions), bool)
        within[1:-1, 1:-1] = True
        self.inside = within.ravel()

    def local(self, row: int, col: int, option: int) -> int:
        return ((row - self.ti * self.size + 1) * self.side + col - self.tj * self.size + 1) * self.n + option

    def place(self, local):
        cell, option = np.divmod(local, self.n)
        i, j = np.divmod(cell, self.side)
        return i - 1 + self.ti * self.size, j - 1 + self.tj * self.size, option

    def sums(self, dist: np.ndarray) -> np.ndarray:
        """What a path through each place of the tile itself costs, where both sides know it."""
        known = self.inside & (dist[0] < NEVER) & (dist[1] < NEVER)
        return np.where(known, np.where(known, dist[0], 0) + np.where(known, dist[1], 0), NEVER)

    def settle(self, dist: np.ndarray, parent: np.ndarray, reached: list[tuple], goals: list[int], attempt: int, bound: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Relaxes from improved places; returns the border places that improved, and which of them by a step of no weight.

        ``back``: distances are those to the goals, over steps turned round.

        Places within one usual step of the nearest waiting one are relaxed together; one
        that improves later waits again.  A step without weight never wins a tie, so
        parents form no circle.
        """
        waiting, out, flat = (np.zeros(len(dist), bool) for _ in range(3))
        for row, col, option, d, p, level in reached:
            at = self.local(row, col, option)
            if d < dist[at] or d == dist[at] and p < parent[at] and not level:
                waiting[at] = waiting[at] or d < dist[at]
                dist[at], parent[at] = d, p
        weighed, entry, inside = self.weighed, self.entry, self.inside
        passable = ~(self.soft > attempt)
        opened = inside & passable & ~np.isnan(weighed)
        usual = weighed[opened]
        width = max(1, int(min(float(np.median(usual)) * 10000, 2.0**52))) if len(usual) else 1
        waiting &= opened
        while True:
            queue = np.flatnonzero(waiting)
            if not len(queue):
                break
            d = dist[queue]
            if goals:
                bound = min(bound, int(dist[goals].min()))
            low = d.min()
            if low > bound:
                break
            queue = queue[(d <= low + width) & (d <= bound)]
            waiting[queue] = False
            for option in range(self.n):
                act = queue[queue % self.n == option] if self.n > 1 else queue
                if not len(act):
                    continue
                row, col, _ = self.place(act)
                d, own, here = dist[act], (row * self.ncols + col) * self.n + option, weighed[act]
                for step, half in self.steps:
                    for other in range(self.n):
                        to = act + (step - option + other)
                        w = half * (here + weighed[to]) + (entry[act] if back else entry[to])
                        ok = (w > 0) & np.isfinite(w) & passable[to]
                        units = np.where(ok, w * np.float32(10000), 0).astype(np.int64) + (self.switch[other][option] if back else self.switch[option][other])
                        total = d + units
                        better = ok & (total < dist[to])
                        hit = better | ok & (total == dist[to]) & (units > 0) & (own < parent[to])
                        if not hit.any():
                            continue
                        at = to[hit]
                        dist[at], parent[at], flat[at] = total[hit], own[hit], units[hit] == 0
                        out[at] = True
                        waiting[to[better]] = True
            waiting &= opened
        border = np.flatnonzero(out & ~inside)
        return border, flat[border]


_MESSAGE = "array<struct<row:int,col:int,option:int,d:bigint,p:bigint,level:boolean>>"
_STATE = f"id long, ti long, tj long, dist binary, parent binary, goal struct<d:bigint,row:int,col:int,option:int>, out array<struct<ti:bigint,tj:bigint,back:boolean,m:{_MESSAGE}>>"
_PLACE = [("row", pa.int32()), ("col", pa.int32()), ("option", pa.int32())]
_OUT = pa.struct([("ti", pa.int64()), ("tj", pa.int64()), ("back", pa.bool_()), ("m", pa.list_(pa.struct([*_PLACE, ("d", pa.int64()), ("p", pa.int64()), ("level", pa.bool_())])))])
_STATE_ARROW = pa.schema([("id", pa.int64()), ("ti", pa.int64()), ("tj", pa.int64()), ("dist", pa.binary()), ("parent", pa.binary()), ("goal", pa.struct([("d", pa.int64()), *_PLACE])), ("out", pa.list_(_OUT))])
_TRACE_ARROW = pa.schema([("id", pa.int64()), ("back", pa.int32()), *_PLACE, ("more", pa.bool_())])


def _rows(batches):
    """Rows one by one, so that a worker holds a single tile as objects of its own."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _settled(size: int, noptions: int, ncols: int, switch, attempt: int, sides: int):
    """(id, tile) rows with messages, state and goals to new states and outgoing messages.

    With two ``sides`` a state holds the forward and the backward distances one after the
    other, and its goal is the place where they meet cheapest.  Either side goes on from
    places within half of the bound; the forward one still tells the next tile what lies
    beyond it, so that the step in the middle of a path is met on one of its ends.
    """

    def run(batches):
        tile = None
        for r in _rows(batches):
            # Rows come in order of tiles: one is unpacked once for all the searches that called it.
            if tile is None or (tile.ti, tile.tj) != (r["ti"], r["tj"]):
                tile = _Tile(r["data"], r["ti"], r["tj"], size, noptions, ncols, switch)
            n = tile.side * tile.side * noptions
            dist, parent = ((np.full(sides * n, NEVER) if r[c] is None else np.frombuffer(r[c], np.int64).copy()).reshape(sides, n) for c in ("dist", "parent"))
            bound = NEVER - 1 if r["bound"] is None else r["bound"]
            ends = {tile.local(g["row"], g["col"], g["option"]): g for g in r["goals"] or []} if sides == 1 else {}
            border: dict[tuple[int, int, bool], list] = {}
            for side in range(sides):
                reached = [(m["row"], m["col"], m["option"], m["d"], m["p"], m["level"]) for some in r["messages"] if some["back"] == bool(side) for m in some["m"]]
                if not reached:
                    continue
                at, level = tile.settle(dist[side], parent[side], reached, list(ends), attempt, bound // sides, bool(side))
                if sides == 2:
                    bound = min(bound, int(tile.sums(dist).min()))
                most = bound // 2 if side else bound
                for row, col, option, d, p, even in zip(*(x.tolist() for x in tile.place(at)), dist[side, at].tolist(), parent[side, at].tolist(), level.tolist()):
                    if d <= most and row >= 0 and col >= 0:
                        border.setdefault((row // size, col // size, bool(side)), []).append({"row": row, "col": col, "option": option, "d": d, "p": p, "level": even})
            if sides == 2:
                sums = tile.sums(dist)
                k = int(sums.argmin())
                row, col, option = (int(x) for x in tile.place(k))
                goal = {"d": int(sums[k]), "row": row, "col": col, "option": option} if sums[k] < NEVER else None
            else:
                goals = [{"d": int(dist[0, k]), **g} for k, g in ends.items()]
                goal = min((g for g in goals if g["d"] < NEVER), key=lambda g: (g["d"], g["row"], g["col"], g["option"]), default=None)
            out = [{"ti": i, "tj": j, "back": back, "m": m} for (i, j, back), m in border.items()]
            yield pa.RecordBatch.from_pylist([{"id": r["id"], "ti": r["ti"], "tj": r["tj"], "dist": dist.tobytes(), "parent": parent.tobytes(), "goal": goal, "out": out}], schema=_STATE_ARROW)

    return run


def _traced(size: int, noptions: int, ncols: int, side: int):
    """Follows one side's parents inside one tile: path cells, and where the path goes on."""

    def run(batches):
        for r in _rows(batches):
            parent, rows = np.frombuffer(r["parent"], np.int64)[side * (size + 2) ** 2 * noptions :], []
            ti, tj, back, more = r["ti"], r["tj"], r["back"], False
            row, col, option = r["row"], r["col"], r["option"]
            while True:
                rows.append({"id": r["id"], "back": back, "row": row, "col": col, "option": option, "more": more})
                if more:
                    break
                p = int(parent[((row - ti * size + 1) * (size + 2) + col - tj * size + 1) * noptions + option])
                if p < 0 or p == NEVER:
                    break
                cell, option = divmod(p, noptions)
                row, col = divmod(cell, ncols)
                back += 1
                more = (row // size, col // size) != (ti, tj)
            yield pa.RecordBatch.from_pylist(rows, schema=_TRACE_ARROW)

    return run


def _tile_of(size: int) -> list[Column]:
    return [F.expr(f"row div {size}").alias("ti"), F.expr(f"col div {size}").alias("tj")]


@dataclass
class _States:
    """Settled tiles: a table a superstep, and an index of the superstep that touched a tile last.

    Only the index (no distances, no parents) is written anew in a superstep.
    """

    path: str
    index: DataFrame | None = None

    def read(self, spark, steps: list[int], columns: list[str]) -> DataFrame:
        """Tiles of these supersteps; the others' files are not opened."""
        return spark.read.schema(f"{_STATE}, superstep int").option("basePath", self.path).parquet(*[f"{self.path}/superstep={k}" for k in steps]).select("id", "ti", "tj", "superstep", *columns)

    def add(self, states: DataFrame, k: int) -> DataFrame:
        states.write.parquet(f"{self.path}/superstep={k}")
        touched = self.read(states.sparkSession, [k], ["goal", "out"])
        now = touched.select("id", "ti", "tj", "superstep", "goal")
        keys = ["id", "ti", "tj"]
        self.index = written(now if self.index is None else now.unionByName(self.index.join(now.select(*keys), keys, "left_anti")))
        return touched


@dataclass
class Bounds:
    """What a path costs at least between tiles, for searches that are led by it.

    A path from one column of tiles to another passes every column of cells between them,
    and a cell that it passes costs at least the least weight in its column of tiles; so
    do rows.  These sums are the lower bounds, for the nearest of the goals' tiles.
    """

    cols: list[int]
    rows: list[int]
    #: What waits longer than this behind the most promising tile of its search is put off.
    slack: int

    @staticmethod
    def of(surf: DataFrame, size: int, switch: list[list[int]]) -> "Bounds":
        """From a surface: one number a row and a column of tiles."""
        least = F.min(F.col("cost") * F.col("driver")).alias("least")
        some = surf.where(traversable(10**6))
        spoiled = some.where((F.col("inv") * F.col("driver") < 0) | (F.col("driver") < 0)).limit(1).count() or min(min(r) for r in switch) < 0
        sums = []
        for axis in ("row", "col"):
            found = {r.k: r.least for r in some.groupBy(F.expr(f"{axis} div {size}").alias("k")).agg(least).collect()}
            # Weights are cut off step by step, and halves are rounded in single precision.
            units = [0 if spoiled or found.get(k) is None or found[k] != found[k] else max(0, int(found[k] * 10000 * (1 - 1e-6)) - 2) * size for k in range(max(found, default=0) + 1)]
            sums.append([0, *np.cumsum(units).tolist()])
        usual = [b - a for one in sums for a, b in zip(one, one[1:])]
        return Bounds(sums[1], sums[0], int(np.median(usual)) if usual else 0)

    def to(self, ti: Column, tj: Column) -> Column:
        """The least cost from a tile to the box (i0, i1, j0, j1) of the goals' tiles."""

        def along(at: Column, lo: Column, hi: Column, sums: list[int]) -> Column:
            table, most = F.array(*(F.lit(x).cast("bigint") for x in sums)), F.lit(len(sums) - 1).cast("bigint")
            total = lambda k: F.get(table, F.greatest(F.lit(0).cast("bigint"), F.least(k, most)).cast("int"))
            return F.when(at < lo, total(lo) - total(at + 1)).when(at > hi, total(at) - total(hi + 1)).otherwise(F.lit(0))

        return F.greatest(F.lit(0), along(ti, F.col("i0"), F.col("i1"), self.rows), along(tj, F.col("j0"), F.col("j1"), self.cols))

    def due(self, messages: DataFrame, boxes: DataFrame, best: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """(messages to take now, those to wait); what cannot beat a found goal is dropped."""
        hoped = F.array_min(F.transform("m", lambda m: m["d"])) + self.to(F.col("ti"), F.col("tj"))
        all_ = messages.join(boxes, "id").withColumn("hoped", hoped)
        if best is not None:
            all_ = all_.join(best.select("id", F.col("goal.d").alias("bound")), "id", "left").where("bound IS NULL OR hoped <= bound").drop("bound")
        all_ = written(all_.select("id", "ti", "tj", "back", "m", "hoped"))
        first = all_.groupBy("id").agg((F.min("hoped") + self.slack).alias("until"))
        split = all_.join(first, "id")
        return split.where("hoped <= until").select("id", "ti", "tj", "back", "m"), split.where("hoped > until").select("id", "ti", "tj", "back", "m")


def _due(messages: DataFrame, best: DataFrame | None, index: DataFrame | None, slack: int) -> tuple[DataFrame, DataFrame]:
    """(messages to take now, those to wait) of searches from both ends.

    The side that is behind goes first, so that both reach equally far.  Beyond half of
    the bound only a meeting can be found: such messages come last, and only to tiles
    that the search has been in.  A search one side of which has ended without a meeting
    has no path.
    """
    least = F.array_min(F.transform("m", lambda m: m["d"]))
    all_ = messages.withColumn("least", least)
    if best is None:
        all_ = all_.withColumn("far", F.lit(False)).withColumn("bound", F.lit(None).cast("bigint"))
    else:
        all_ = all_.join(best.select("id", F.col("goal.d").alias("bound")), "id", "left")
        all_ = all_.withColumn("far", F.expr("coalesce(least > bound div 2, false)")).where("bound IS NULL OR NOT far OR NOT back AND least < bound")
    all_ = written(all_.select("id", "ti", "tj", "back", "m", "least", "far", "bound"))
    first = all_.groupBy("id").agg((F.min("least") + slack).alias("until"), F.bool_and("far").alias("last"), (F.min("back") != F.max("back")).alias("both"))
    split = all_.join(first, "id").where("both OR bound IS NOT NULL")
    taken = ["id", "ti", "tj", "back", "m"]
    now = split.where("NOT far AND least <= until").select(*taken)
    if index is not None:
        now = now.unionByName(split.where("last").select(*taken).join(index.select("id", "ti", "tj"), ["id", "ti", "tj"], "left_semi"))
    return now, split.where("NOT last AND (far OR least > until)").select(*taken)


def _attempt(tiles: DataFrame, starts: DataFrame, goals: DataFrame, size: int, noptions: int, ncols: int, switch, attempt: int, bounds: Bounds | None = None, sides: int = 1) -> tuple[_States, DataFrame]:
    """(states, best goals) of one attempt for ``starts`` (id, row, col, option), led by lower ``bounds`` if there are any.

    With two ``sides`` the goals are searched from as well, and the best goals are the places where both meet.
    """
    spark, keys = tiles.sparkSession, ["id", "ti", "tj"]
    states = _States(shared_dir(spark))
    place = F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("option").cast("int").alias("option"), F.lit(0).cast("bigint").alias("d"), F.lit(-1).cast("bigint").alias("p"), F.lit(False).alias("level"))
    ahead = lambda places, back: places.select("id", *_tile_of(size), F.lit(back).alias("back"), F.array(place).alias("m"))
    messages = ahead(starts, False) if sides == 1 else ahead(starts, False).unionByName(ahead(goals, True))
    wanted = written(goals.groupBy("id", *_tile_of(size)).agg(F.collect_set(F.struct("row", "col", "option")).alias("goals")))
    boxes = None if bounds is None or sides == 2 else written(wanted.groupBy("id").agg(*(f(c).cast("bigint").alias(f"{c[1]}{k}") for c in ("ti", "tj") for k, f in enumerate((F.min, F.max)))))
    best, waiting, k = None, None, 0
    while True:
        if bounds is not None:
            messages = messages if waiting is None else messages.unionByName(waiting)
            messages, waiting = bounds.due(messages, boxes, best) if sides == 1 else _due(messages, best, states.index, bounds.slack)
        called = messages.select(*keys)
        called = called.withColumn("superstep", F.lit(None).cast("int")) if best is None else called.join(states.index.select(*keys, "superstep"), keys, "left")
        # Five numbers: which tiles and which earlier supersteps this one has to open.
        seen = called.agg(F.min("ti").alias("i0"), F.max("ti").alias("i1"), F.min("tj").alias("j0"), F.max("tj").alias("j1"), F.collect_set("superstep").alias("steps")).first()
        if seen.i0 is None:
            if best is None:
                best = spark.createDataFrame([], "id long, goal struct<d:bigint,row:int,col:int,option:int>")
                states.index = spark.createDataFrame([], "id long, ti long, tj long, superstep int, goal struct<d:bigint,row:int,col:int,option:int>")
            return states, written(best)
        ready = messages.groupBy(*keys).agg(F.collect_list(F.struct("back", "m")).alias("messages")).join(wanted, keys, "left")
        if seen.steps:
            known = states.read(spark, sorted(seen.steps), ["dist", "parent"])
            ready = ready.join(states.index.select(*keys, "superstep"), keys, "left").join(known, [*keys, "superstep"], "left")
        else:
            ready = ready.withColumn("dist", F.lit(None).cast("binary")).withColumn("parent", F.lit(None).cast("binary"))
        ready = ready.withColumn("bound", F.lit(None).cast("bigint")) if best is None else ready.join(best.select("id", F.col("goal.d").alias("bound")), "id", "left")
        # Tiles come last, so that a tile is shuffled once, not once for each search that called it.
        near = tiles.where(F.col("ti").between(seen.i0, seen.i1) & F.col("tj").between(seen.j0, seen.j1))
        ready = ready.join(near.hint("merge"), ["ti", "tj"]).select(*keys, "data", "messages", "goals", "dist", "parent", "bound")
        touched = states.add(ready.mapInArrow(_settled(size, noptions, ncols, switch, attempt, sides), _STATE), k)
        reached = touched.where("goal IS NOT NULL").select("id", "goal")
        best = written((reached if best is None else reached.unionByName(best)).groupBy("id").agg(F.min("goal").alias("goal")))
        messages = touched.select("id", F.explode("out").alias("o")).select("id", "o.ti", "o.tj", "o.back", "o.m")
        k += 1


def _paths(states: _States, best: DataFrame, size: int, noptions: int, ncols: int, side: int = 0) -> DataFrame:
    """(id, back, row, col, option): cells from the goal, back = 0, to the start (or from where both sides meet to the end that ``side`` came from)."""
    spark, keys = best.sparkSession, ["id", "ti", "tj"]
    done: list[DataFrame] = []
    ahead = best.select("id", "goal.row", "goal.col", "goal.option", F.lit(0).alias("back"))
    while True:
        at = ahead.select("id", "row", "col", "option", "back", *_tile_of(size)).join(states.index.select(*keys, "superstep"), keys)
        steps = sorted(r.superstep for r in at.select("superstep").distinct().collect())
        if not steps:
            return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "id long, back int, row int, col int, option int")
        ready = at.join(states.read(spark, steps, ["parent"]), [*keys, "superstep"]).drop("superstep")
        step = written(ready.mapInArrow(_traced(size, noptions, ncols, side), "id long, back int, row int, col int, option int, more boolean"))
        done.append(step.where("NOT more").drop("more"))
        ahead = step.where("more").select("id", "row", "col", "option", "back")


def _joined(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """One path from both halves: ``back`` is 0 at the meeting place and below it beyond.

    Over steps without weight the halves may pass one place twice: what lies between is cut
    out at the common place nearest to the start.
    """
    place = ["id", "row", "col", "option"]
    common = forward.join(backward.withColumnRenamed("back", "on"), place)
    cut = common.groupBy("id").agg(F.max(F.struct("back", "on")).alias("cut"))
    before = forward.join(cut, "id").where("back >= cut.back")
    after = backward.join(cut, "id").where("back > cut.on").withColumn("back", (F.col("cut.back") + F.col("cut.on") - F.col("back")).cast("int"))
    return before.unionByName(after).select("id", "back", "row", "col", "option")


def find_paths(cells: DataFrame, s: Scenario, starts: DataFrame, ends: DataFrame, ncols: int, tile: int = TILE, name: str = "long_range_dijkstra") -> tuple[DataFrame, DataFrame]:
    """The least-cost path of every start of every route to the cheapest of the route's ends.

    ``starts`` and ``ends`` have route_id, row, col, option.  Returns solutions
    (route_id, start_row, start_col, start_option, end_row, end_col, end_option,
    objective, cost_units, dropped) and steps (the same start columns, step, row, col, option).
    Starts without a path are left out.  Soft barriers fall group by group, least
    important first, for those starts alone that have no path yet.
    """
    kind = algorithm(name)
    sides = 2 if kind.startswith("bidirectional") else 1
    n = len(s.names)
    surf = written(surface(cells, s))
    tiles = written(_tiles(surf, tile, n))
    switch = [[int(np.float32(np.float32(x) * np.float32(10000))) for x in row] for row in transition_table(s)]
    keys = ["route_id", "row", "col", "option"]
    # An id a distinct start, made once and stored.
    unsolved = written(starts.select(*keys).distinct().withColumn("id", F.xxhash64(*keys)))
    ends = ends.select(*keys).distinct()
    bounds = Bounds.of(surf, tile, switch) if sides == 2 or kind.endswith("astar") else None
    solutions, steps = [], []
    for attempt in range(len(s.soft_groups) + 1):
        open_ = surf.where(traversable(attempt) & (F.col("cost") > 0)).select("row", "col", "option")
        allowed = unsolved.join(open_, ["row", "col", "option"], "left_semi")
        # A search whose ends cannot be entered would settle all that it reaches for nothing.
        goals = written(allowed.select("id", "route_id").join(ends.join(open_, ["row", "col", "option"], "left_semi"), "route_id").select("id", "row", "col", "option"))
        allowed = allowed.join(goals.select("id").distinct(), "id", "left_semi")
        states, best = _attempt(tiles, allowed.select("id", "row", "col", "option"), goals, tile, n, ncols, switch, attempt, bounds, sides)
        path = _paths(states, best, tile, n, ncols)
        if sides == 2:
            path = written(_joined(path, _paths(states, best, tile, n, ncols, 1)))
            last = path.groupBy("id").agg(F.min_by(F.struct("row", "col", "option"), "back").alias("last"))
            best = best.join(last, "id").select("id", F.struct("goal.d", "last.*").alias("goal"))
        dropped = F.array([F.lit(x) for x in s.dropped(attempt)]).cast("array<string>")
        found = unsolved.join(best, "id")
        solutions.append(found.select("id", "route_id", F.col("row").alias("start_row"), F.col("col").alias("start_col"), F.col("option").alias("start_option"), F.col("goal.row").alias("end_row"), F.col("goal.col").alias("end_col"), F.col("goal.option").alias("end_option"), X.from_fixed_point(F.col("goal.d")).alias("objective"), F.col("goal.d").alias("cost_units"), dropped.alias("dropped")))
        steps.append(path)
        unsolved = written(unsolved.join(best, "id", "left_anti"))
        if not unsolved.limit(1).count():
            break
    found = written(reduce(DataFrame.unionByName, solutions))
    path = reduce(DataFrame.unionByName, steps)
    length = path.groupBy("id").agg(F.max("back").alias("last"))
    path = path.join(length, "id").join(found.select("id", "route_id", "start_row", "start_col", "start_option"), "id")
    path = path.select("route_id", "start_row", "start_col", "start_option", (F.col("last") - F.col("back")).alias("step"), "row", "col", "option")
    return found.drop("id"), path

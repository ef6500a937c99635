"""Least-cost paths against known values and a plain heap search."""

import heapq
import random

import numpy as np
import pytest

from rasterway.errors import ConfigError
from rasterway.operators import search
from rasterway.plans.scenario import Scenario

PLAIN = {"routing_options": {"o": {"cost_layers": [{"layer_name": "c"}]}}}


def grid(spark, values, **more):
    names = ["c", *more]
    rows = [(i, j, *(float(np.asarray(v)[i][j]) for v in (values, *more.values()))) for i in range(len(values)) for j in range(len(values[0]))]
    return spark.createDataFrame(rows, "row int, col int, " + ", ".join(f"{n} float" for n in names))


def found(spark, cells, config, starts, ends, ncols, tile=4, name="dijkstra"):
    kind = "route_id int, row int, col int, option int"
    paths, steps = search.find_paths(cells, Scenario.from_json(config), spark.createDataFrame(starts, kind), spark.createDataFrame(ends, kind), ncols, tile, name)
    return paths, steps


def heap(costs, inv, start):
    """Integer distances of all cells: half steps of both cells, the invariant part of the entered one."""
    n, m = costs.shape
    dist, queue = {start: 0}, [(0, start)]
    while queue:
        d, (i, j) = heapq.heappop(queue)
        if d > dist[i, j]:
            continue
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                x, y = i + a, j + b
                if (a or b) and 0 <= x < n and 0 <= y < m and costs[x, y] > 0:
                    half = np.float32(np.sqrt(2) / 2) if a and b else np.float32(0.5)
                    w = half * (costs[i, j] + costs[x, y]) + inv[x, y]
                    total = d + int(np.float32(w) * np.float32(10000))
                    if total < dist.get((x, y), 1 << 62):
                        dist[x, y] = total
                        heapq.heappush(queue, (total, (x, y)))
    return dist


def test_known_costs(spark):
    cells = grid(spark, np.ones((8, 8)))
    starts = [(k, 1, 1, 0) for k in range(4)] + [(9, 1, 1, 0)]
    ends = [(0, 1, 1, 0), (1, 1, 2, 0), (2, 2, 2, 0), (3, 2, 3, 0), (9, 1, 4, 0), (9, 3, 1, 0), (9, 4, 4, 0)]
    paths, steps = found(spark, cells, PLAIN, starts, ends, 8)
    costs = {r.route_id: (round(r.objective, 4), r.end_row, r.end_col) for r in paths.collect()}
    assert costs == {0: (0.0, 1, 1), 1: (1.0, 1, 2), 2: (1.4142, 2, 2), 3: (2.4142, 2, 3), 9: (2.0, 3, 1)}
    assert {r["route_id"]: r["count"] for r in steps.groupBy("route_id").count().collect()} == {0: 1, 1: 2, 2: 2, 3: 3, 9: 3}


@pytest.mark.parametrize("tile", [2, 16])
def test_around_a_wall(spark, tile):
    cells = grid(spark, [[1, 50, 1, 1], [1, 50, 50, 1], [1, 50, 50, 1], [1, 1, 1, 1]])
    paths, steps = found(spark, cells, PLAIN, [(0, 0, 0, 0)], [(0, 0, 2, 0)], 4, tile)
    assert round(paths.first().objective, 4) == 8.2426
    assert [(r.row, r.col) for r in steps.orderBy("step").collect()] == [(0, 0), (1, 0), (2, 0), (3, 1), (3, 2), (2, 3), (1, 3), (0, 2)]


def test_equals_heap_search(spark):
    rng = random.Random(3)
    n, m = 11, 9
    costs = np.array([[rng.choice([0, rng.randint(1, 10**6) / 7]) if rng.random() < 0.3 else rng.randint(1, 1000) for _ in range(m)] for _ in range(n)], np.float32)
    inv = np.array([[rng.randint(1, 50) for _ in range(m)] for _ in range(n)], np.float32)
    costs[0, 0] = costs[5, 5] = 3
    config = {"routing_options": {"o": {"cost_layers": [{"layer_name": "c"}, {"layer_name": "i", "is_invariant": True}]}}}
    starts, ends, want = [], [], {}
    for k, start in enumerate([(0, 0), (5, 5)]):
        dist = heap(costs, inv, start)
        for e in range(12):
            end = (rng.randrange(n), rng.randrange(m))
            rid = 100 * k + e
            starts.append((rid, *start, 0)), ends.append((rid, *end, 0))
            if end in dist:
                want[rid] = dist[end]
    paths, _ = found(spark, grid(spark, costs, i=inv), config, starts, ends, m, 4)
    assert {r.route_id: r.cost_units for r in paths.collect()} == want


def test_no_route_and_soft_barriers(spark):
    wall = np.zeros((5, 5))
    wall[2, :] = 1
    hard = {"routing_options": {"o": {"cost_layers": [{"layer_name": "c"}], "barrier_layers": [{"layer_name": "w", "where": ">0"}]}}}
    soft = {"routing_options": {"o": {"cost_layers": [{"layer_name": "c"}], "barrier_layers": [{"layer_name": "w", "where": ">0", "barrier_importance": 1}]}}}
    cells = grid(spark, np.ones((5, 5)), w=wall)
    assert found(spark, cells, hard, [(0, 0, 0, 0)], [(0, 4, 0, 0)], 5)[0].count() == 0
    paths = found(spark, cells, soft, [(0, 0, 0, 0), (1, 0, 0, 0)], [(0, 4, 0, 0), (1, 0, 3, 0)], 5)[0]
    assert {r.route_id: (r.objective, r.dropped) for r in paths.collect()} == {0: (4.0, ["w"]), 1: (3.0, [])}


def test_option_changes(spark):
    config = {"routing_options": {"a": {"cost_layers": [{"layer_name": "c"}]}, "b": {"cost_layers": [{"layer_name": "d"}]}}, "transition_costs": {"default": 0}}
    cells = grid(spark, np.ones((1, 3)), d=np.full((1, 3), 5))
    paths = found(spark, cells, config, [(0, 0, 0, 0), (1, 0, 0, 0)], [(0, 0, 1, 1), (1, 0, 0, 1)], 3)[0]
    assert {r.route_id: r.cost_units for r in paths.collect()} == {0: 30000, 1: 40000}


def test_distances_by_joins(spark):
    costs = np.arange(1, 17, dtype=np.float32).reshape(4, 4)
    s = Scenario.from_json(PLAIN)
    from rasterway.plans.scenario import surface

    e = search.edges(surface(grid(spark, costs), s), s)
    from pyspark.sql import functions as F

    e = e.select((F.col("row") * 4 + F.col("col")).cast("long").alias("src"), (F.col("n_row") * 4 + F.col("n_col")).cast("long").alias("dst"), "w")
    got = search.distances(e, spark.createDataFrame([(0, 0)], "id int, node long")).collect()
    want = heap(costs, np.zeros((4, 4), np.float32), (0, 0))
    assert {divmod(r.node, 4): r.d for r in got} == want


def test_algorithm_names():
    assert search.algorithm(" Long-Range-A_Star ") == "long_range_astar"
    with pytest.raises(ConfigError):
        search.algorithm("greedy")


def test_steps_without_weight_make_no_circle(spark):
    cells = grid(spark, np.full((6, 6), 1e-6))
    paths, steps = found(spark, cells, PLAIN, [(0, 5, 5, 0)], [(0, 0, 0, 0)], 6, 3)
    assert paths.first().cost_units == 0
    walk = [(r.row, r.col) for r in steps.orderBy("step").collect()]
    assert walk[0] == (5, 5) and walk[-1] == (0, 0) and len(set(walk)) == len(walk)
    assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(walk, walk[1:]))


@pytest.fixture
def settled(monkeypatch):
    """Tiles that each attempt has written, superstep by superstep."""
    seen, whole = [], search._attempt

    def counted(tiles, *rest):
        states, best = whole(tiles, *rest)
        seen.append(tiles.sparkSession.read.parquet(states.path).count() if best.limit(1).count() else states.index.count())
        return states, best

    monkeypatch.setattr(search, "_attempt", counted)
    return seen


@pytest.mark.parametrize("seed", [1])
def test_led_searches_find_the_same_costs_in_fewer_tiles(spark, settled, seed):
    rng = np.random.default_rng(seed)
    n = 30
    costs = rng.integers(40, 60, (n, n)).astype(np.float32)
    costs[rng.random((n, n)) < 0.1] = 0
    costs[15, 15] = costs[15, 28] = costs[13, 27] = costs[4, 4] = costs[5, 15] = 45
    inv = rng.integers(1, 5, (n, n)).astype(np.float32)
    config = {"routing_options": {"o": {"cost_layers": [{"layer_name": "c"}, {"layer_name": "i", "is_invariant": True}]}}}
    cells = grid(spark, costs, i=inv)
    starts, ends = [(0, 15, 15, 0), (1, 4, 4, 0)], [(0, 15, 28, 0), (0, 13, 27, 0), (1, 5, 15, 0)]
    dist = {start: heap(costs, inv, start) for start in ((15, 15), (4, 4))}
    want = {0: min(dist[15, 15][15, 28], dist[15, 15][13, 27]), 1: dist[4, 4][5, 15]}
    paths = {name: found(spark, cells, config, starts, ends, n, 5, name) for name in ("dijkstra", "long_range_astar")}
    for solved, steps in paths.values():
        assert {r.route_id: r.cost_units for r in solved.collect()} == want
    assert settled[1] < 0.8 * settled[0]


def test_led_searches_walk_the_same_way_through_options_and_no_weight(spark):
    rng = np.random.default_rng(5)
    costs, other = rng.integers(1, 9, (12, 12)).astype(np.float32), rng.integers(1, 9, (12, 12)).astype(np.float32)
    config = {"routing_options": {"a": {"cost_layers": [{"layer_name": "c"}]}, "b": {"cost_layers": [{"layer_name": "d"}]}}, "transition_costs": {"default": 2}}
    cells = grid(spark, costs, d=other)
    walks = []
    for name in ("dijkstra", "astar"):
        solved, steps = found(spark, cells, config, [(0, 1, 1, 0)], [(0, 10, 9, 1), (0, 11, 11, 0)], 12, 4, name)
        walks.append((solved.first().cost_units, [tuple(r) for r in steps.orderBy("step").select("row", "col", "option").collect()]))
    assert walks[0] == walks[1]
    tiny = grid(spark, np.full((6, 6), 1e-6))
    assert found(spark, tiny, PLAIN, [(0, 5, 5, 0)], [(0, 0, 0, 0)], 6, 3, "astar")[0].first().cost_units == 0


BOTH = "bidirectional_long_range_dijkstra"


@pytest.mark.parametrize("seed", [2])
def test_both_ends_find_the_same_costs_in_fewer_tiles(spark, settled, seed):
    rng = np.random.default_rng(seed)
    n = 30
    costs = rng.integers(40, 60, (n, n)).astype(np.float32)
    costs[rng.random((n, n)) < 0.1] = 0
    ends = [(0, 15, 29, 0), (0, 14, 28, 0), (1, 4, 20, 0), (2, 9, 9, 0)]
    starts = [(0, 15, 5, 0), (1, 4, 4, 0), (2, 9, 9, 0)]
    for _, i, j, _ in starts + ends:
        costs[i, j] = 45
    inv = rng.integers(1, 50, (n, n)).astype(np.float32)
    config = {"routing_options": {"o": {"cost_layers": [{"layer_name": "c"}, {"layer_name": "i", "is_invariant": True}]}}}
    cells = grid(spark, costs, i=inv)
    dist = {rid: heap(costs, inv, (i, j)) for rid, i, j, _ in starts}
    want = {rid: min(dist[rid][i, j] for r, i, j, _ in ends if r == rid) for rid in dist}
    for name in ("dijkstra", BOTH):
        solved, steps = found(spark, cells, config, starts, ends, n, 5, name)
        got = solved.collect()
        assert {r.route_id: r.cost_units for r in got} == want
        for r in got:
            walk = [(x.row, x.col) for x in steps.where(f"route_id = {r.route_id}").orderBy("step").collect()]
            assert walk[0] == (r.start_row, r.start_col) and walk[-1] == (r.end_row, r.end_col)
            assert [dist[r.route_id][at] for at in walk] == sorted(dist[r.route_id][at] for at in walk) and dist[r.route_id][walk[-1]] == r.cost_units
            assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(walk, walk[1:]))
    assert settled[1] < 0.8 * settled[0]


def test_both_ends_meet_across_options_and_no_weight(spark):
    rng = np.random.default_rng(5)
    costs, other = rng.integers(1, 9, (12, 12)).astype(np.float32), rng.integers(1, 9, (12, 12)).astype(np.float32)
    uneven = {"default": 2, "pairwise": [{"between": ["a", "b"], "cost": 7}]}
    config = {"routing_options": {"a": {"cost_layers": [{"layer_name": "c"}, {"layer_name": "d", "is_invariant": True}]}, "b": {"cost_layers": [{"layer_name": "d"}, {"layer_name": "c", "is_invariant": True}]}}, "transition_costs": uneven}
    cells = grid(spark, costs, d=other)
    starts, ends = [(0, 1, 1, 0), (1, 11, 0, 1)], [(0, 10, 9, 1), (0, 11, 11, 0), (1, 0, 10, 0)]
    costs_of = [{r.route_id: r.cost_units for r in found(spark, cells, config, starts, ends, 12, 4, name)[0].collect()} for name in ("dijkstra", BOTH)]
    assert costs_of[0] == costs_of[1] and len(costs_of[0]) == 2
    solved, steps = found(spark, grid(spark, np.full((6, 6), 1e-6)), PLAIN, [(0, 5, 5, 0)], [(0, 0, 0, 0)], 6, 3, BOTH)
    walk = [(r.row, r.col) for r in steps.orderBy("step").collect()]
    assert solved.first().cost_units == 0 and walk[0] == (5, 5) and walk[-1] == (0, 0) and len(set(walk)) == len(walk)
    assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(walk, walk[1:]))


def test_both_ends_without_a_way_and_with_soft_barriers(spark, settled):
    wall = np.zeros((9, 9))
    wall[4, :] = 1
    barrier = {"layer_name": "w", "where": ">0"}
    hard, soft = ({"routing_options": {"o": {"cost_layers": [{"layer_name": "c"}], "barrier_layers": [b]}}} for b in (barrier, {**barrier, "barrier_importance": 1}))
    cells = grid(spark, np.ones((9, 9)), w=wall)
    assert found(spark, cells, hard, [(0, 0, 0, 0)], [(0, 8, 0, 0)], 9, 3, BOTH)[0].count() == 0
    paths = found(spark, cells, soft, [(0, 0, 0, 0), (1, 0, 0, 0)], [(0, 8, 0, 0), (1, 0, 8, 0)], 9, 3, BOTH)[0]
    assert {r.route_id: (r.objective, r.dropped) for r in paths.collect()} == {0: (8.0, ["w"]), 1: (8.0, [])}


def test_lower_bounds_never_exceed_costs(spark):
    rng = np.random.default_rng(9)
    costs = rng.integers(1, 40, (24, 18)).astype(np.float32)
    from pyspark.sql import functions as F

    from rasterway.plans.scenario import surface

    bounds = search.Bounds.of(surface(grid(spark, costs), Scenario.from_json(PLAIN)), 3, [[0]])
    dist = heap(costs, np.zeros_like(costs), (4, 4))
    rows = [(i, j, int(min(dist[a, b] for a in range(3 * i, 3 * i + 3) for b in range(3 * j, 3 * j + 3)))) for i in range(8) for j in range(6)]
    at = spark.createDataFrame(rows, "ti long, tj long, d long").select("*", *(F.lit(1).cast("bigint").alias(c) for c in ("i0", "i1", "j0", "j1")))
    got = at.select("d", bounds.to(F.col("ti"), F.col("tj")).alias("low")).collect()
    assert all(r.low <= r.d for r in got) and max(r.low for r in got) > 0


def test_searches_without_an_open_end_settle_nothing(spark, settled):
    costs = np.ones((8, 8))
    costs[7, 7] = 0
    paths, _ = found(spark, grid(spark, costs), PLAIN, [(0, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0)], [(0, 7, 7, 0), (2, 0, 1, 0)], 8, 2)
    assert [r.route_id for r in paths.collect()] == [2]
    assert settled[0] <= 4
    assert found(spark, grid(spark, costs), PLAIN, [(0, 0, 0, 0)], [(0, 7, 7, 0)], 8, 2)[0].count() == 0 and settled[1] == 0

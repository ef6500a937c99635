import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterway.functions import planar
from rasterway.operators import shapes as S
from rasterway.operators import zonal
from rasterway.grid import Grid

KIND = "array<struct<x:double,y:double>>"


def square(x, y, s, t=None):
    x, y, s, t = float(x), float(y), float(s), float(s if t is None else t)
    return [(x, y), (x + s, y), (x + s, y + t), (x, y + t), (x, y)]


def ring(points):
    return np.array(points, float)


def shape(row):
    return None if row is None else [None if p is None else (p.x, p.y) for p in row]


def winding(rings, points):
    s = planar.segments(rings)
    return planar.windings(points, s, np.ones((len(s), 1), np.int64))[:, 0]


def test_union_of_squares_equals_counted_cells():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n = rng.integers(1, 12)
        at, side = rng.integers(0, 10, (n, 2)), rng.integers(1, 5, n)
        cells = np.zeros((20, 20), bool)
        for (x, y), k in zip(at, side):
            cells[x : x + k, y : y + k] = True
        got = planar.united([[ring(square(x, y, k))] for (x, y), k in zip(at, side)])
        assert abs(sum(map(planar.area, got)) - cells.sum()) < 1e-9
        spots = np.argwhere(np.ones((20, 20), bool)) + 0.5
        assert (winding(got, spots) == cells.ravel()).all()


@pytest.mark.parametrize("seed", range(6))
def test_overlays_of_any_triangles_hold_just_the_right_points(seed):
    rng = np.random.default_rng(seed)
    triangles = []
    for _ in range(8):
        p = rng.random((3, 2)) * 10 + 1e5 * seed
        p = np.vstack([p, p[:1]])
        triangles.append(p if planar.area(p) > 0 else p[::-1])
    spots = rng.random((3000, 2)) * 10 + 1e5 * seed
    inside = np.array([winding([t], spots) for t in triangles]) > 0
    assert (winding(planar.united([[t] for t in triangles]), spots) == inside.any(0)).all()
    assert (winding(planar.repaired(triangles), spots) == inside.sum(0) % 2).all()
    for a, b in zip(triangles[:4], triangles[4:]):
        assert (winding(planar.common([a], [b]), spots) == (winding([a], spots) > 0) * (winding([b], spots) > 0)).all()


def test_known_shapes():
    got = planar.united([[ring(square(0, 0, 2))], [ring(square(2, 0, 2))]])
    assert [r.tolist() for r in got] == [[[0, 0], [4, 0], [4, 2], [0, 2], [0, 0]]]  # one border less, no point on a straight side
    touching = planar.united([[ring(square(0, 0, 1))], [ring(square(1, 1, 1))]])
    assert len(touching) == 2
    frame = planar.united([[ring(square(*p, 1))] for p in ((0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (1, 2), (2, 2))])
    assert [planar.area(r) for r in frame] == [9, -1]
    bow = planar.repaired([ring([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])])
    assert [planar.area(r) for r in bow] == [1, 1]
    doubled = planar.repaired([ring([(0, 0), (3, 0), (3, 3), (5, 3), (3, 3), (0, 3), (0, 0)])])  # a spike out and back
    assert [r.tolist() for r in doubled] == [[[0, 0], [3, 0], [3, 3], [0, 3], [0, 0]]]
    turned = planar.repaired([ring(square(0, 0, 4)), ring(square(1, 1, 1))])  # a hole that runs the wrong way
    assert [planar.area(r) for r in turned] == [16, -1]
    assert planar.repaired([ring([(0, 0), (1, 0), (2, 0), (0, 0)])]) == [] and planar.united([]) == []


def test_rings_that_turn_one_way_are_repaired_as_overlays_do():
    rng = np.random.default_rng(5)
    for n in (3, 4, 5, 9):
        turn = np.sort(rng.random(n)) * 2 * np.pi
        for p in (np.stack([np.cos(turn), np.sin(turn)], 1) * 5 + 7, np.stack([np.cos(2 * np.arange(5) * 2 * np.pi / 5), np.sin(2 * np.arange(5) * 2 * np.pi / 5)], 1)):  # the second is a star
            for q in (p, p[::-1]):
                q = np.vstack([q, q[:1]])
                want = planar.overlay([(0, [q])], 1, lambda w: w[:, 0] > 0, even_odd=True)
                got = planar.repaired([q])
                assert len(got) == len(want) and all(np.allclose(a, b) for a, b in zip(got, want))
    assert planar.convex(ring(square(0, 0, 2))) == 1 and planar.convex(ring([(0, 0), (1, 0), (2, 0), (0, 2), (0, 0)])) == 0


def test_unions_of_many_shapes_look_at_near_sides_only(monkeypatch):
    rng = np.random.default_rng(2)
    boxes = [ring(square(x, y, 1.3)) for x, y in rng.random((1500, 2)) * 200]
    sides = []
    monkeypatch.setattr(planar, "_bands", lambda *a, real=planar._bands: ((k, near) for k, near in real(*a) if sides.append(len(k) * len(near)) is None))
    got = planar.united([[b] for b in boxes])
    assert 0 < sum(sides) < 6000 * 6000 / 10  # every side was compared with every other
    spots = rng.random((2000, 2)) * 200
    assert (winding(got, spots) == (sum(winding([b], spots) for b in boxes) > 0)).all()


def test_lines_are_cut_to_regions():
    region = [ring(square(0, 0, 4)), ring(square(1, 1, 2)[::-1])]
    got = planar.lines_inside([ring([(-1, 2), (6, 2), (6, 0.5), (3.5, 0.5)])], region)
    assert [p.tolist() for p in got] == [[[0, 2], [1, 2]], [[3, 2], [4, 2]], [[4, 0.5], [3.5, 0.5]]]
    assert [p.tolist() for p in planar.lines_inside([ring([(-1, 0), (5, 0)])], region)] == [[[0, 0], [4, 0]]]


def test_one_union_a_key_in_batches_of_any_size(spark, monkeypatch):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(4):
        cells = np.zeros((40, 40), bool)
        for i in range([1, 7, 90, 300][k]):
            x, y, s = rng.randrange(30), rng.randrange(30), rng.randrange(1, 6)
            rows.append((k, i, f"a{i}", square(x, y, s)))
            cells[x : x + s, y : y + s] = True
        want[k] = int(cells.sum())
    rows += [(9, 0, "none", None), (None, 1, "nil", square(0, 0, 3))]
    frame = spark.createDataFrame(rows, f"k int, i int, name string, ring {KIND}").repartition(5)
    for size in (2, 64):
        monkeypatch.setattr(S, "BATCH", size)
        got = {r.k: r for r in S.united(frame, "k", order=["i"]).collect()}
        assert set(got) == {0, 1, 2, 3, 9, None} and got[9].ring is None and got[9].name == "none" and got[None].name == "nil"
        for k, n in want.items():
            parts = S.parts_of(S.pa.scalar([None if p is None else {"x": p[0], "y": p[1]} for p in shape(got[k].ring)], S.pa.list_(S.pa.struct([("x", S.pa.float64()), ("y", S.pa.float64())]))))
            assert abs(sum(map(planar.area, parts)) - n) < 1e-9 and got[k].name == "a0"


def test_repaired_shapes_are_rasterized(spark):
    bow = [(0.0, 0.0), (8.0, 8.0), (8.0, 0.0), (0.0, 8.0), (0.0, 0.0)]
    rows = [(1, bow, 1.0, 1), (2, None, 2.0, 2), (3, [(0.0, 0.0), (4.0, 0.0), (0.0, 0.0)], 3.0, 3)]
    frame = spark.createDataFrame(rows, f"id int, ring {KIND}, value double, `order` int")
    fixed = S.repaired(frame)
    assert [r.id for r in fixed.collect()] == [1] and fixed.columns == frame.columns
    got = {(r.row, r.col) for r in zonal.rasterized(frame, Grid(8, 8, f=8.0), repair=True).where("value = 1").collect()}
    beside = lambda r, c: abs(c + 0.5 - 4) - abs(7.5 - r - 4)  # noqa: E731  on the diagonals either will do
    assert got >= {(r, c) for r in range(8) for c in range(8) if beside(r, c) > 0} and not {(r, c) for r, c in got if beside(r, c) < 0}


def brute_distance(x, y, parts, areal):
    best = math.inf
    for p in parts:
        for a, b in zip(p, p[1:] if len(p) > 1 else p):
            d = ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) or 1.0
            t = min(1.0, max(0.0, ((x - a[0]) * (b[0] - a[0]) + (y - a[1]) * (b[1] - a[1])) / d))
            best = min(best, math.hypot(x - a[0] - t * (b[0] - a[0]), y - a[1] - t * (b[1] - a[1])))
    if areal and winding([ring(p) for p in parts], np.array([[x, y]]))[0]:
        return 0.0
    return best


def test_shapes_within_a_growing_radius_equal_brute_force(spark):
    rng = random.Random(8)
    features = []
    for k in range(40):
        x, y = rng.uniform(0, 1000), rng.uniform(0, 1000)
        if k % 4 == 0:
            features.append((k, False, [[(x, y)]]))
        elif k % 4 == 1:
            features.append((k, True, [square(x, y, rng.uniform(5, 90))]))
        else:
            features.append((k, False, [[(x + rng.uniform(-80, 80), y + rng.uniform(-80, 80)) for _ in range(4)] for _ in range(2)]))
    flat = lambda parts: [q for i, p in enumerate(parts) for q in ([None] if i else []) + p]
    points = [(i, rng.uniform(-200, 1200), rng.uniform(-200, 1200)) for i in range(60)] + [(99, 5000.0, -4000.0), (100, None, 3.0)]
    frame = spark.createDataFrame([(k, a, flat(p)) for k, a, p in features], f"feature int, areal boolean, points {KIND}")
    got = {(r.id, r.feature): r for r in S.shapes_within_radius(spark.createDataFrame(points, "id int, x double, y double"), frame, 60.0).collect()}
    want = {}
    for i, x, y in points[:-1]:
        far = {k: brute_distance(x, y, p, a) for k, a, p in features}
        n = max(0, math.ceil((min(far.values()) / 60 - 1) / 0.05 - 1e-9))
        want |= {(i, k): (d, 60 * (1 + 0.05 * n)) for k, d in far.items() if d <= 60 * (1 + 0.05 * n) * (1 + 1e-9)}
    assert set(got) == set(want)
    for key, (d, r) in want.items():
        row = got[key]
        assert row.distance == pytest.approx(d, abs=1e-6) and row.radius == pytest.approx(r)
        x, y = next((x, y) for i, x, y in points if i == key[0])
        for p in row.points or []:
            assert p is None or math.hypot(p.x - x, p.y - y) <= r * (1 + 1e-9)
        if not features[key[1]][1]:
            # What is left of a line is as long as its finely sampled part in the circle.
            length = sum(math.hypot(b.x - a.x, b.y - a.y) for a, b in zip(row.points, row.points[1:]) if a and b)
            sampled = 0.0
            for p in features[key[1]][2]:
                for a, b in zip(p, p[1:]):
                    t = (np.arange(4000) + 0.5) / 4000
                    sampled += math.dist(a, b) * np.mean(np.hypot(a[0] + t * (b[0] - a[0]) - x, a[1] + t * (b[1] - a[1]) - y) <= r)
            assert length == pytest.approx(sampled, abs=0.2)
    only = S.shapes_within_radius(spark.createDataFrame(points, "id int, x double, y double"), frame, 60.0, expand=False).collect()
    assert {(r.id, r.feature) for r in only} == {k for k, (_, r) in want.items() if r == 60.0}
    assert S.shapes_within_radius(spark.createDataFrame(points, "id int, x double, y double"), frame.limit(0), 60.0).count() == 0


def test_pairs_are_cut_to_regions(spark):
    region = square(0.0, 0.0, 10.0)
    rows = [(1, True, square(5.0, 5.0, 10.0), region), (2, False, [(-5.0, 5.0), (15.0, 5.0)], region), (3, False, [(1.0, 1.0), None, (50.0, 1.0)], region), (4, False, [(20.0, 20.0), (30.0, 30.0)], region), (5, True, None, region)]
    got = {r.id: shape(r.points) for r in S.clipped(spark.createDataFrame(rows, f"id int, areal boolean, points {KIND}, region {KIND}"), "points", "region", "areal").collect()}
    assert got == {1: square(5.0, 5.0, 5.0), 2: [(0.0, 5.0), (10.0, 5.0)], 3: [(1.0, 1.0)]}


def test_points_and_shapes_of_one_place_meet_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    real = S._mapped
    monkeypatch.setattr(S, "_mapped", lambda t, c, f: real(t, c, lambda b, k: (calls.add(1), f(b, k))[1]))
    line, box = [(0.0, 0.0), (9.0, 0.0)], square(0.0, 5.0, 2.0)
    features = spark.createDataFrame([(k, k % 2 == 0, box if k % 2 == 0 else line) for k in range(20)], f"feature int, areal boolean, points {KIND}")
    points = spark.createDataFrame([(i, 1.0, 1.0) for i in range(50)] + [(99, 500.0, 0.0)], "id int, x double, y double")
    got = S.shapes_within_radius(points, features, 10.0, expand=False).collect()
    assert calls.value == 2  # one line and one box at one place, not 1000 pairs
    assert sorted((r.id, r.feature) for r in got) == [(i, k) for i in range(50) for k in range(20)]
    assert {(r.feature % 2, r.distance, len(r.points)) for r in got} == {(0, 4.0, 5), (1, 1.0, 2)}


def test_crowded_places_are_dealt_over_tasks(spark):
    pairs = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.7), (2, 8, 0.9)], "_place long, _shape long, distance double")
    points = spark.createDataFrame([(1, i) for i in range(400)] + [(2, 400)], "_place long, id long")
    owners = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "_shape long, feature int")
    made = S.nearby.expanded(pairs, points, owners, rows=50)
    want = sorted([(i, f, d) for i in range(400) for f, d in ((1, 0.5), (2, 0.5), (3, 0.7))] + [(400, 3, 0.9)])
    assert sorted((r.id, r.feature, r.distance) for r in made.collect()) == want
    assert max(r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()) < 400  # of 1201


def test_a_circle_that_just_touches_a_line_cuts_nothing_out():
    for x, size in ((719.0, 47.0), (1199.0, 77.0), (2303.0, 61.0), (33.0, 13.0)):
        for at in np.arange(0.0, size, 1.0):
            got = S._to_circle([ring([(x, 100.0), (x + size, 100.0)])], x + at, 160.0, 60.0)
            assert sum(float(np.hypot(*(p[-1] - p[0]))) for p in got) == 0.0

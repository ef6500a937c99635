import itertools

import numpy as np
from pyspark.sql import functions as F

from rasterway.functions import planar
from rasterway.grid import Grid
from rasterway.operators import simplify as S
from rasterway.operators import zonal

KIND = "id long, note string, ring array<struct<x:double,y:double>>"


def frame(spark, rows):
    return spark.createDataFrame([(k, note, None if p is None else [None if q is None else (float(q[0]), float(q[1])) for q in p]) for k, note, p in rows], KIND)


def found(df):
    return {r.id: [None if p is None else (p.x, p.y) for p in r.ring] for r in df.collect()}


def edges(points):
    return [frozenset((a, b)) for a, b in zip(points[:-1], points[1:]) if a is not None and b is not None]


def test_bends_equal_a_plain_recursion():
    def plain(p, a, b, t):
        if b < a + 2:
            return set()
        d = p[b] - p[a]
        offs = []
        for k in range(a + 1, b):
            s = 0.0 if not d.any() else min(1.0, max(0.0, float((p[k] - p[a]) @ d / (d @ d))))
            offs.append(float(np.hypot(*(p[k] - p[a] - s * d))))
        k = a + 1 + int(np.argmax(offs))
        return {k} | plain(p, a, k, t) | plain(p, k, b, t) if max(offs) > t else set()

    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 40, 40, 40, 200):
        p = np.cumsum(rng.normal(size=(n, 2)), 0)
        for t in (0.0, 0.5, 2.0, 100.0):
            assert planar.bends(p, t).tolist() == sorted({0, n - 1} | plain(p, 0, n - 1, t))
    circle = np.array([(np.cos(a), np.sin(a)) for a in np.linspace(0, 2 * np.pi, 60)])
    circle[-1] = circle[0]
    assert len(planar.bends(circle, 50.0)) == 4 and planar.bends(circle, 0.0).size == 60


def test_neighbours_keep_one_border(spark):
    """A grid of regions with rough borders: the area stays a tiling, each inner side has two owners, no two sides cross."""
    rng = np.random.default_rng(2)
    side, fine = 4, 12

    def border(a, b):  # a rough line between two corners, the same for both neighbours
        key = (min(a, b), max(a, b))
        if key not in lines:
            t = np.linspace(0, 1, fine + 1)[:, None]
            p = np.array(key[0]) + t * (np.array(key[1]) - np.array(key[0]))
            p[1:-1] += rng.normal(scale=0.25, size=(fine - 1, 2))
            lines[key] = [tuple(map(float, q)) for q in p]
        return lines[key] if (a, b) == key else lines[key][::-1]

    lines, rows = {}, []
    for i, j in itertools.product(range(side), range(side)):
        c = [(i * 10.0, j * 10.0), (i * 10.0 + 10, j * 10.0), (i * 10.0 + 10, j * 10.0 + 10), (i * 10.0, j * 10.0 + 10)]
        ring = [c[0]] + [p for a, b in zip(c, c[1:] + c[:1]) for p in border(a, b)[1:]]
        rows.append((i * side + j, "n", ring[5:-1] + ring[: 6]))  # begins anywhere
    got = found(S.simplified(frame(spark, rows), 0.6))
    assert len(got) == side * side and sum(map(len, got.values())) < sum(len(r[2]) for r in rows) / 2
    counted = {}
    for p in got.values():
        assert p[0] == p[-1]
        for e in edges(p):
            counted[e] = counted.get(e, 0) + 1
    assert set(counted.values()) <= {1, 2}
    whole = planar.united([[np.array(p)] for p in got.values()])
    assert len(whole) == 1 and abs(sum(planar.area(np.array(p)) for p in got.values()) - planar.area(whole[0])) < 1e-6
    sides = np.array([[*a, *b] for a, b in map(sorted, counted)])
    assert len(planar.noded(sides)[0]) == len(sides)  # nothing crosses
    # No point of the input lies farther from its new border than the tolerance.
    for k, _, ring in rows:
        new = np.array(got[k])
        for q in np.array(ring):
            a, d = new[:-1], new[1:] - new[:-1]
            t = np.clip(((q - a) * d).sum(1) / (d * d).sum(1), 0, 1)[:, None]
            assert np.hypot(*(a + t * d - q).T).min() <= 0.6 + 1e-9


def test_holes_are_neither_crossed_nor_passed_nor_lost(spark):
    outer = [(0, 0), (10, 0), (10, 10), (5, 10.9), (0, 10), (0, 0)]
    hole = [(4.8, 10.3), (5.0, 10.7), (5.2, 10.3), (4.8, 10.3)]  # in the bump that would go
    low = [(2, 2), (2, 3), (3, 3), (3, 2), (2, 2)]
    got = found(S.simplified(frame(spark, [(0, "a", [*outer, None, *low, None, *hole]), (1, "b", outer)]), 1.0))
    parts = [list(g) for on, g in itertools.groupby(got[0], lambda p: p is None) if not on]
    assert len(parts) == 3 and (5.0, 10.9) in parts[0] and set(parts[0]) == set(map(tuple, outer))
    assert len(set(parts[1])) == 3 and set(parts[1]) < set(map(tuple, low)) and set(parts[2]) == set(hole)
    alone = found(S.simplified(frame(spark, [(1, "b", outer)]), 1.0))
    assert (5.0, 10.9) not in alone[1]
    # Two arcs between the same nodes do not fall together.
    lens = [(0, 0), (5, -0.4), (10, 0), (5, 0.4), (0, 0)]
    wings = [[(0, 0), (-5, 5), (-5, -5), (0, 0)], [(10, 0), (15, -5), (15, 5), (10, 0)]]
    got = found(S.simplified(frame(spark, [(0, "l", lens), (1, "w", wings[0]), (2, "w", wings[1])]), 1.0))
    assert set(got[0]) == set(map(tuple, lens))


def test_lines_points_nulls_and_repeated_rows(spark):
    line = [(0, 0), (1, 0.1), (2, 0), (3, 0.1), (4, 0)]
    rows = [(0, None, line), (0, None, line), (1, "p", [(7, 7)]), (2, "e", []), (3, None, None), (4, "t", [(2, 0), (2, 5)]), (5, "d", [(9, 9), (9, 9), (10, 9)])]
    made = S.simplified(frame(spark, rows), 0.5)
    out = sorted((r.id, r.note or "", [(p.x, p.y) for p in r.ring]) for r in made.collect())
    cut = [(0.0, 0.0), (2.0, 0.0), (4.0, 0.0)]  # another line ends at (2, 0)
    assert out == [(0, "", cut), (0, "", cut), (1, "p", [(7.0, 7.0)]), (4, "t", [(2.0, 0.0), (2.0, 5.0)]), (5, "d", [(9.0, 9.0), (10.0, 9.0)])]
    assert made.columns == ["id", "note", "ring"] and S.simplified(made.limit(0), 1.0).collect() == []


def test_single_lines_and_half_a_cell(spark):
    got = found(S.thinned(frame(spark, [(0, "r", [(0, 0), (1, 0.2), (2, 0), (2, 3), None, (5, 5)]), (1, "q", [(0, 0), (1, 9), (2, 0)])]), "ring", 0.5))
    assert got == {0: [(0.0, 0.0), (2.0, 0.0), (2.0, 3.0), None, (5.0, 5.0)], 1: [(0.0, 0.0), (1.0, 9.0), (2.0, 0.0)]}
    assert S.half_cell(Grid(3, 3, 90.0, 0.0, 0.0, 0.0, -30.0, 0.0)) == 45.0
    none = spark.createDataFrame([(1, "x", None)], KIND)
    assert S.thinned(none, "ring", 1.0).where(F.col("ring").isNull()).count() == 1


def test_simplified_shapes_are_rasterized(spark):
    wavy = [(0, 0), (2, 0.3), (4, 0), (4, 4), (0, 4), (0, 0)]
    shapes = spark.createDataFrame([(1, [(float(x), float(y)) for x, y in wavy], 1.0, 0)], "id long, ring array<struct<x:double,y:double>>, value double, order int")
    cells = lambda **k: {(r.row, r.col) for r in zonal.rasterized(shapes, Grid(6, 6, f=6.0), **k).where("value = 1").collect()}
    assert cells(simplify=True) == cells() == {(r, c) for r in range(2, 6) for c in range(4)}


def test_small_bends_at_the_far_end_of_an_unshared_border_go(spark):
    for b in (0.4, -0.4):  # farthest from a chord of the whole border, yet 0.4 off the side between its own neighbours
        outer = np.array([(0, 0), (10, 0), (10 + b, 5), (10, 10), (0, 10)], float)
        assert planar.corners(outer, 0.5).tolist() == [0, 1, 3, 4] and planar.corners(outer, 0.3).tolist() == [0, 1, 2, 3, 4]
        alone = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (-abs(b), 5.0), (0.0, 0.0)]  # begins nowhere: no neighbour
        frame = spark.createDataFrame([(1, alone)], "id int, ring array<struct<x:double,y:double>>")
        got = S.simplified(frame, 0.5).first().ring
        assert len(got) == 5 and {(p.x, p.y) for p in got} == {(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)}

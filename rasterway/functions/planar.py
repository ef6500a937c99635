"""Overlays of plane shapes in numpy: what is left of segments once they are cut where they meet.

Segments are cut at every crossing, touch and overlap.  Equal pieces become one with a
count of how often each operand runs along it either way; how often an operand winds
around the places left and right of a piece then tells whether a rule takes just one
of the two, and such pieces, with the inside at their left, make up the rings of the result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

#: Distance at which points count as one, as a part of the largest coordinate.
NEAR = 1e-11
#: Pairs that are compared at once.
PAIRS = 1 << 21


def segments(parts: list[np.ndarray]) -> np.ndarray:
    """(n, 4): the sides of all parts; sides without length are left out."""
    sides = [np.hstack([p[:-1], p[1:]]) for p in parts if len(p) > 1]
    s = np.concatenate(sides) if sides else np.zeros((0, 4))
    return s[(s[:, :2] != s[:, 2:]).any(1)]


def closed(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Rings that end where they begin."""
    return [p if (p[0] == p[-1]).all() else np.vstack([p, p[:1]]) for p in parts if len(p) > 2]


def _meeting(s: np.ndarray):
    """Pairs of segments whose boxes meet, in blocks."""
    low, high = np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])
    order = np.argsort(low[:, 0], kind="stable")
    last = np.searchsorted(low[order, 0], high[order, 0], side="right")
    number = np.maximum(last - np.arange(len(s)) - 1, 0)
    ends = np.cumsum(number)
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        k = np.arange(at, to)
        i = np.repeat(k, number[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(number[at:to]) - number[at:to], number[at:to])
        i, j = order[i], order[j]
        on = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        yield i[on], j[on]
        at = to


def noded(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces (m, 4), the segment that each is of): ``s`` cut wherever segments meet."""
    near = NEAR * max(1.0, float(np.abs(s).max(initial=0)))
    cuts = [(np.arange(len(s)), s[:, :2]), (np.arange(len(s)), s[:, 2:])]
    for i, j in _meeting(s):
        a, b = s[i], s[j]
        da, db = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2]
        for own, d, k, other in ((a, da, i, b), (b, db, j, a)):
            length = np.hypot(d[:, 0], d[:, 1])
            for p in (other[:, :2], other[:, 2:]):
                v = p - own[:, :2]
                along = (v * d).sum(1) / length
                off = np.abs(d[:, 0] * v[:, 1] - d[:, 1] * v[:, 0]) / length
                on = (off <= near) & (along > near) & (along < length - near)
                cuts.append((k[on], p[on]))
        cross = da[:, 0] * db[:, 1] - da[:, 1] * db[:, 0]
        v = b[:, :2] - a[:, :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (v[:, 0] * db[:, 1] - v[:, 1] * db[:, 0]) / cross
            u = (v[:, 0] * da[:, 1] - v[:, 1] * da[:, 0]) / cross
            la, lb = near / np.hypot(da[:, 0], da[:, 1]), near / np.hypot(db[:, 0], db[:, 1])
            on = (t > la) & (t < 1 - la) & (u > lb) & (u < 1 - lb)
        p = a[on, :2] + t[on, None] * da[on]
        cuts += [(i[on], p), (j[on], p)]
    of, points = np.concatenate([c[0] for c in cuts]), np.concatenate([c[1] for c in cuts])
    # Points that are all but one become one, the first of them, so that ends of segments stay.
    _, first, same = np.unique(np.round(points / (4 * near)), axis=0, return_index=True, return_inverse=True)
    points = points[first][same.ravel()]
    d = s[of, 2:] - s[of, :2]
    along = ((points - s[of, :2]) * d).sum(1)
    order = np.lexsort([along, of])
    of, points = of[order], points[order]
    pieces = np.hstack([points[:-1], points[1:]])
    keep = (of[1:] == of[:-1]) & (pieces[:, :2] != pieces[:, 2:]).any(1)
    return pieces[keep], of[1:][keep]


def _merged(pieces: np.ndarray, operand: np.ndarray, operands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pieces, runs forward less backward by operand, all runs by operand)."""
    back = (pieces[:, 0] > pieces[:, 2]) | (pieces[:, 0] == pieces[:, 2]) & (pieces[:, 1] > pieces[:, 3])
    one = np.where(back[:, None], pieces[:, [2, 3, 0, 1]], pieces)
    distinct, at = np.unique(one, axis=0, return_inverse=True)
    net, runs = np.zeros((len(distinct), operands), np.int64), np.zeros((len(distinct), operands), np.int64)
    np.add.at(net, (at.ravel(), operand), np.where(back, -1, 1))
    np.add.at(runs, (at.ravel(), operand), 1)
    return distinct, net, runs


def windings(points: np.ndarray, pieces: np.ndarray, net: np.ndarray, skip: np.ndarray | None = None, upright: np.ndarray | None = None) -> np.ndarray:
    """How often each column of ``net`` winds around ``points``; piece skip[k] is left out for point k.

    Rays go to the right, or up from points that are not ``upright``.
    """
    out = np.zeros((len(points), net.shape[1]), np.int64)
    upright = np.ones(len(points), bool) if upright is None else upright
    for flip in (False, True):
        some = np.flatnonzero(upright != flip)
        # Seen across the diagonal, up is right and windings change their sign.
        p, e = (points[:, ::-1], pieces[:, [1, 0, 3, 2]]) if flip else (points, pieces)
        for k, near in _bands(p[:, 1], some, e):
            own, own_net = e[near], net[near]
            step = max(1, PAIRS // max(len(near), 1))
            for at in range(0, len(k), step):
                one = k[at : at + step]
                x, y = p[one, 0][:, None], p[one, 1][:, None]
                up, down = (own[:, 1] <= y) & (own[:, 3] > y), (own[:, 3] <= y) & (own[:, 1] > y)
                with np.errstate(divide="ignore", invalid="ignore"):
                    right = own[:, 0] + (y - own[:, 1]) / (own[:, 3] - own[:, 1]) * (own[:, 2] - own[:, 0]) > x
                sign = np.where(right, up.astype(np.int64) - down, 0)
                if skip is not None:
                    sign[near == skip[one][:, None]] = 0
                out[one] = (sign @ own_net) * (-1 if flip else 1)
    return out


def _bands(y: np.ndarray, some: np.ndarray, pieces: np.ndarray):
    """(points of ``some``, the pieces that rays from them may meet): runs of near heights, each with the pieces that reach it."""
    size = max(64, int(len(some) ** 0.5))
    order = some[np.argsort(y[some], kind="stable")]
    low, high = np.minimum(pieces[:, 1], pieces[:, 3]), np.maximum(pieces[:, 1], pieces[:, 3])
    for at in range(0, len(order), size):
        k = order[at : at + size]
        yield k, np.flatnonzero((low <= y[k[-1]]) & (high > y[k[0]]))


def overlay(shapes: list[tuple[int, list[np.ndarray]]], operands: int, rule: Callable[[np.ndarray], np.ndarray], even_odd: bool = False) -> list[np.ndarray]:
    """Rings of the region that ``rule`` takes, from windings (place, operand), of shapes given as (operand, rings)."""
    sides = [(k, segments(closed(parts))) for k, parts in shapes]
    s = np.concatenate([x for _, x in sides]) if sides else np.zeros((0, 4))
    if not len(s):
        return []
    operand = np.repeat([k for k, _ in sides], [len(x) for _, x in sides])
    pieces, of = noded(s)
    pieces, net, runs = _merged(pieces, operand[of], operands)
    if even_odd:
        net = runs % 2
    d = pieces[:, 2:] - pieces[:, :2]
    upright = np.abs(d[:, 1]) >= np.abs(d[:, 0])
    around = windings((pieces[:, :2] + pieces[:, 2:]) / 2, pieces, net, np.arange(len(pieces)), upright)
    # A ray to the right starts at the right side of a piece that goes up, one upwards at the left side of one that goes right.
    up = upright & (d[:, 1] > 0)
    starts_left = np.where(upright, ~up, d[:, 0] > 0)
    left = np.where(starts_left[:, None], around, around + net)
    right = np.where(starts_left[:, None], around - net, around)
    if even_odd:
        left, right = left % 2, right % 2
    inside_left, inside_right = rule(left), rule(right)
    kept = np.concatenate([pieces[inside_left & ~inside_right], pieces[inside_right & ~inside_left][:, [2, 3, 0, 1]]])
    return rings(kept)


def rings(pieces: np.ndarray) -> list[np.ndarray]:
    """Closed simple rings of directed pieces with the inside at their left, the largest first; points on a straight side go."""
    if not len(pieces):
        return []
    _, ids = np.unique(np.concatenate([pieces[:, :2], pieces[:, 2:]]), axis=0, return_inverse=True)
    start, end = ids.ravel()[: len(pieces)].tolist(), ids.ravel()[len(pieces) :].tolist()
    angle = np.arctan2(pieces[:, 3] - pieces[:, 1], pieces[:, 2] - pieces[:, 0])
    leaving: dict[int, list[int]] = {}
    for k, v in enumerate(start):
        leaving.setdefault(v, []).append(k)
    out, used = [], np.zeros(len(pieces), bool)
    for first in range(len(pieces)):
        if used[first]:
            continue
        path, at_vertex, k = [], {start[first]: 0}, first
        while k is not None and not used[k]:
            used[k] = True
            path.append(k)
            v = end[k]
            if v in at_vertex:  # back at a point: what lies between is a ring
                cut = at_vertex[v]
                ring = path[cut:]
                out.append(np.vstack([pieces[ring][:, :2], pieces[ring[:1]][:, :2]]))
                for gone in ring[1:]:
                    at_vertex.pop(start[gone], None)
                path = path[:cut]
                at_vertex[v] = cut
                if not path and cut == 0:
                    break
            else:
                at_vertex[v] = len(path)
            # The sharpest turn to the left keeps regions that touch in a point apart.
            free = [n for n in leaving.get(v, ()) if not used[n]]
            k = max(free, key=lambda n: (angle[n] - angle[k] + np.pi) % (2 * np.pi) if abs((angle[n] - angle[k] + np.pi) % (2 * np.pi)) > 1e-12 else 0.0) if free else None
    return sorted((r for r in map(straightened, out) if len(r) > 3), key=lambda r: (-abs(area(r)), r.tolist()))


def straightened(ring: np.ndarray) -> np.ndarray:
    """A ring without points between its neighbours, from its smallest point."""
    p = ring[:-1]
    near = NEAR * max(1.0, float(np.abs(p).max()))
    while len(p) > 2:
        before, after = np.roll(p, 1, 0), np.roll(p, -1, 0)
        d = after - before
        length = np.hypot(d[:, 0], d[:, 1])
        off = np.abs(d[:, 0] * (p - before)[:, 1] - d[:, 1] * (p - before)[:, 0])
        flat = off <= 4 * near * np.maximum(length, near)
        flat &= ~np.roll(flat, 1)
        if not flat.any():
            break
        p = p[~flat]
    if len(p) < 3:
        return np.zeros((0, 2))
    k = np.lexsort([p[:, 1], p[:, 0]])[0]
    p = np.roll(p, -k, 0)
    return np.vstack([p, p[:1]])


def area(ring: np.ndarray) -> float:
    """Positive against the clock."""
    p = ring - ring[0]
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def united(shapes: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The union of valid shapes."""
    return overlay([(0, parts) for parts in shapes], 1, lambda w: w[:, 0] > 0)


def repaired(parts: list[np.ndarray]) -> list[np.ndarray]:
    """What rings enclose an odd number of times."""
    if len(parts) == 1 and len(parts[0]) > 2 and (side := convex(ring := closed(parts)[0])):
        return [r for r in (straightened(ring[::side]),) if len(r) > 3]
    return overlay([(0, parts)], 1, lambda w: w[:, 0] > 0, even_odd=True)


def convex(ring: np.ndarray) -> int:
    """1 for a closed ring that clearly turns left at every corner and goes round once, -1 for one that turns right, else 0."""
    d = ring[1:] - ring[:-1]
    after = np.roll(d, -1, 0)
    cross, dot = d[:, 0] * after[:, 1] - d[:, 1] * after[:, 0], (d * after).sum(1)
    length = np.hypot(d[:, 0], d[:, 1])
    if not length.min() > 1e6 * NEAR * max(1.0, float(np.abs(ring).max())):
        return 0
    side = 1 if cross[0] > 0 else -1
    clear = side * cross > 1e-6 * length * np.roll(length, -1)
    return side if clear.all() and abs(np.arctan2(cross, dot).sum() - side * 2 * np.pi) < 1e-6 else 0


def common(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """What lies in both of two valid shapes."""
    return overlay([(0, a), (1, b)], 2, lambda w: (w > 0).all(1))


def lines_inside(lines: list[np.ndarray], region: list[np.ndarray]) -> list[np.ndarray]:
    """The parts of lines that lie in a valid region or on its border."""
    own, border = segments(lines), segments(closed(region))
    if not len(own) or not len(border):
        return []
    pieces, of = noded(np.concatenate([own, border]))
    rim, net, _ = _merged(pieces[of >= len(own)], np.zeros((of >= len(own)).sum(), np.int64), 1)
    pieces, of = pieces[of < len(own)], of[of < len(own)]
    middle = (pieces[:, :2] + pieces[:, 2:]) / 2
    both = {tuple(r) for r in np.concatenate([rim, rim[:, [2, 3, 0, 1]]]).tolist()}
    on = windings(middle, rim, net)[:, 0] > 0
    on |= np.array([tuple(p) in both for p in pieces.tolist()], bool)
    out: list[list[np.ndarray]] = []
    for p in pieces[on]:
        if out and (out[-1][-1] == p[:2]).all():
            out[-1].append(p[2:])
        else:
            out.append([p[:2], p[2:]])
    return [np.array(x) for x in out]


def farthest(p: np.ndarray) -> tuple[int, float]:
    """(place, distance) of the point that lies farthest from the straight side between the ends; the first of equals."""
    d, v = p[-1] - p[0], p - p[0]
    square = float(d @ d)
    along = np.clip(v @ d / square, 0, 1)[:, None] * d if square else 0.0
    off = np.hypot(*(v - along).T)
    k = 1 + int(np.argmax(off[1:-1]))
    return k, float(off[k])


def bends(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the points that stay where points no farther than the tolerance from sides go; three corners of a ring do."""
    kept, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    if len(p) > 3 and (p[0] == p[-1]).all():
        k, _ = farthest(p)
        halves = [(off, a + at) for a, b in ((0, k), (k, len(p) - 1)) if b > a + 1 for at, off in (farthest(p[a : b + 1]),)]
        kept |= {k, max(halves, key=lambda h: (h[0], -h[1]))[1]} if halves else {k}
        cuts = sorted(kept)
        todo = list(zip(cuts[:-1], cuts[1:]))
    while todo:
        a, b = todo.pop()
        if b < a + 2:
            continue
        k, off = farthest(p[a : b + 1])
        if off > tolerance:
            kept.add(a + k)
            todo += [(a, a + k), (a + k, b)]
    return np.array(sorted(kept))


def corners(p: np.ndarray, tolerance: float) -> np.ndarray:
    """``bends`` without those that a side between their neighbours passes within the tolerance, with all points between, the nearest first.

    A point that lies farthest from a first, long side may be off its own neighbours' by less.
    """
    kept = bends(p, tolerance).tolist()
    left = len(kept) - (4 if len(p) > 3 and (p[0] == p[-1]).all() else 2)
    before, after = dict(zip(kept[1:], kept)), dict(zip(kept, kept[1:]))
    off = lambda k: farthest(p[before[k] : after[k] + 1])[1]
    heap = [(d, k) for k in kept[1:-1] if (d := off(k)) <= tolerance]
    heapq.heapify(heap)
    known = {k: d for d, k in heap}
    while heap and left > 0:
        d, k = heapq.heappop(heap)
        if known.get(k) != d:
            continue
        a, b = before.pop(k), after.pop(k)
        del known[k]
        before[b], after[a] = a, b
        left -= 1
        for n in (a, b):
            if n in before and n in after:
                known[n] = off(n)
                if known[n] <= tolerance:
                    heapq.heappush(heap, (known[n], n))
    return np.array([kept[0], *sorted(before)])

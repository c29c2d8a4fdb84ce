"""Searched routes: costs counted again from their points, no cheaper way with up to three bends, never through a box."""

import itertools
import random

import pytest
from strata.operators import search as S
from strata.streaming.routes import _segments, cost

COSTS = S.Costs()


def some_boxes(rng, n):
    found = []
    while len(found) < n:
        x, y, w, h = rng.randrange(0, 160), rng.randrange(0, 120), rng.randrange(2, 20) * 2, rng.randrange(2, 15) * 2
        if not any(x < b[0] + b[2] + 20 and b[0] < x + w + 20 and y < b[1] + b[3] + 20 and b[1] < y + h + 20 for b in found):
            found.append((float(x), float(y), float(w), float(h)))
    return found


def total(points, drawn):
    reserved = [s for p in drawn for s in _segments(p)]
    _, shared, crossed, bends, length = cost(points, [], reserved)
    return length + COSTS.bend * bends + COSTS.crossing * crossed + COSTS.shared * shared


def clear(points, boxes, s, t):
    for k, (x, y, w, h) in enumerate(boxes):
        c = 0.0 if k in (s, t) else COSTS.clearance
        if any(x1 < x + w + c and x - c < x2 and y1 < y + h + c and y - c < y2 for x1, y1, x2, y2 in _segments(points)):
            return False
    return True


def few_bends(grid, starts, goals):
    """All ways along the grid's lines with three bends at most."""
    for (sx, sy), (tx, ty) in itertools.product(starts, goals):
        if sx == tx or sy == ty:
            yield [(sx, sy), (tx, ty)]
        yield [(sx, sy), (sx, ty), (tx, ty)]
        yield [(sx, sy), (tx, sy), (tx, ty)]
        for x in grid.xs:
            yield [(sx, sy), (x, sy), (x, ty), (tx, ty)]
        for y in grid.ys:
            yield [(sx, sy), (sx, y), (tx, y), (tx, ty)]
        for x, y in itertools.product(grid.xs, grid.ys):
            yield [(sx, sy), (x, sy), (x, y), (tx, y), (tx, ty)]
            yield [(sx, sy), (sx, y), (x, y), (x, ty), (tx, ty)]


@pytest.mark.parametrize("seed", range(12))
def test_costs_and_optimum(seed):
    rng = random.Random(seed)
    boxes = some_boxes(rng, 5)
    grid, drawn = S.Grid(boxes), []
    for s, t in [rng.sample(range(5), 2) for _ in range(5)]:
        middles = lambda b: [(b[0] + b[2] / 2, b[1]), (b[0] + b[2], b[1] + b[3] / 2), (b[0] + b[2] / 2, b[1] + b[3]), (b[0], b[1] + b[3] / 2)]
        points, found, looked = grid.find(s, t)
        assert points[0] in middles(boxes[s]) and points[-1] in middles(boxes[t]) and looked > 1
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in itertools.pairwise(points))
        assert clear(points, boxes, s, t)
        assert abs(total(points, drawn) - found) < 1e-6
        for way in few_bends(grid, middles(boxes[s]), middles(boxes[t])):
            way = [p for k, p in enumerate(way) if k == 0 or p != way[k - 1]]
            turned = all((a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(way, way[1:], way[2:], strict=False))
            if len(way) > 1 and turned and found > total(way, drawn) + 1e-6:
                assert not clear(way, boxes, s, t)
        drawn.append(points)
    assert grid.barred[0].max() <= 2 and not (S.Grid(boxes).barred[0] != grid.barred[0]).any()


def test_walled_in():
    ring = [(0.0, 0.0, 100.0, 10.0), (0.0, 90.0, 100.0, 10.0), (0.0, 5.0, 10.0, 90.0), (90.0, 5.0, 10.0, 90.0)]
    assert S.Grid([*ring, (40.0, 40.0, 10.0, 10.0), (200.0, 40.0, 10.0, 10.0)]).find(4, 5) is None

"""Shortest ways around boxes against all ways over a full table of lines, and curves against their samples."""

import itertools
import math
import random

import pytest

from strata.operators import visibility as V


def boxes(seed, n):
    r = random.Random(seed)
    return [(float(r.randrange(0, 400, 10)), float(r.randrange(0, 300, 10)), float(r.randrange(20, 70, 10)), float(r.randrange(20, 60, 10))) for _ in range(n)]


def crosses(a, b, box):
    """Cut the line where it meets the lines of the sides; a piece's middle tells whether the piece is inside."""
    x1, y1, x2, y2 = box
    cuts = {0.0, 1.0}
    for i, lines in ((0, (x1, x2)), (1, (y1, y2))):
        if b[i] != a[i]:
            cuts |= {t for v in lines if 0 < (t := (v - a[i]) / (b[i] - a[i])) < 1}
    for t, u in itertools.pairwise(sorted(cuts)):
        m = (t + u) / 2
        x, y = a[0] + (b[0] - a[0]) * m, a[1] + (b[1] - a[1]) * m
        if x1 + 2e-6 < x < x2 - 2e-6 and y1 + 2e-6 < y < y2 - 2e-6:
            return True
    return False


def all_ways(given, c=8.0):
    """Lengths between any two boxes by closing the full table of lines."""
    bars = [(x - c, y - c, x + w + c, y + h + c) for x, y, w, h in given]
    at = [p for x1, y1, x2, y2 in bars for p in ((x1, y1), (x2, y1), (x2, y2), (x1, y2), ((x1 + x2) / 2, y1), (x2, (y1 + y2) / 2), ((x1 + x2) / 2, y2), (x1, (y1 + y2) / 2))]
    n = len(at)
    far = [[0.0 if i == j else math.inf if any(crosses(at[i], at[j], b) for b in bars) else math.dist(at[i], at[j]) for j in range(n)] for i in range(n)]
    for k in range(n):
        for i in range(n):
            if far[i][k] < math.inf:
                far[i] = [min(u, far[i][k] + v) for u, v in zip(far[i], far[k], strict=True)]
    side = lambda s: range(s * 8 + 4, s * 8 + 8)
    return {(s, t): min(far[i][j] for i in side(s) for j in side(t)) for s in range(len(given)) for t in range(len(given)) if s != t}


@pytest.mark.parametrize("seed", range(6))
def test_no_way_is_shorter(seed):
    given = boxes(seed, 7)
    field, want = V.Field(given), all_ways(given)
    for s in range(len(given)):
        found = field.ways(s, set(range(len(given))) - {s})
        for t in set(range(len(given))) - {s}:
            if want[s, t] == math.inf:
                assert t not in found
                continue
            length, way = found[t]
            assert length == pytest.approx(want[s, t], abs=1e-6)
            assert sum(math.dist(a, b) for a, b in itertools.pairwise(field.drawn(way))) == pytest.approx(length + 16, abs=1e-6)


@pytest.mark.parametrize("seed", range(6))
def test_curves_are_joined_smooth_and_clear(seed):
    # On a loose lattice, so that every way exists.
    r = random.Random(seed)
    given = [(90.0 * i + r.randrange(0, 20), 80.0 * j + r.randrange(0, 20), 40.0, 30.0) for i in range(4) for j in range(3)]
    field = V.Field(given)
    for s in range(len(given)):
        for length, way in field.ways(s, set(range(len(given))) - {s}).values():
            curves, straight = field.curves(way)
            at = field.drawn(way)
            assert curves[0][0] == at[0] and curves[-1][3] == at[-1]
            for c in curves:
                for k in range(101):
                    t = k / 100
                    p = [sum(math.comb(3, i) * t**i * (1 - t) ** (3 - i) * c[i][a] for i in range(4)) for a in (0, 1)]
                    assert not any(x + 1e-3 < p[0] < x + w - 1e-3 and y + 1e-3 < p[1] < y + h - 1e-3 for x, y, w, h in given)
            for c, d in itertools.pairwise(curves):
                assert c[3] == d[0]
                if not straight:
                    u, v = V._less(c[3], c[2]), V._less(d[1], d[0])
                    assert abs(u[0] * v[1] - u[1] * v[0]) < 1e-6 and u[0] * v[0] + u[1] * v[1] > 0


def test_blocked_boxes_empty_tables_and_repeats(spark):
    nodes = spark.createDataFrame([("g", "a", 0.0, 0.0, 40.0, 30.0), ("g", "b", 100.0, 0.0, 40.0, 30.0), ("g", "c", 10.0, 5.0, 10.0, 10.0)], "graph_id string, node_id string, x double, y double, width double, height double")
    edges = spark.createDataFrame([("g", "e", "a", "b"), ("g", "e", "a", "b"), ("g", "loop", "a", "a"), ("g", "no", "a", "z"), ("g", "shut", "c", "b")], "graph_id string, edge_id string, source_id string, target_id string")
    got = V.visible_ways(nodes, edges).orderBy("edge_id").collect()
    assert [(r.edge_id, r.length, r.straight) for r in got] == [("e", 60.0, 0), ("e", 60.0, 0), ("shut", None, None)]
    assert [(p.x, p.y) for p in got[0].points] == [(40.0, 15.0), (48.0, 15.0), (92.0, 15.0), (100.0, 15.0)] and got[2].curves is None
    assert V.visible_ways(nodes.limit(0), edges).count() == V.visible_ways(nodes, edges.limit(0)).count() == V.corner_views(nodes.limit(0)).count() == 0

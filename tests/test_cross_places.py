"""Places of least total height against all places on a grid."""

import itertools
import random

import numpy as np
import pytest

from strata.operators import cross_places as C


def cost(y, edges, size, dummies=frozenset()):
    return sum(w * (1, 2, 8)[(s in dummies) + (t in dummies)] * abs(y[s] + size[s] / 2 - y[t] - size[t] / 2) for s, t, w in edges)


@pytest.mark.parametrize("seed", range(24))
def test_no_places_cost_less(seed):
    r = random.Random(seed)
    rows, n = [], 0
    for k in (2, 2, r.randrange(1, 3)):
        rows.append(list(range(n, n + k)))
        n += k
    size = [float(r.choice((0, 2))) for _ in range(n)]
    edges = [(a, b, float(r.randrange(1, 4))) for p, q in itertools.pairwise(rows) for a in p for b in q if r.random() < 0.6]
    dummies = frozenset(a for a in range(n) if not size[a])
    y = C.placed_rows(rows, edges, size, 1.0, dummies)
    fits = lambda y: all(y[b] - y[a] >= size[a] + 1.0 - 1e-6 for row in rows for a, b in itertools.pairwise(row))
    assert fits(y)
    grid = np.stack(np.meshgrid([0.0], *[np.arange(-7.0, 8.0)] * (n - 1), indexing="ij")).reshape(n, -1)
    ok = np.all([grid[b] - grid[a] >= size[a] + 1 for row in rows for a, b in itertools.pairwise(row)], axis=0)
    best = np.min(cost(grid[:, ok], edges, size, dummies))
    assert cost(y, edges, size, dummies) == pytest.approx(best)


def test_long_edges_are_straight_and_empty_rows():
    # a long edge of three dummies beside three nodes
    rows = [[0], [1, 2], [3, 4], [5, 6], [7]]
    edges = [(0, 1, 1.0), (1, 3, 1.0), (3, 5, 1.0), (5, 7, 1.0), (0, 2, 1.0), (2, 4, 1.0), (4, 6, 1.0), (6, 7, 1.0)]
    size = [10.0, 10.0, 0.0, 30.0, 0.0, 10.0, 0.0, 10.0]
    y = C.placed_rows(rows, edges, size, 5.0, frozenset({2, 4, 6}))
    assert y[2] == pytest.approx(y[4]) == pytest.approx(y[6])
    assert C.placed_rows([], [], [], 5.0) == []
    with pytest.raises(ValueError):
        C.least_lengths(2, [(0, 1, 1.0, 1.0), (1, 0, 1.0, 1.0)])


def test_many_members_end():
    r = random.Random(1)
    rows = [list(range(k * 20, k * 20 + 20)) for k in range(8)]
    edges = [(r.choice(p), r.choice(q), 1.0) for p, q in itertools.pairwise(rows) for _ in range(24)]
    size = [float(r.randrange(0, 60, 10)) for _ in range(160)]
    y = C.placed_rows(rows, edges, size, 20.0)
    assert all(y[b] - y[a] >= size[a] + 20 - 1e-6 for row in rows for a, b in itertools.pairwise(row))
    for row in rows:  # no member gains by moving alone
        for a in row:
            for by in (-1.0, 1.0):
                z = list(y)
                z[a] += by
                if all(z[q] - z[p] >= size[p] + 20 - 1e-6 for p, q in itertools.pairwise(row)):
                    assert cost(z, edges, size) >= cost(y, edges, size) - 1e-6


def test_tables(spark):
    nodes = spark.createDataFrame([("g", "a", 10.0, 20.0), ("g", "b", 10.0, 20.0), ("g", "c", 10.0, 10.0), ("h", "a", 1.0, 1.0)], "graph_id string, node_id string, width double, height double")
    order = spark.createDataFrame([("g", "a", 0, 0), ("g", "b", 1, 0), ("g", "c", 1, 1), ("h", "a", 0, 0)], "graph_id string, node_id string, layer int, pos int")
    pieces = spark.createDataFrame([("g", "a", "b", 5), ("g", "a", "c", None)], "graph_id string, from_id string, to_id string, weight int")
    got = {(r.graph_id, r.node_id): r.y for r in C.simplex_places(nodes, order, pieces).collect()}
    assert got == {("g", "a"): 12.0, ("g", "b"): 12.0, ("g", "c"): 52.0, ("h", "a"): 12.0}
    assert C.simplex_places(nodes, order, pieces.limit(0)).count() == 4 and C.simplex_places(nodes.limit(0), order, pieces).count() == 0

"""Compaction against all pairs of boxes, and least edge lengths against all places on a small grid."""

import itertools
import random

import pytest
from strata.operators import compaction as C


def some_boxes(rng, n):
    return [(float(rng.randrange(60)), float(rng.randrange(40)), float(rng.randrange(1, 9)), float(rng.choice([0, 1, 4, 12]))) for _ in range(n)]


def plain(boxes, gap, side_gap, to_right, locked=()):
    """Longest paths over all pairs that share a height."""
    b = [(-x - w, y, w, h) if to_right else (x, y, w, h) for x, y, w, h in boxes]
    order = sorted(range(len(b)), key=lambda i: (b[i][0], b[i][2], i))
    at = {}
    for k, i in enumerate(order):
        at[i] = b[i][0] if i in locked else min(q[0] for q in b)
        for j in order[:k]:
            if b[j][1] < b[i][1] + b[i][3] + side_gap and b[i][1] < b[j][1] + b[j][3] + side_gap:
                at[i] = max(at[i], at[j] + b[j][2] + gap)
    return [-at[i] - b[i][2] if to_right else at[i] for i in range(len(b))]


@pytest.mark.parametrize("seed", range(50))
def test_pushes(seed):
    rng = random.Random(seed)
    boxes, locked = some_boxes(rng, rng.randrange(0, 14)), set(rng.sample(range(14), 3))
    for to_right, lock in itertools.product((False, True), (set(), locked)):
        got = C.pushed(boxes, 2.0, 1.0, to_right, lock)
        assert got == plain(boxes, 2.0, 1.0, to_right, lock)
    assert len(C.visible(boxes, 1.0)) <= 3 * len(boxes)


@pytest.mark.parametrize("seed", range(12))
def test_least_edge_lengths(seed):
    rng = random.Random(seed)
    boxes = [(float(x), float(rng.randrange(4)), 1.0, 2.0) for x in rng.sample(range(9), 4)]
    edges = [(*rng.sample(range(4), 2), rng.randrange(1, 4)) for _ in range(4)]
    got = C.shortest_edges(boxes, edges, 1.0, 0.0)
    order = lambda i: (boxes[i][0], boxes[i][2], i)
    flow = [(*sorted(e[:2], key=order), e[2]) for e in edges]
    apart = [(a, b) for a, b in itertools.permutations(range(4), 2) if order(a) < order(b) and (boxes[a][1] < boxes[b][1] + 2 and boxes[b][1] < boxes[a][1] + 2 or (a, b) in {f[:2] for f in flow})]
    cost = lambda x: sum(w * (x[t] - x[s]) for s, t, w in flow)
    fits = lambda x: all(x[b] - x[a] >= 2 for a, b in apart)
    assert fits(got)
    assert abs(cost(got) - min(cost(x) for x in itertools.product(range(0, 9), repeat=4) if fits(x))) < 1e-6


def test_kinds_are_checked(spark):
    with pytest.raises(ValueError, match="no compaction"):
        C.compacted(spark.range(1), spark.range(1), "UP")

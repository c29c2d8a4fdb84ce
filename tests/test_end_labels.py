"""End labels against a plain count of what they cover, and that they move to free spots where there are any."""

import random

import numpy as np
import pytest
from strata.operators import end_labels as E


@pytest.mark.parametrize("seed", range(20))
def test_what_a_label_covers(seed):
    """On even places a label's half-unit points see what lies under them."""
    rng = random.Random(seed)
    even = lambda n: 2 * rng.randrange(n)
    boxes = np.array([(even(10), even(10), 2 + even(4), 2 + even(4)) for _ in range(5)], float)
    lines = np.array([(x, y, x + (l if flat else 0), y + (0 if flat else l)) for x, y, l, flat in ((1 + even(9), 1 + even(9), 2 + even(5), rng.random() < 0.5) for _ in range(6))], float)
    x, y, w, h = even(10), even(10), 2 + even(4), 2 + even(4)
    cells = {(x + i + 0.5, y + j + 0.5) for i in range(w) for j in range(h)}
    want = 2 * sum(any(b[0] < p < b[0] + b[2] and b[1] < q < b[1] + b[3] for p, q in cells) for b in boxes)
    want += sum(any(abs(p - min(max(p, s[0]), s[2])) <= 0.5 and abs(q - min(max(q, s[1]), s[3])) <= 0.5 and (s[0] <= p <= s[2] or s[1] <= q <= s[3]) for p, q in cells) for s in lines)
    assert E.covered(x, y, w, h, boxes, lines) == want


def test_labels_leave_what_they_cover(spark):
    nodes = spark.createDataFrame([("g", 0.0, 0.0, 20.0, 20.0), ("g", 100.0, 0.0, 20.0, 20.0), ("g", 20.0, 11.0, 30.0, 20.0)], "graph_id string, x double, y double, width double, height double")
    routes = spark.createDataFrame([("g", "e", [(20.0, 10.0), (100.0, 10.0)]), ("g", "f", [(20.0, 5.0), (60.0, 5.0), (60.0, 80.0)])], "graph_id string, edge_id string, points array<struct<x:double,y:double>>")
    labels = spark.createDataFrame([("g", "e", "TAIL", 22.0, 11.0, 10.0, 6.0), ("g", "e", "HEAD", 85.0, 12.0, 10.0, 6.0), ("g", "f", "TAIL", 22.0, 11.0, 10.0, 6.0), ("g", "none", "HEAD", 0.0, 0.0, 5.0, 5.0)], "graph_id string, edge_id string, end string, x double, y double, width double, height double")
    got = {(r.edge_id, r.end): r for r in E.placed_end_labels(labels, routes, nodes).collect()}
    assert (got["e", "HEAD"].x, got["e", "HEAD"].y, got["e", "HEAD"].covers) == (85.0, 12.0, 0)
    assert got["e", "TAIL"].covers == got["f", "TAIL"].covers == 0 and got["none", "HEAD"].covers == 2
    assert (got["e", "TAIL"].x, got["e", "TAIL"].y) != (22.0, 11.0)

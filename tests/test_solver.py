"""Constraints of several strengths against all whole places in a small range."""

import itertools
import random

import numpy as np
import pytest
from strata.operators import solver as S


def missed(rows, x):
    return [abs(sum(f * x[j] for j, f in factors.items()) - c) if relation == "=" else max(0.0, c - sum(f * x[j] for j, f in factors.items())) for factors, relation, c, _ in rows]


@pytest.mark.parametrize("seed", range(40))
def test_levels_are_least_in_turn(seed):
    rng = random.Random(seed)
    n, levels = 3, 3
    rows = []
    for _ in range(rng.randrange(2, 7)):  # differences and places, so that whole numbers are among the best
        a, b = rng.sample(range(n), 2)
        factors = rng.choice([{a: 1.0}, {a: 1.0, b: -1.0}])
        rows.append((factors, rng.choice(["=", ">="]), float(rng.randrange(-3, 4)), rng.randrange(levels - 1)))
    rows += [({j: 1.0}, "=", 0.0, levels - 1) for j in range(n)]
    x, misses = S.least(levels, rows, n)
    assert np.allclose(misses, missed(rows, x), atol=1e-7)
    score = lambda m: [round(sum(v for v, r in zip(m, rows, strict=True) if r[3] == k), 6) for k in range(levels)]
    assert score(misses) == min(score(missed(rows, p)) for p in itertools.product(range(-10, 11), repeat=n))


def test_statuses(spark):
    n = spark.createDataFrame([("g", "a", 0.0, 0.0, 10.0, 4.0), ("g", "b", 50.0, 20.0, 20.0, 4.0), ("h", "a", 1.0, 1.0, 1.0, 1.0)], "graph_id string, node_id string, x double, y double, width double, height double")
    term = lambda node, attribute, factor=1.0: (node, attribute, factor)
    rows = [
        ("g", "1", "required", "=", 5.0, [term("a", "x")]),
        ("g", "2", "required", "=", 6.0, [term("a", "x")]),
        ("g", "3", "strong", ">=", 30.0, [term("b", "x"), term("a", "right", -1.0)]),
        ("g", "4", "medium", "=", 0.0, [term("b", "centerY"), term("a", "centerY", -1.0)]),
        ("g", "5", "weak", "=", 1.0, [term("nobody", "x")]),
    ]
    got = S.solved(n, spark.createDataFrame(rows, S.ROWS)).collect()
    status = {r.id: r.status for r in got if r.kind == "constraint"}
    assert sorted((status["1"], status["2"])) == ["ok", "unsatisfied"] and status["3"] == status["4"] == "ok" and status["5"] == "unknown"
    at = {r.id: (r.x, r.y) for r in got if r.kind == "node"}
    assert at.keys() == {"a", "b"} and at["b"][0] == 50.0 and abs(at["a"][1] - at["b"][1]) < 1e-9

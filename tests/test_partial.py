"""A selection arranged alone, against every slide on a grid."""

import random

import pytest
from pyspark.sql import functions as F
from strata.operators import partial as P

NODES = "graph_id string, node_id string, parent_id string, ord int, x double, y double, width double, height double"
EDGES = "graph_id string, edge_id string, source_id string, target_id string, ord int, weight long"
GAP = 2.0


def as_they_are(nodes, edges):
    return nodes.select("graph_id", "node_id", "x", "y")


def meet(a, b):
    return a[0] < b[0] + b[2] + GAP and b[0] < a[0] + a[2] + GAP and a[1] < b[1] + b[3] + GAP and b[1] < a[1] + a[3] + GAP


def nearest(group, others, parent):
    """(dx, dy) by trying all slides along x, then y."""
    def fits(dx, dy):
        moved = [(x + dx, y + dy, w, h) for x, y, w, h in group]
        inside = parent is None or all(x >= parent[0] and y >= parent[1] and x + w <= parent[0] + parent[2] and y + h <= parent[1] + parent[3] for x, y, w, h in moved)
        return inside and not any(meet(a, b) for a in moved for b in others)

    slides = [(d, 0) for d in range(-200, 201)] + [(0, d) for d in range(-200, 201)]
    return min((s for s in slides if fits(*s)), key=lambda s: (abs(s[0]) + abs(s[1]), s[0] == 0 and s[1] != 0, -s[0] - s[1]), default=None)


def test_nearest_places(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(40):
        box = lambda: tuple(float(v) for v in (rng.randrange(40), rng.randrange(40), rng.randrange(1, 12), rng.randrange(1, 12)))
        others, group = [box() for _ in range(rng.randrange(1, 9))], [box() for _ in range(rng.randrange(1, 4))]
        parent = (0.0, 0.0, 55.0, 55.0) if g % 2 else None
        if parent:
            rows.append((f"g{g}", "p", None, 0, *parent))
        up = "p" if parent else None
        rows += [(f"g{g}", f"o{k}", up, k, *b) for k, b in enumerate(others)] + [(f"g{g}", f"s{k}", up, 50 + k, *b) for k, b in enumerate(group)]
        slide = nearest(group, others, parent)
        for k, (x, y, _, _) in enumerate(group):
            want[f"g{g}", f"s{k}"] = (x, y, "blocked") if slide is None else (x + slide[0], y + slide[1], "placed")
        want |= {(f"g{g}", f"o{k}"): (b[0], b[1], "fixed") for k, b in enumerate(others)}
    n = spark.createDataFrame(rows, NODES)
    out = P.partial_places(n, spark.createDataFrame([], EDGES), n.where("node_id like 's%'"), as_they_are, GAP)
    got = {(r.graph_id, r.node_id): (r.x, r.y, r.status) for r in out.where("node_id <> 'p'").collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {} and got.keys() == want.keys()
    assert {"blocked", "placed"} <= {v[2] for v in got.values()}


def test_parents_in_turn_and_problems(spark):
    rows = [("g", "p", None, 0, 0.0, 0.0, 100.0, 50.0), ("g", "in", "p", 1, 5.0, 5.0, 10.0, 10.0), ("g", "out", None, 2, 90.0, 20.0, 10.0, 10.0), ("g", "bad", None, 3, float("nan"), 0.0, 1.0, 1.0)]
    n = spark.createDataFrame(rows, NODES)
    chosen = spark.createDataFrame([("g", "in"), ("g", "out"), ("g", "p"), ("g", "nobody")], "graph_id string, node_id string")
    told = {(r.id, r.problem) for r in P.problems(n, chosen).collect()}
    assert told == {("nobody", "unknown selected node"), ("p", "selected node holds others"), ("bad", "no finite place")}
    got = {r.node_id: (r.x, r.y, r.status) for r in P.partial_places(n, spark.createDataFrame([], EDGES), chosen, as_they_are, GAP).where(~F.isnan("x")).collect()}
    assert got["p"] == (0.0, 0.0, "fixed") and got["in"] == (5.0, 5.0, "placed") and got["out"] == (102.0, 20.0, "placed")


@pytest.mark.parametrize("clearance", [0.0, 5.0])
def test_only_affected_routes_are_drawn_anew(spark, clearance):
    rows = [("g", f"n{k}", None, k, 40.0 * k, 30.0 * (k % 2), 10.0, 10.0) for k in range(6)]
    n = spark.createDataFrame(rows, NODES)
    e = spark.createDataFrame([("g", f"e{k}", f"n{k}", f"n{k + 1}", k, 1) for k in range(5)], EDGES)
    after = n.withColumn("x", F.when(F.col("node_id") == "n0", 500.0).otherwise(F.col("x")))
    mark = lambda ns, es: es.select("graph_id", "edge_id", F.array(F.struct(F.lit(-1.0).alias("x"), F.lit(-1.0).alias("y"))).alias("points"))
    from strata.operators import quality

    kept = {r.edge_id: len(r.points) for r in P.repaired_routes(n, after, e, quality.elbow_routes(n, e), mark, clearance).collect()}
    assert kept == {"e0": 1, "e1": 4, "e2": 4, "e3": 4, "e4": 4}

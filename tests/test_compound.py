"""Compound drawings of three levels: children inside parents, siblings apart, edges in the scope that holds both ends."""

import itertools

import pytest
from strata.operators import compound as C
from strata.operators import graph as G
from strata.plans.registry import layered

NODES = [("g", "a", None), ("g", "b", None), ("g", "a1", "a"), ("g", "a2", "a"), ("g", "a11", "a1"), ("g", "a12", "a1"), ("g", "b1", "b"), ("g", "lost", "nowhere"), ("h", "a", None)]
EDGES = [("a11", "a12"), ("a12", "a2"), ("a11", "b1"), ("b1", "a2"), ("a", "a11"), ("b1", "b"), ("lost", "b1"), ("a2", "a2")]


def frames(spark):
    n = spark.createDataFrame([(*r, k, 30.0, 10.0) for k, r in enumerate(NODES)], "graph_id string, node_id string, parent_id string, ord int, width double, height double")
    e = spark.createDataFrame([("g", f"{s}>{t}", s, t, k, 1) for k, (s, t) in enumerate(EDGES)], "graph_id string, edge_id string, source_id string, target_id string, ord int, weight long")
    return n, e


def test_edges_are_seen_where_their_ends_part(spark):
    n, e = frames(spark)
    got = {(r.scope, r.source_id, r.target_id): r.members for r in C.scope_edges(C.lineage(n.where("node_id <> 'lost'")), e).collect()}
    assert got == {("a1", "a11", "a12"): 1, ("a", "a1", "a2"): 1, ("", "a", "b"): 1, ("", "b", "a"): 1}


def test_three_levels(spark):
    n, e = frames(spark)
    placed = C.compound_places(n, e, layered, padding=5.0, header=3.0)
    box = {(r.graph_id, r.node_id): (r.x, r.y, r.x + r.width, r.y + r.height) for r in C.world_boxes(placed).collect()}
    assert box.keys() == {(g, i) for g, i, _ in NODES}
    for g, i, up in NODES:
        if (g, up) in box:
            b, p = box[g, i], box[g, up]
            assert p[0] + 5 <= b[0] and p[1] + 8 <= b[1] and b[2] <= p[2] - 5 and b[3] <= p[3] - 5
    up = {(g, i): p if (g, p) in box else None for g, i, p in NODES}
    for a, b in itertools.combinations(box, 2):
        if a[0] == b[0] and up[a] == up[b]:
            p, q = box[a], box[b]
            assert p[2] <= q[0] or q[2] <= p[0] or p[3] <= q[1] or q[3] <= p[1]
    assert box["g", "a11"][2] <= box["g", "a12"][0]  # edges run to the right inside a scope


def test_rings_of_parents_are_refused(spark):
    n, e = frames(spark)
    ring = spark.createDataFrame([("g", "x", "y", 0, 1.0, 1.0), ("g", "y", "x", 1, 1.0, 1.0)], n.schema)
    with pytest.raises(ValueError, match="cycle"):
        C.compound_places(ring, e, layered)
    assert G.closure(n).count() == 8

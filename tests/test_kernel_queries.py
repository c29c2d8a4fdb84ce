"""What the queries over per-graph kernels return, checked against the graphs they come from."""

from collections import defaultdict

import numpy as np
import pytest
from strata.plans import catalog, catalog_drawings, catalog_more, catalog_routes, registry  # noqa: F401
from strata.sources.graphs import transition_graphs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graphs(spark):
    """graph -> (node -> ord, edge -> (source, target, weight))."""
    n, e = transition_graphs(spark, SF)
    out = defaultdict(lambda: ({}, {}))
    for r in n.collect():
        out[r.graph_id][0][r.node_id] = r.ord
    for r in e.collect():
        out[r.graph_id][1][r.edge_id] = (r.source_id, r.target_id, r.weight)
    return dict(out)


def per_graph(spark, name):
    out = defaultdict(list)
    for r in catalog.QUERIES[name](spark, SF).collect():
        out[r.graph_id].append(r)
    return out


def flow(graph):
    order, edges = graph
    return [(s, t, w) if order[s] < order[t] else (t, s, w) for s, t, w in edges.values() if s != t]


def acyclic(edges):
    left = {x for s, t in edges for x in (s, t)}
    while left:
        free = {x for x in left if not any(t == x and s in left for s, t in edges)}
        if not free:
            return False
        left -= free
    return True


@pytest.mark.parametrize("name", ["cycle_greedy", "cycle_depth_first", "cycle_breadth_first", "cycle_components"])
def test_no_cycle_is_left(spark, graphs, name):
    got = per_graph(spark, name)
    for g, (_, edges) in graphs.items():
        turned = {r.edge_id: r.reversed for r in got.get(g, [])}
        assert turned.keys() == edges.keys()
        assert acyclic({(t, s) if turned[k] else (s, t) for k, (s, t, _) in edges.items() if s != t})


def layers(rows):
    return {r.node_id: r.layer for r in rows}


@pytest.mark.parametrize("name", ["layer_network_simplex", "layer_coffman_graham", "layer_min_width", "layer_stretch_width", "node_promotion"])
def test_layers_fit_the_flow(spark, graphs, name):
    got, sink = per_graph(spark, name), per_graph(spark, "layer_longest_path_sink")
    for g, graph in graphs.items():
        at, cost = layers(got[g]), lambda l: sum(w * (l[t] - l[s]) for s, t, w in flow(graph))
        assert at.keys() == graph[0].keys() and all(at[s] < at[t] for s, t, _ in flow(graph))
        if name == "layer_coffman_graham":
            assert max(map(list(at.values()).count, at.values())) <= 2
        if name in ("layer_network_simplex", "node_promotion"):
            assert cost(at) <= cost(layers(sink[g]))


def test_sweep_and_placement(spark, graphs):
    swept, placed = per_graph(spark, "layer_sweep"), per_graph(spark, "place_aligned")
    for g, graph in graphs.items():
        at = layers(swept[g])
        assert all(at[s] < at[t] for s, t, _ in flow(graph))
        for k in set(at.values()):
            assert sorted(r.pos for r in swept[g] if r.layer == k) == list(range(list(at.values()).count(k)))
            row = sorted((r for r in placed[g] if r.layer == k), key=lambda r: r.pos)
            assert all(b.middle - a.middle >= (a.height + b.height) / 2 + 20 - 1e-6 for a, b in zip(row, row[1:], strict=False))


def test_routes_keep_out_of_boxes(spark, graphs):
    got = per_graph(spark, "route_orthogonal")
    for g, (order, edges) in graphs.items():
        boxes = {n: (a * 137.0, a * a * 61.0 % 197) for n, a in order.items()}
        by_edge = defaultdict(list)
        for r in sorted(got.get(g, []), key=lambda r: r.k):
            by_edge[r.edge_id].append((r.x, r.y))
        assert by_edge.keys() == {k for k, (s, t, _) in edges.items() if s != t}
        for p in by_edge.values():
            for (ax, ay), (bx, by) in zip(p, p[1:], strict=False):
                assert ax == bx or ay == by
                assert not any(min(ax, bx) < x + 60 and max(ax, bx) > x and min(ay, by) < y + 40 and max(ay, by) > y for x, y in boxes.values())


def test_forces_and_names(spark, graphs):
    for name in ("arrange_force", "arrange_stress"):
        got = per_graph(spark, name)
        again = per_graph(spark, name)
        for g, (order, _) in graphs.items():
            assert {r.node_id for r in got[g]} == order.keys() and np.isfinite([(r.x, r.y) for r in got[g]]).all()
            assert len({(round(r.x, 6), round(r.y, 6)) for r in got[g]}) == len(order) and sorted(got[g]) == sorted(again[g])
    every = per_graph(spark, "arrange_by_name")
    for g, (order, _) in graphs.items():
        assert len(every[g]) == len(order) * (len(registry.algorithms()) - 2) and np.isfinite([(r.x, r.y) for r in every[g]]).all()


def test_registration_is_undone(spark):
    undo = registry.register("own", lambda n, e, **o: n)
    assert "own" in registry.algorithms()
    undo()
    assert "own" not in registry.algorithms()
    n, e = transition_graphs(spark, SF)
    assert registry.arrange(n, e, lambda n, e: n.limit(0)).count() == 0
    with pytest.raises(ValueError):
        registry.arrange(n, e, "own")


def test_tracks_are_as_few_as_needed_and_never_shared(spark):
    need = {(r.graph_id, r.layer): r.tracks for r in catalog.QUERIES["trade_tracks"](spark, SF).collect()}
    at = {(r.graph_id, r.node_id): r.layer for r in catalog.QUERIES["trade_layers"](spark, SF).collect()}
    east = {(r.graph_id, r.edge_id): at[r.graph_id, r.node_id] for r in catalog.QUERIES["trade_ports"](spark, SF).where("side = 'EAST'").collect()}
    routes = defaultdict(list)
    for r in catalog.QUERIES["trade_track_routes"](spark, SF).collect():
        routes[r.graph_id, r.edge_id, r.track].append((r.k, r.x, r.y))
    gaps = defaultdict(list)
    for (g, e, track), points in routes.items():
        p = [(x, y) for _, x, y in sorted(points)]
        assert all(a[0] == b[0] or a[1] == b[1] for a, b in zip(p, p[1:], strict=False)) and p[0][0] < p[-1][0]
        if track >= 0:
            assert len(p) == 4 and p[0][0] < p[1][0] < p[3][0]
            gaps[g, east[g, e]].append((track, min(p[1][1], p[2][1]), max(p[1][1], p[2][1])))
    assert {k: max(t for t, _, _ in v) + 1 for k, v in gaps.items()} == need
    for spans in gaps.values():
        for i, (t, lo, hi) in enumerate(spans):
            assert not any(t == u and lo < b and a < hi for u, a, b in spans[:i])


def test_one_huge_box_makes_few_rows(spark):
    from strata.operators import quality

    rows = [("g", f"n{i}", float(i % 50 * 30), float(i // 50 * 30), 20.0, 20.0) for i in range(1000)] + [("g", "all", -1e6, -1e6, 2e6, 2e6), ("g", "wide", -1e5, 10.0, 2e5, 1.0)]
    n = spark.createDataFrame(rows, "graph_id string, node_id string, x double, y double, width double, height double")
    got = {(r.node_id, r.other_id) for r in quality.node_overlaps(n).collect()}
    over = lambda a, b: a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5]
    assert got == {tuple(sorted((a[1], b[1]))) for i, a in enumerate(rows) for b in rows[:i] if over(a, b)}

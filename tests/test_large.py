"""Components and layers in rounds give what the kernels give, whatever the bound between them."""

import random

import pytest

from strata.operators import kernels as K
from strata.operators import large

NODES, EDGES = "graph_id string, node_id string, ord int", "graph_id string, edge_id string, source_id string, target_id string, ord int, weight long"


def tables(spark, graphs):
    nodes = [(g, f"n{i}", i) for g, (n, _) in graphs.items() for i in range(n)]
    edges = [(g, f"e{k}", f"n{s}", f"n{t}", k, 1) for g, (_, es) in graphs.items() for k, (s, t) in enumerate(es)] + [("a", "no", "n0", "nowhere", 99, 1)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_rounds_equal_kernels(spark):
    r = random.Random(3)
    graphs = {g: (n, sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(m)})) for g, n, m in (("a", 30, 22), ("b", 12, 40), ("c", 5, 0), ("d", 2, 3))}
    graphs["chain"] = (9, [(i, i + 1) for i in range(8)] + [(0, 1)])  # an edge twice
    nodes, edges = tables(spark, graphs)
    found = {(x.graph_id, x.node_id): x.component for x in large.components(nodes, edges).collect()}
    up, down = ({(x.graph_id, x.node_id): x.layer for x in large.longest_path_layers(nodes, edges, f).collect()} for f in (False, True))
    for g, (n, es) in graphs.items():
        es = [(s, t, 1) for s, t in es]
        assert [found[g, f"n{i}"] for i in range(n)] == K.components(n, es)
        assert [up[g, f"n{i}"] for i in range(n)] == K.longest_path(n, es)
        assert [down[g, f"n{i}"] for i in range(n)] == K.longest_path(n, es, True)
    assert len(found) == len(up) == len(down) == sum(n for n, _ in graphs.values())


def test_cycle_empty_tables_and_loops(spark):
    nodes, edges = tables(spark, {"a": (3, [(0, 1), (1, 2), (2, 0)])})
    with pytest.raises(ValueError):
        large.longest_path_layers(nodes, edges)
    assert {x.component for x in large.components(nodes, edges).collect()} == {0}
    assert large.components(nodes.limit(0), edges).count() == large.longest_path_layers(nodes.limit(0), edges).count() == 0
    nodes, edges = tables(spark, {"a": (2, [(0, 0)])})
    assert sorted(x.component for x in large.components(nodes, edges).collect()) == [0, 1]


@pytest.mark.parametrize("most", [0, 20, 10**6])
def test_bound_decides_nothing(spark, most):
    from strata.plans.runner import per_graph

    nodes, edges = tables(spark, {"a": (40, [(i, i + 2) for i in range(30)]), "b": (4, [(0, 3)])})
    kernel = lambda n, e: per_graph(n, e, lambda ids, _, es: zip(ids, K.components(len(ids), es), strict=True), "node_id string, component long")
    got = {(x.graph_id, x.node_id, x.component) for x in large.by_size(nodes, edges, kernel, large.components, most).collect()}
    assert len(got) == 44 and ("b", "n3", 0) in got and ("a", "n31", 1) in got

"""Containment of any depth."""

import pytest

from strata.operators import graph

SCHEMA = "graph_id long, node_id string, parent_id string"


def test_deep_tree_has_all_ancestors(spark):
    nodes = spark.createDataFrame([(1, str(i), str(i - 1) if i else None) for i in range(80)], SCHEMA)
    got = {(int(r.node_id), int(r.ancestor_id), r.depth) for r in graph.closure(nodes).collect()}
    assert got == {(i, j, i - j) for i in range(80) for j in range(i)}


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        graph.closure(spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a")], SCHEMA)).count()

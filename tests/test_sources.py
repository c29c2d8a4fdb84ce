"""Authored JSON trees as tables."""

import json

import pytest

from strata.sources.graphs import read_graph_tables

GRAPH = {
    "id": "g",
    "layoutOptions": {"direction": "RIGHT"},
    "children": [
        {"id": "a", "width": 4, "labels": [{"text": "one", "width": 9, "height": 2}, {"text": "two"}], "ports": [{"id": "p", "x": 4, "width": 1, "labels": [{"text": "port"}]}], "children": [{"id": "b", "x": 1, "layoutOptions": {"spacing": 7}}], "edges": [{"id": "in", "sources": ["p"], "targets": ["b"]}]},
        {"id": "c"},
    ],
    "edges": [{"id": "e", "sources": ["p", "c"], "targets": ["c", "b", "a"], "labels": [{"text": "edge"}]}, {"id": "bare"}],
}


def test_ports_labels_options_and_all_ends(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(GRAPH))
    t = read_graph_tables(spark, str(tmp_path), 3)
    rows = lambda name, *cols: sorted((tuple(r) for r in t[name].select(*cols).collect()), key=str)
    assert rows("nodes", "node_id", "parent_id", "width") == [("a", None, 4.0), ("b", "a", 0.0), ("c", None, 0.0)]
    assert rows("edges", "edge_id", "source_id", "target_id") == [("bare", None, None), ("e", "a", "c"), ("in", "a", "b")]
    assert rows("ends", "edge_id", "role", "k", "node_id", "port_id") == [("e", "source", 0, "a", "p"), ("e", "source", 1, "c", None), ("e", "target", 0, "c", None), ("e", "target", 1, "b", None), ("e", "target", 2, "a", None), ("in", "source", 0, "a", "p"), ("in", "target", 0, "b", None)]
    assert rows("ports", "port_id", "node_id", "x") == [("p", "a", 4.0)]
    assert rows("labels", "owner", "owner_id", "k", "text", "width") == [("edge", "e", 0, "edge", 0.0), ("node", "a", 0, "one", 9.0), ("node", "a", 1, "two", 0.0), ("port", "p", 0, "port", 0.0)]
    assert rows("options", "owner", "owner_id", "name", "value") == [("graph", "g", "direction", "RIGHT"), ("node", "b", "spacing", "7")]


def test_a_deeper_tree_is_an_error(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(GRAPH))
    with pytest.raises(Exception, match="deeper than 1"):
        read_graph_tables(spark, str(tmp_path), 1)["nodes"].collect()

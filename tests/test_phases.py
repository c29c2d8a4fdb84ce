"""Phases given as functions, the trace of phases, and faults of drawings on small cases."""

from pyspark.sql import functions as F

from strata.operators import graph, measures, packing
from strata.plans import registry

NODES = "graph_id string, node_id string, ord int, x double, y double, width double, height double"


def _line(spark):
    nodes = spark.createDataFrame([("g", a, i, 0.0, float(y), 10.0, 10.0) for i, (a, y) in enumerate([("a", 0), ("b", 50), ("c", 5)])], NODES)
    edges = spark.createDataFrame([("g", "ab", "a", "b", 0, 1), ("g", "ac", "a", "c", 1, 1)], "graph_id string, edge_id string, source_id string, target_id string, ord int, weight long")
    return nodes, edges


def test_phases_can_be_replaced_and_are_told(spark):
    nodes, edges = _line(spark)
    seen = []
    backwards = lambda n, e: e.select("graph_id", "edge_id", F.lit(True).alias("reversed"))
    got = registry.arrange(nodes, edges, "layered", break_cycles=backwards, order_nodes=graph.order_by_place, place_nodes=graph.place_by_cross, trace=lambda name, rows: seen.append((name, sorted(rows.columns))))
    # c is above b by its place; b is out of its way and stays where it is.
    assert sorted((r.node_id, r.layer, r.y) for r in got.collect()) == [("a", 1, 12.0), ("b", 0, 62.0), ("c", 0, 17.0)]
    assert [name for name, _ in seen] == ["break_cycles", "assign_layers", "order_nodes", "place_nodes"]
    assert "pos" in seen[2][1] and "x" in seen[3][1]


def test_a_path_with_a_missing_node_has_faults(spark):
    nodes = _line(spark)[0].withColumn("x", F.col("ord") * 10.0)
    paths = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("g", 3, "gone"), ("g", 4, "c")], "graph_id string, k int, node_id string")
    assert [tuple(r) for r in measures.path_faults(paths, nodes).collect()] == [("g", 2)]
    assert [tuple(r) for r in measures.path_faults(paths, nodes, backwards=True).collect()] == [("g", 3)]


def test_lines_that_touch_or_run_together_dont_cross(spark):
    line = lambda i, *p: ("g", i, [(float(x), float(y)) for x, y in p])
    routes = spark.createDataFrame([line("a", (0, 0), (300, 300)), line("b", (0, 300), (300, 0)), line("c", (0, 0), (300, 300)), line("d", (150, 0), (150, 150))], "graph_id string, edge_id string, points array<struct<x:double,y:double>>")
    assert [tuple(r) for r in measures.proper_crossings(routes).collect()] == [("g", 2)]


def test_bits_are_javas(spark):
    # new java.util.Random(42): nextInt() -1170105035, 234785527; nextBoolean() true, false
    draws = spark.range(1).select(packing.lcg_bits(2, F.lit(42).cast("long"), 32).alias("i"), packing.lcg_bits(2, F.lit(42).cast("long"), 1).alias("b")).first()
    assert [v - (1 << 32) if v >= 1 << 31 else v for v in draws.i] == [-1170105035, 234785527]
    assert list(draws.b) == [1, 0]

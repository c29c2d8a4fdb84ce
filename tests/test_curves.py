"""Curves against their definitions, and attachments and wrapping on small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strata.functions import curves
from strata.functions import geometry as g
from strata.operators import attachments, graph

POINTS = "array<struct<x:double,y:double>>"


def bezier(c, t):
    s = 1 - t
    return tuple(s**3 * c.a[k] + 3 * s * s * t * c.c1[k] + 3 * s * t * t * c.c2[k] + t**3 * c.b[k] for k in "xy")


def de_boor(points, i, t):
    """The clamped uniform cubic B-spline through the basis functions, in its piece ``i``."""
    m = len(points) - 3
    knots = [min(max(j - 3, 0), m) for j in range(m + 7)]

    def basis(j, degree):
        if degree == 0:
            return 1.0 if j == i + 3 else 0.0
        left, right = knots[j + degree] - knots[j], knots[j + degree + 1] - knots[j + 1]
        return ((t - knots[j]) / left * basis(j, degree - 1) if left else 0.0) + ((knots[j + degree + 1] - t) / right * basis(j + 1, degree - 1) if right else 0.0)

    return tuple(sum(basis(j, 3) * p[k] for j, p in enumerate(points)) for k in (0, 1))


def test_spline_pieces_are_the_spline(spark):
    r = random.Random(1)
    lines = [[(r.uniform(-9, 9), r.uniform(-9, 9)) for _ in range(n)] for n in (4, 5, 6, 7, 9, 12)]
    df = spark.createDataFrame(list(enumerate(lines)), f"id int, p {POINTS}").select("id", curves.spline_pieces(F.col("p")).alias("c"))
    for row in df.collect():
        assert len(row.c) == len(lines[row.id]) - 3
        for i, c in enumerate(row.c):
            for t in (0.0, 0.3, 0.5, 0.9):
                assert bezier(c, t) == pytest.approx(de_boor(lines[row.id], i, i + t), abs=1e-9)


def test_split_and_flattened(spark):
    r = random.Random(2)
    lines = [[(r.uniform(0, 300), r.uniform(0, 300)) for _ in range(4)] for _ in range(30)] + [[(5.0, 5.0)] * 4]
    c = curves.s_curve(F.col("p"))
    df = spark.createDataFrame(list(enumerate(lines)), f"id int, p {POINTS}").select("id", c.alias("c"), curves.split_cubic(c, F.lit(0.3)).alias("s"), curves.flattened(c, 0.5).alias("f"))
    for row in df.collect():
        for t in (0.0, 0.5, 1.0):
            assert bezier(row.s.before, t) == pytest.approx(bezier(row.c, 0.3 * t), abs=1e-9)
            assert bezier(row.s.after, t) == pytest.approx(bezier(row.c, 0.3 + 0.7 * t), abs=1e-9)
        n = len(row.f) - 1
        for i in range(n):
            for part in (0.25, 0.5, 0.75):
                on, (a, b) = bezier(row.c, (i + part) / n), row.f[i : i + 2]
                chord = (a.x + (b.x - a.x) * part, a.y + (b.y - a.y) * part)
                assert math.dist(on, chord) <= 0.5 + 1e-9


def test_direction_at_ends_and_of_nothing(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)]), (2, [(1.0, 1.0), (1.0, 1.0)])], f"id int, p {POINTS}")
    at = lambda d: g.direction_at(F.col("p"), F.lit(d))
    one, two = [[tuple(w) for w in r.w] for r in df.orderBy("id").select(F.array(at(-1.0), at(0.0), at(3.0), at(3.5), at(99.0)).alias("w")).collect()]
    assert one == [(1, 0), (1, 0), (1, 0), (0, 1), (0, 1)] and set(two) == {(0, 0)}


def test_a_comment_has_one_edge_and_rows_alternate(spark):
    nodes = spark.createDataFrame([("g", i, n, 0.0, 0.0, w, 10.0) for i, (n, w) in enumerate([("h", 100.0), ("a", 20.0), ("b", 30.0), ("c", 40.0), ("two", 9.0)])], "graph_id string, ord int, node_id string, x double, y double, width double, height double")
    edges = spark.createDataFrame([("g", "a", "h"), ("g", "h", "b"), ("g", "c", "h"), ("g", "two", "h"), ("g", "two", "a")], "graph_id string, source_id string, target_id string")
    hosts = attachments.comment_hosts(edges.where("not (source_id = 'two' and target_id = 'a')").unionByName(edges.where("source_id = 'two' and target_id = 'h'")), nodes.where("node_id <> 'h'"))
    assert sorted((r.node_id, r.host_id) for r in hosts.collect()) == [("a", "h"), ("b", "h"), ("c", "h")]
    assert sorted((r.node_id, r.x, r.y) for r in attachments.comment_boxes(nodes, hosts).collect()) == [("a", 15.0, -20.0), ("b", 35.0, 20.0), ("c", 45.0, -20.0)]


def test_unknown_alignment_is_an_error(spark):
    ports = spark.createDataFrame([("g", "n", "EAST", 0)], "graph_id string, node_id string, side string, index int")
    sides = spark.createDataFrame([("g", "n", "EAST", "ASKEW", 40.0)], "graph_id string, node_id string, side string, alignment string, extent double")
    with pytest.raises(Exception, match="no alignment of ports: ASKEW"):
        attachments.aligned_ports(ports, sides).collect()


def test_a_layer_wider_than_the_row_has_one_of_its_own(spark):
    sizes = spark.createDataFrame([("g", 0, 10.0), ("g", 1, 99.0), ("g", 2, 10.0), ("g", 3, 10.0)], "graph_id string, layer int, size double")
    got = sorted((r.layer, r.row, r.start) for r in graph.wrapped_by_width(sizes, 50.0).collect())
    assert got == [(0, 0, 0.0), (1, 1, 0.0), (2, 2, 0.0), (3, 2, 30.0)]

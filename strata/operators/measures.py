"""Measures of whole drawings, made of those of their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..storage import written
from . import labels, quality, routing


def quality_tuples(nodes: DataFrame, edges: DataFrame, routes: DataFrame, labels_at: DataFrame) -> DataFrame:
    """Per graph with a node: defects, crossings, overlap, bends, length, area.

    A defect is a diagonal segment, a segment inside a node, a route that goes back over itself, a label over another
    or over a node, or a route through another edge's label.
    """
    routes, at = written(routes, "routes"), written(labels_at, "labels")  # each is read by several measures
    per = quality.route_measures(routes)
    faults = [quality.node_hits(routes, nodes), quality.self_retraces(routes), labels.label_overlaps(at), labels.labels_over_nodes(at, nodes), labels.label_hits(routes, at)]
    counted = per.select("graph_id", F.col("diagonals").cast("long").alias("n"))
    for f in faults:
        counted = counted.unionByName(f.select("graph_id", F.lit(1).cast("long").alias("n")))
    sums = per.groupBy("graph_id").agg(F.sum("bends").alias("bends"), F.round(F.sum("length"), 6).alias("length"))
    box = quality.boxes(nodes).drop("node_id").unionByName(quality.route_segments(routes).drop("edge_id", "k")).unionByName(at.drop("edge_id"))
    out = box.groupBy("graph_id").agg(F.expr("(max(x2) - min(x1)) * (max(y2) - min(y1))").alias("area"))
    for part in (counted.groupBy("graph_id").agg(F.sum("n").alias("defects")), quality.crossings_off_terminals(routes, edges, nodes), routing.shared_lengths(routes), sums):
        out = out.join(part, "graph_id", "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return out.select("graph_id", none("defects", "long"), none("crossings", "long"), none("overlap", "double"), none("bends", "long"), none("length", "double"), "area")


def proper_crossings(routes: DataFrame) -> DataFrame:
    """Per graph, pairs of segments of different routes, of any direction, that cross inside both."""
    s = routes.select("graph_id", "edge_id", F.posexplode(g.segments(F.col("points"))).alias("k", "s"))
    ends = [F.col(f"s.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"]
    s = s.select("graph_id", "edge_id", *ends).selectExpr("*", "least(ax, bx) as x1", "greatest(ax, bx) as x2", "least(ay, by) as y1", "greatest(ay, by) as y2")
    side = lambda a, b, c: f"(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"
    a, b, c, d = ("ax", "ay"), ("bx", "by"), ("ax_b", "ay_b"), ("bx_b", "by_b")
    cross = F.expr(f"edge_id < edge_id_b and {side(a, b, c)} * {side(a, b, d)} < 0 and {side(c, d, a)} * {side(c, d, b)} < 0")
    return quality.grid_join(s, quality._suffixed(s), cross).groupBy("graph_id").agg(F.count("*").alias("crossings"))


def box_overlaps(nodes: DataFrame, labels_at: DataFrame) -> DataFrame:
    """Per graph, pairs of boxes that overlap, whether of nodes or of labels."""
    sides = ("x1", "x2", "y1", "y2")
    every = quality.boxes(nodes).select("graph_id", F.concat(F.lit("n"), "node_id").alias("box"), *sides)
    every = every.unionByName(labels_at.select("graph_id", F.concat(F.lit("e"), "edge_id").alias("box"), *sides))
    met = quality.grid_join(every, quality._suffixed(every), F.expr("box < box_b and x1 < x2_b and x1_b < x2 and y1 < y2_b and y1_b < y2"))
    return met.groupBy("graph_id").agg(F.count("*").alias("overlaps"))


def path_faults(paths: DataFrame, nodes: DataFrame, axis: str = "x", backwards: bool = False) -> DataFrame:
    """Per graph, neighbours on its path (graph_id, k, node_id) of which the second doesn't lie further along the axis;
    a node that isn't there makes a fault with each neighbour."""
    p = paths.join(nodes.select("graph_id", "node_id", F.col(axis).alias("at")), ["graph_id", "node_id"], "left")
    by = Window.partitionBy("graph_id").orderBy("k")
    ahead = (F.col("at") - F.lag("at").over(by)) * (-1 if backwards else 1) > 0
    steps = p.select("graph_id", F.row_number().over(by).alias("n"), ahead.alias("ahead")).where("n > 1 and not coalesce(ahead, false)")
    return steps.groupBy("graph_id").agg(F.count("*").alias("path_order"))


def statechart_scores(nodes: DataFrame, edges: DataFrame, routes: DataFrame, labels_at: DataFrame, paths: DataFrame) -> DataFrame:
    """Per flat graph: invalid (sizes or places that are no numbers, edges without a route, points that are none),
    overlaps of nodes and labels, faults of the path, proper crossings, inner points and length of routes."""
    routes, at = written(routes, "routes"), written(labels_at, "labels")
    number = lambda c: f"({c} is not null and not isnan({c}) and abs({c}) < double('Infinity'))"
    bad = nodes.where(f"not ({' and '.join(map(number, ('x', 'y', 'width', 'height')))} and width >= 0 and height >= 0)").select("graph_id")
    bare = edges.join(routes, ["graph_id", "edge_id"], "left_anti").select("graph_id")
    astray = routes.select("graph_id", F.explode("points").alias("p")).where(f"not ({number('p.x')} and {number('p.y')})").select("graph_id")
    invalid = bad.unionAll(bare).unionAll(astray).groupBy("graph_id").agg(F.count("*").alias("invalid"))
    p = F.col("points")
    drawn = routes.groupBy("graph_id").agg(F.sum(F.size(p) - 2).alias("bends"), F.round(F.sum(g.path_length(p)), 6).alias("length"))
    out = nodes.select("graph_id").distinct()
    for part in (invalid, box_overlaps(nodes, at), path_faults(paths, nodes), proper_crossings(routes), drawn):
        out = out.join(part, "graph_id", "left")
    return out.na.fill(0)

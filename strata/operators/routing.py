"""Edge routes as set operations: octilinear, parallel, self-loop, fan and bus routes, affected edges, updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import quality


def edge_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the centres (sx, sy, tx, ty) of both nodes and the source's box (nx, ny, sw, sh)."""
    at = nodes.select("graph_id", "node_id", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"), "x", "y", "width", "height")
    source = at.withColumnsRenamed({"node_id": "source_id", "cx": "sx", "cy": "sy", "x": "nx", "y": "ny", "width": "sw", "height": "sh"})
    target = at.select("graph_id", F.col("node_id").alias("target_id"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    return edges.join(source, ["graph_id", "source_id"]).join(target, ["graph_id", "target_id"])


def octilinear_routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """From centre to centre: a diagonal first, then along an axis."""
    e = edge_ends(nodes, edges.where("source_id <> target_id"))
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    m = F.least(F.abs(dx), F.abs(dy))
    turn = g.point(F.col("sx") + F.signum(dx) * m, F.col("sy") + F.signum(dy) * m)
    return e.select("graph_id", "edge_id", F.array(g.point(F.col("sx"), F.col("sy")), turn, g.point(F.col("tx"), F.col("ty"))).alias("points"))


def parallel_lanes(nodes: DataFrame, edges: DataFrame, spacing: float = 12.0) -> DataFrame:
    """Edges between the same two nodes, in either direction, side by side: lane offset and the middle of the route.

    Offsets are symmetric about the line of the centres and measured across the direction from the lesser node id.
    """
    e = edge_ends(nodes, edges.where("source_id <> target_id"))
    pair = ["graph_id", F.least("source_id", "target_id"), F.greatest("source_id", "target_id")]
    k, n = F.row_number().over(Window.partitionBy(*pair).orderBy("ord")), F.count("*").over(Window.partitionBy(*pair))
    e = e.withColumn("lane", (k - 1 - (n - 1) / 2) * spacing)
    way = F.when(F.col("source_id") < F.col("target_id"), 1.0).otherwise(-1.0)
    dx, dy = (F.col("tx") - F.col("sx")) * way, (F.col("ty") - F.col("sy")) * way
    far = F.sqrt(dx * dx + dy * dy)
    ax, ay = F.when(far > 0, -dy / far).otherwise(0.0), F.when(far > 0, dx / far).otherwise(1.0)
    mid = g.point((F.col("sx") + F.col("tx")) / 2 + ax * F.col("lane"), (F.col("sy") + F.col("ty")) / 2 + ay * F.col("lane"))
    return e.select("graph_id", "edge_id", "lane", mid.alias("mid"))


def self_loops(nodes: DataFrame, edges: DataFrame, extent: float = 20.0) -> DataFrame:
    """Loops at the right side of their node, the k-th one k times as far out."""
    e = edge_ends(nodes, edges.where("source_id = target_id"))
    k = F.row_number().over(Window.partitionBy("graph_id", "source_id").orderBy("ord"))
    right, out, up, low = F.col("nx") + F.col("sw"), F.col("nx") + F.col("sw") + k * extent, F.col("sy") - F.col("sh") / 4, F.col("sy") + F.col("sh") / 4
    return e.select("graph_id", "edge_id", F.array(g.point(right, up), g.point(out, up), g.point(out, low), g.point(right, low)).alias("points"))


def fan_anchors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Where edges leave their source: spread over the side that faces the target, in the order of the targets."""
    e = edge_ends(nodes, edges.where("source_id <> target_id")).withColumn("right", F.col("tx") >= F.col("sx"))
    side = Window.partitionBy("graph_id", "source_id", "right")
    part = F.row_number().over(side.orderBy("ty", "tx", "ord")) / (F.count("*").over(side) + 1)
    x = F.when(F.col("right"), F.col("nx") + F.col("sw")).otherwise(F.col("nx"))
    return e.select("graph_id", "edge_id", x.alias("x"), (F.col("ny") + F.col("sh") * part).alias("y"))


def bus_trunks(nodes: DataFrame, edges: DataFrame, gap: float = 20.0) -> DataFrame:
    """One vertical trunk for all edges of a source, right of it, over the span of its ends."""
    e = edge_ends(nodes, edges.where("source_id <> target_id"))
    t = e.groupBy("graph_id", "source_id").agg(F.first(F.col("nx") + F.col("sw") + gap).alias("trunk_x"), F.min(F.least("sy", "ty")).alias("low"), F.max(F.greatest("sy", "ty")).alias("high"), F.count("*").alias("branches"))
    return t.select("graph_id", F.col("source_id").alias("node_id"), "trunk_x", "low", "high", "branches")


def affected_edges(routes: DataFrame, edges: DataFrame, moved: DataFrame, clearance: float = 8.0) -> DataFrame:
    """(graph_id, edge_id, incident): edges of moved nodes, and edges whose route comes within ``clearance`` of one.

    ``moved``: node boxes (graph_id, node_id, x, y, width, height), a row for the old and one for the new place.
    """
    ids = moved.select("graph_id", "node_id").distinct()
    own = edges.join(ids.withColumnRenamed("node_id", "source_id"), ["graph_id", "source_id"], "left_semi").select("graph_id", "edge_id")
    own = own.unionByName(edges.join(ids.withColumnRenamed("node_id", "target_id"), ["graph_id", "target_id"], "left_semi").select("graph_id", "edge_id"))
    fat = moved.select("graph_id", (F.col("x") - clearance).alias("x1_b"), (F.col("x") + F.col("width") + clearance).alias("x2_b"), (F.col("y") - clearance).alias("y1_b"), (F.col("y") + F.col("height") + clearance).alias("y2_b"))
    near = quality.grid_join(quality.route_segments(routes), fat, F.expr("x1 <= x2_b and x2 >= x1_b and y1 <= y2_b and y2 >= y1_b"))
    both = own.withColumn("incident", F.lit(True)).unionByName(near.select("graph_id", "edge_id").withColumn("incident", F.lit(False)))
    return both.groupBy("graph_id", "edge_id").agg(F.max("incident").alias("incident"))


def update_routes(routes: DataFrame, nodes: DataFrame, edges: DataFrame, affected: DataFrame, router) -> DataFrame:
    """Routes after a change: ``router(nodes, edges)`` for affected edges only; the others are kept as they are."""
    again = router(nodes, edges.join(affected, ["graph_id", "edge_id"], "left_semi"))
    return routes.join(affected, ["graph_id", "edge_id"], "left_anti").unionByName(again)


def route_patches(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed routes alone: (graph_id, edge_id, op, points); a removed route has no points."""
    b = before.select("graph_id", "edge_id", F.col("points").alias("was"))
    both = b.join(after.select("graph_id", "edge_id", "points"), ["graph_id", "edge_id"], "full_outer").where("not was <=> points")
    return both.select("graph_id", "edge_id", F.when(F.col("was").isNull(), "add").when(F.col("points").isNull(), "remove").otherwise("update").alias("op"), "points")


def shared_lengths(routes: DataFrame) -> DataFrame:
    """Per graph, the length that segments of different routes share on one axis-parallel line."""
    s = quality.route_segments(routes)
    b = s.select("graph_id", *[F.col(c).alias(f"{c}_b") for c in s.columns if c != "graph_id"])
    line = F.expr(f"edge_id < edge_id_b and ((y1 = y2 and y1_b = y2_b and y1 = y1_b and least(x2, x2_b) - greatest(x1, x1_b) > {g.EPS}) or (x1 = x2 and x1_b = x2_b and x1 = x1_b and least(y2, y2_b) - greatest(y1, y1_b) > {g.EPS}))")
    span = F.expr("least(x2, x2_b) - greatest(x1, x1_b) + least(y2, y2_b) - greatest(y1, y1_b)")
    return quality.grid_join(s, b, line).groupBy("graph_id").agg(F.round(F.sum(span), 6).alias("overlap"))


def better(candidate: Column, best: Column, measures: list[str], loose: set[str], tolerance: float = 0.02) -> Column:
    """The first measure that differs decides; ``loose`` ones differ only beyond the tolerance.  Not transitive."""
    out = F.lit(False)
    for m in reversed(measures):
        a, b = candidate[m], best[m]
        differs = F.abs(a - b) > F.greatest(F.abs(a), F.abs(b)) * tolerance if m in loose else a != b
        out = F.when(differs, a < b).otherwise(out)
    return out


def best_candidate(measured: DataFrame, measures: list[str], loose: set[str]) -> DataFrame:
    """(graph_id, candidate, measures...) -> the winner of a fold over candidates in their order."""
    listed = measured.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("candidate", *measures))).alias("l"))
    rest = F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))
    best = F.aggregate(rest, F.element_at("l", 1), lambda b, c: F.when(better(c, b, measures, loose), c).otherwise(b))
    return listed.select("graph_id", best["candidate"].alias("candidate"))


def rejoined(pieces: DataFrame) -> DataFrame:
    """Pieces of routes (graph_id, edge_id, piece, points), in their order, as one route without superfluous points."""
    r = pieces.groupBy("graph_id", "edge_id").agg(F.array_sort(F.collect_list(F.struct("piece", "points"))).alias("l"))
    return r.select("graph_id", "edge_id", g.simplify(F.flatten("l.points")).alias("points"))


def update_counts(before: DataFrame, after: DataFrame, affected: DataFrame) -> DataFrame:
    """Per graph: routes after an update, how many of them were looked at again, kept unseen, and came out changed."""
    was = before.select("graph_id", "edge_id", F.col("points").alias("was"))
    seen = affected.select("graph_id", "edge_id").distinct().withColumn("seen", F.lit(True))
    both = after.join(was, ["graph_id", "edge_id"], "left").join(seen, ["graph_id", "edge_id"], "left")
    many = lambda c: F.count_if(c)
    return both.groupBy("graph_id").agg(F.count("*").alias("routed"), many(F.col("seen").isNotNull()).alias("affected"), many(F.col("seen").isNull()).alias("reused"), many(~F.col("points").eqNullSafe(F.col("was"))).alias("changed"))

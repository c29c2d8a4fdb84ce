"""Joins by place: nearest neighbour along an axis, segments that get in each other's way, parts outside of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import quality

EPS = g.EPS


def nearest_before(nodes: DataFrame, spacing: float = 0.0) -> DataFrame:
    """For each node the one before it along x, by middles, whose extent in y meets its own (``spacing`` wider): the
    constraint that a scan line finds.  Ties go to the greater node id; nodes without one are left out."""
    b = quality.boxes(nodes).withColumn("c", (F.col("x1") + F.col("x2")) / 2)
    lane = b.withColumns({"y1": F.col("y1") - spacing / 2, "y2": F.col("y2") + spacing / 2})
    left = F.min("x1").over(Window.partitionBy("graph_id"))
    # A node looks from the left end of its graph up to its own middle; grid levels keep long looks short of rows.
    look = lane.withColumns({"x2": F.col("c"), "x1": left})
    here = lane.withColumns({"x1": F.col("c"), "x2": F.col("c")})
    met = quality.grid_join(look, quality._suffixed(here), F.expr("node_id <> node_id_b and y1 < y2_b and y1_b < y2 and (c_b < c or (c_b = c and node_id_b < node_id))"))
    return met.groupBy("graph_id", "node_id").agg(F.max(F.struct("c_b", "node_id_b"))["node_id_b"].alias("before_id"))


def segment_conflicts(routes: DataFrame, spacing: float) -> DataFrame:
    """Pairs of routes with parallel segments nearer than ``spacing`` side by side: length of the stretches they share."""
    s = quality.route_segments(routes).where(f"x2 - x1 > {EPS} or y2 - y1 > {EPS}")
    wide = s.withColumns({"x1": F.col("x1") - spacing, "x2": F.col("x2") + spacing, "y1": F.col("y1") - spacing, "y2": F.col("y2") + spacing})
    other = quality._suffixed(s)
    flat = f"y2 - y1 < {2 * spacing} + {EPS} and y2_b - y1_b < {EPS} and x2 - x1 > {2 * spacing} + {EPS} and x2_b - x1_b > {EPS} and abs((y1 + y2) / 2 - y1_b) < {spacing}"
    tall = f"x2 - x1 < {2 * spacing} + {EPS} and x2_b - x1_b < {EPS} and y2 - y1 > {2 * spacing} + {EPS} and y2_b - y1_b > {EPS} and abs((x1 + x2) / 2 - x1_b) < {spacing}"
    along_x = F.least(F.col("x2") - spacing, F.col("x2_b")) - F.greatest(F.col("x1") + spacing, F.col("x1_b"))
    along_y = F.least(F.col("y2") - spacing, F.col("y2_b")) - F.greatest(F.col("y1") + spacing, F.col("y1_b"))
    met = quality.grid_join(wide, other, F.expr(f"edge_id < edge_id_b and (({flat}) or ({tall}))"))
    shared = met.select("graph_id", "edge_id", F.col("edge_id_b").alias("other_id"), F.when(F.expr(flat), along_x).otherwise(along_y).alias("n")).where(f"n > {EPS}")
    return shared.groupBy("graph_id", "edge_id", "other_id").agg(F.sum("n").alias("shared"))


def outside_nodes(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Length of each axis-parallel segment that is outside the open interiors of all nodes: its extent less the union
    of what they cover of it."""
    s = quality.route_segments(routes)
    crossed = F.expr(f"(y1 = y2 and x2 > x1 and y1 > y1_b + {EPS} and y1 < y2_b - {EPS} and x1 < x2_b and x1_b < x2) or (x1 = x2 and y2 > y1 and x1 > x1_b + {EPS} and x1 < x2_b - {EPS} and y1 < y2_b and y1_b < y2)")
    met = quality.grid_join(s, quality._suffixed(quality.boxes(nodes)), crossed)
    part = F.when(F.expr("y1 = y2"), F.struct(F.greatest("x1", "x1_b").alias("a"), F.least("x2", "x2_b").alias("b"))).otherwise(F.struct(F.greatest("y1", "y1_b").alias("a"), F.least("y2", "y2_b").alias("b")))
    parts = met.groupBy("graph_id", "edge_id", "k").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(float("-inf")).alias("upto"))
    step = lambda a, p: F.struct((a["n"] + F.greatest(F.lit(0.0), p["b"] - F.greatest(p["a"], a["upto"]))).alias("n"), F.greatest(a["upto"], p["b"]).alias("upto"))
    covered = F.aggregate("parts", start, step, lambda a: a["n"])
    out = s.join(parts, ["graph_id", "edge_id", "k"], "left")
    return out.select("graph_id", "edge_id", "k", (F.col("x2") - F.col("x1") + F.col("y2") - F.col("y1") - F.coalesce(covered, F.lit(0.0))).alias("outside"))


def on_routes(points: DataFrame, routes: DataFrame) -> DataFrame:
    """Points (graph_id, point_id, x, y) that lie on a segment of a route, once a point and route."""
    s = routes.select("graph_id", "edge_id", F.explode(g.segments(F.col("points"))).alias("s")).select("graph_id", "edge_id", *[F.col(f"s.{e}.{c}").alias(e + c) for e in "ab" for c in "xy"])
    s = s.withColumns({"x1": F.least("ax", "bx"), "x2": F.greatest("ax", "bx"), "y1": F.least("ay", "by"), "y2": F.greatest("ay", "by")})
    p = points.select("graph_id", "point_id", F.col("x").alias("x1_b"), F.col("x").alias("x2_b"), F.col("y").alias("y1_b"), F.col("y").alias("y2_b"))
    on = F.expr(f"x1_b between x1 - {EPS} and x2 + {EPS} and y1_b between y1 - {EPS} and y2 + {EPS} and abs((bx - ax) * (y1_b - ay) - (by - ay) * (x1_b - ax)) < {EPS}")
    return quality.grid_join(s, p, on).select("graph_id", "point_id", "edge_id").distinct()

"""Labels on routes: where they lie, what they cover, and which other routes run through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import quality

EPS = g.EPS
_STRICT = f"x1 < x2_b - {EPS} and x2 > x1_b + {EPS} and y1 < y2_b - {EPS} and y2 > y1_b + {EPS}"


def centred_labels(routes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boxes (graph_id, edge_id, x1, x2, y1, y2) of labels (graph_id, edge_id, width, height) at their routes' middles."""
    at = routes.select("graph_id", "edge_id", g.midpoint(F.col("points")).alias("m")).join(sizes, ["graph_id", "edge_id"])
    side = lambda c, size, sign: (F.col(f"m.{c}") + sign * F.col(size) / 2).alias(f"{c}{1 if sign < 0 else 2}")
    return at.select("graph_id", "edge_id", side("x", "width", -1), side("x", "width", 1), side("y", "height", -1), side("y", "height", 1))


def label_overlaps(labels: DataFrame) -> DataFrame:
    """Pairs of labels of a graph that cover each other."""
    met = quality.grid_join(labels, quality._suffixed(labels), F.expr(f"edge_id < edge_id_b and {_STRICT}"))
    return met.select("graph_id", "edge_id", F.col("edge_id_b").alias("other_id"))


def labels_over_nodes(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels that cover a node."""
    met = quality.grid_join(labels, quality._suffixed(quality.boxes(nodes)), F.expr(_STRICT))
    return met.select("graph_id", "edge_id", F.col("node_id_b").alias("node_id"))


def label_hits(routes: DataFrame, labels: DataFrame) -> DataFrame:
    """Routes with an axis-parallel segment inside another edge's label, once a route and label."""
    inside = f"(y1 = y2 and y1 > y1_b + {EPS} and y1 < y2_b - {EPS} and least(x2, x2_b) - greatest(x1, x1_b) > {EPS}) or (x1 = x2 and x1 > x1_b + {EPS} and x1 < x2_b - {EPS} and least(y2, y2_b) - greatest(y1, y1_b) > {EPS})"
    met = quality.grid_join(quality.route_segments(routes), quality._suffixed(labels), F.expr(f"edge_id <> edge_id_b and ({inside})"))
    return met.select("graph_id", "edge_id", F.col("edge_id_b").alias("label_of")).distinct()

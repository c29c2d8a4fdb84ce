"""Compound drawings: scopes are arranged from the deepest up, each container as large as what it holds.

A loop over depths; all scopes of a depth are arranged at once, as graphs of their own, by any arrangement of
tables.  Edges between scopes take part where their ends' ways to the root part: in the scope that holds both, between the
two of its children that hold one end each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import graph as G

_ROOT = ""  # the scope of nodes without parent
_MARK = "\u001f"


def lineage(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, child_id, scope): for each node, itself and its ancestors, each with the scope it stands in."""
    own = nodes.select("graph_id", "node_id", F.col("node_id").alias("child_id"))
    up = own.unionByName(G.closure(nodes).select("graph_id", "node_id", F.col("ancestor_id").alias("child_id")))
    return up.join(nodes.select("graph_id", F.col("node_id").alias("child_id"), F.coalesce("parent_id", F.lit(_ROOT)).alias("scope")), ["graph_id", "child_id"])


def scope_edges(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, scope, source_id, target_id, ord, weight, members): edges as they are seen between a scope's children.

    An edge is seen in the one scope where its ends have different children; an edge from a container into itself
    in none.  Edges between the same two children are one, of summed weight and the first one's order.
    """
    s = lines.select("graph_id", F.col("node_id").alias("source_id"), F.col("child_id").alias("from_id"), "scope")
    t = lines.select("graph_id", F.col("node_id").alias("target_id"), F.col("child_id").alias("to_id"), "scope")
    seen = edges.join(s, ["graph_id", "source_id"]).join(t, ["graph_id", "target_id", "scope"]).where("from_id <> to_id")
    seen = seen.groupBy("graph_id", "scope", F.col("from_id").alias("source_id"), F.col("to_id").alias("target_id"))
    return seen.agg(F.min("ord").alias("ord"), F.sum("weight").alias("weight"), F.count("*").alias("members"))


def compound_places(nodes: DataFrame, edges: DataFrame, arrange: Callable[[DataFrame, DataFrame], DataFrame], padding: float = 12.0, header: float = 0.0) -> DataFrame:
    """(graph_id, node_id, parent_id, x, y, width, height): places relative to the parent's corner.

    ``arrange`` takes nodes and edges and returns (graph_id, node_id, x, y).  A container gets ``padding`` around its
    children and a ``header`` above them, and is at least as large as it was.  A node whose parent isn't there stands in the root.
    """
    ids = nodes.select("graph_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    nodes = nodes.join(ids, ["graph_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("there"), F.col("parent_id"))).drop("there")
    nodes = written(nodes.select("graph_id", "node_id", "parent_id", "ord", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")), "scopes")
    lines = written(lineage(nodes), "lines")
    deep = lines.groupBy("graph_id", "node_id").agg((F.count("*") - 1).alias("depth"))
    nodes = written(nodes.join(deep, ["graph_id", "node_id"]).withColumn("scope", F.coalesce("parent_id", F.lit(_ROOT))), "scopes")
    seen = written(scope_edges(lines, edges), "seen")
    key = F.concat("graph_id", F.lit(_MARK), "scope").alias("graph_id")
    done: DataFrame | None = None
    sizes: DataFrame | None = None
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, -1, -1):
        kids = nodes.where(F.col("depth") == depth)
        if sizes is not None:
            kids = kids.join(sizes.withColumnRenamed("scope", "node_id"), ["graph_id", "node_id"], "left")
            kids = kids.withColumns({"width": F.greatest("width", F.coalesce("w", F.lit(0.0))), "height": F.greatest("height", F.coalesce("h", F.lit(0.0)))})
        kids = written(kids.select("graph_id", "node_id", "parent_id", "scope", "ord", "width", "height"), "kids")
        inner = seen.join(kids.select("graph_id", "scope").distinct(), ["graph_id", "scope"], "left_semi")
        rows = kids.select(key, "node_id", F.lit(None).cast("string").alias("parent_id"), "ord", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "width", "height")
        flow = written(inner.select(key, F.concat("source_id", F.lit(">"), "target_id").alias("edge_id"), "source_id", "target_id", "ord", "weight"), "flow")
        at = arrange(rows, flow).select(F.split("graph_id", _MARK)[0].alias("graph_id"), F.split("graph_id", _MARK)[1].alias("scope"), "node_id", "x", "y")
        at = written(kids.join(at, ["graph_id", "scope", "node_id"]), "at")
        extent = at.groupBy("graph_id", "scope").agg(*[F.min(c).alias(f"{c}0") for c in "xy"], F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))
        placed = at.join(extent, ["graph_id", "scope"]).select("graph_id", "node_id", "parent_id", (F.col("x") - F.col("x0") + padding).alias("x"), (F.col("y") - F.col("y0") + padding + header).alias("y"), "width", "height")
        done = placed if done is None else done.unionByName(placed)
        sizes = extent.select("graph_id", "scope", (F.col("x1") - F.col("x0") + 2 * padding).alias("w"), (F.col("y1") - F.col("y0") + 2 * padding + header).alias("h"))
    return done


def world_boxes(placed: DataFrame) -> DataFrame:
    """(graph_id, node_id, x, y, width, height) of ``compound_places`` in the drawing's own coordinates."""
    world = G.world_frames(placed)
    return placed.drop("x", "y").join(world, ["graph_id", "node_id"]).select("graph_id", "node_id", F.col("world_x").alias("x"), F.col("world_y").alias("y"), "width", "height")

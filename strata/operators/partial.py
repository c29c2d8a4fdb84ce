"""Arrangement of a selection alone: what isn't selected stays, and the selection moves as little as it must.

The selected nodes of one parent are arranged as a graph of their own, put where they began, and slid along x or y to the nearest
place free of all other nodes.  Where a slide can't end is a set of intervals, one for each pair of a selected and another node that
meet across the slide; their unions leave at most one place on each side, so the nearest one is found by a window over
sorted intervals, without trying offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from . import graph as G
from . import quality, routing

_FAR = 1e18
_MARK = "\u001f"
_SIZE = {"x": "width", "y": "height"}


def problems(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """(graph_id, id, problem): selected nodes that aren't there or hold others, and fixed ones without a finite place."""
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < {_FAR}" for c in ("x", "y", "width", "height"))
    known, chosen = nodes.select("graph_id", "node_id"), selected.select("graph_id", "node_id").distinct()
    tell = lambda df, text: df.select("graph_id", F.col("node_id").alias("id"), F.lit(text).alias("problem"))
    unknown = tell(chosen.join(known, ["graph_id", "node_id"], "left_anti"), "unknown selected node")
    parents = nodes.where("parent_id is not null").select("graph_id", F.col("parent_id").alias("node_id"))
    holders = tell(chosen.join(parents, ["graph_id", "node_id"], "left_semi"), "selected node holds others")
    placeless = tell(nodes.where(f"not ({finite})").join(chosen, ["graph_id", "node_id"], "left_anti"), "no finite place")
    return unknown.unionByName(holders).unionByName(placeless)


def _slide(group: DataFrame, others: DataFrame, axis: str, gap: float) -> DataFrame:
    """(graph_id, offset): ends of the union of intervals that 0 is inside of, and 0 where it is in none.  Groups are one a graph."""
    other, size, across = "xy".replace(axis, ""), _SIZE[axis], _SIZE["xy".replace(axis, "")]
    o = others.select("graph_id", *[F.col(c).alias(f"o_{c}") for c in ("x", "y", "width", "height")])
    met = group.join(o, "graph_id").where(f"{other} < o_{other} + o_{across} + {gap} and o_{other} < {other} + {across} + {gap}")
    barred = met.select("graph_id", F.expr(f"o_{axis} - {gap} - {axis} - {size}").alias("low"), F.expr(f"o_{axis} + o_{size} + {gap} - {axis}").alias("high"))
    bounds = group.where(f"p_{axis} is not null").groupBy("graph_id").agg((F.max(f"p_{axis}") - F.min(axis)).alias("first"), F.min(F.expr(f"p_{axis} + p_{size}")).alias("end"), F.max(F.expr(f"{axis} + {size}")).alias("right"))
    bounds = bounds.select("graph_id", F.inline(F.array(F.struct(F.lit(-_FAR).alias("low"), F.col("first").alias("high")), F.struct((F.col("end") - F.col("right")).alias("low"), F.lit(_FAR).alias("high")))))
    every = barred.unionByName(bounds)
    by = Window.partitionBy("graph_id").orderBy("low", "high")
    reach = F.max("high").over(by.rowsBetween(Window.unboundedPreceding, -1))
    every = every.withColumn("new", F.coalesce((F.col("low") >= reach).cast("int"), F.lit(1)))
    unions = every.withColumn("island", F.sum("new").over(by)).groupBy("graph_id", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < 0 and high > 0")
    ends = unions.select("graph_id", F.explode(F.array("low", "high")).alias("offset"), F.lit(True).alias("barred"))
    rows = group.select("graph_id").distinct().join(ends, "graph_id", "left")
    return rows.select("graph_id", F.lit(axis).alias("axis"), F.coalesce("offset", F.lit(0.0)).alias("offset"), F.col("barred").isNotNull().alias("barred")).where(f"abs(offset) < {_FAR}")


def partial_places(nodes: DataFrame, edges: DataFrame, selected: DataFrame, arrange: Callable[[DataFrame, DataFrame], DataFrame], gap: float = 20.0) -> DataFrame:
    """(graph_id, node_id, x, y, width, height, status) of all nodes, in world places, after the selection is arranged.

    status: ``fixed``; ``placed``; ``blocked`` where no place was found inside the parent (the node stays where it was).
    Of equally near places, those along x go first, then those to the right or below.  Selections of several parents follow one another,
    in order of parents, and later ones see where earlier ones went.  Nodes told by ``problems`` are left as they are.
    """
    wrong = problems(nodes, selected).select("graph_id", F.col("id").alias("node_id")).distinct()
    chosen = selected.select("graph_id", "node_id").distinct().join(wrong, ["graph_id", "node_id"], "left_anti").withColumn("chosen", F.lit(True))
    base = nodes.select("graph_id", "node_id", "parent_id", "ord", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]).join(chosen, ["graph_id", "node_id"], "left")
    turn = F.when(F.col("chosen"), F.dense_rank().over(Window.partitionBy("graph_id", "chosen").orderBy(F.col("parent_id").asc_nulls_first())))
    now = written(base.withColumn("turn", turn).withColumn("status", F.lit("fixed")).drop("chosen"), "partial")
    above = written(G.closure(now).select("graph_id", "node_id", "ancestor_id"), "above")
    edges = written(edges.select("graph_id", "edge_id", "source_id", "target_id", "ord", "weight"), "edges")
    for k in range(1, (now.agg(F.max("turn")).first()[0] or 0) + 1):
        group = written(now.where(F.col("turn") == k), "group")
        ids = group.select("graph_id", "node_id")
        inner = edges.join(ids.withColumnRenamed("node_id", "source_id"), ["graph_id", "source_id"], "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), ["graph_id", "target_id"], "left_semi")
        at = arrange(group.withColumn("parent_id", F.lit(None).cast("string")), inner).select("graph_id", "node_id", F.col("x").alias("ax"), F.col("y").alias("ay"))
        corner = Window.partitionBy("graph_id")
        there = group.join(at, ["graph_id", "node_id"])
        there = there.withColumns({c: F.col(f"a{c}") - F.min(f"a{c}").over(corner) + F.min(c).over(corner) for c in "xy"}).drop("ax", "ay")
        holder = now.select("graph_id", F.col("node_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in ("x", "y", "width", "height")])
        there = written(there.join(holder, ["graph_id", "parent_id"], "left"), "proposed")
        around = above.join(ids, ["graph_id", "node_id"], "left_semi").select("graph_id", F.col("ancestor_id").alias("node_id")).distinct()
        others = written(now.join(ids, ["graph_id", "node_id"], "left_anti").join(around, ["graph_id", "node_id"], "left_anti").join(ids.select("graph_id").distinct(), "graph_id", "left_semi"), "others")
        slides = [_slide(there, others, axis, gap) for axis in "xy"]
        # A slide along one axis helps only where the group fits its parent along the other.
        fits = {c: there.groupBy("graph_id").agg(F.coalesce(F.bool_and(F.expr(f"{c} >= p_{c} and {c} + {_SIZE[c]} <= p_{c} + p_{_SIZE[c]}")), F.lit(True)).alias("fits")).where("fits").select("graph_id") for c in "xy"}
        moves = slides[0].join(fits["y"], "graph_id", "left_semi").unionByName(slides[1].join(fits["x"], "graph_id", "left_semi"))
        best = moves.groupBy("graph_id").agg(F.min(F.struct(F.abs("offset").alias("n"), "axis", (-F.col("offset")).alias("o"))).alias("b"))
        moved = there.join(best, "graph_id", "left").select("graph_id", "node_id", F.when(F.col("b.axis") == "x", F.col("x") - F.col("b.o")).otherwise(F.col("x")).alias("nx"), F.when(F.col("b.axis") == "y", F.col("y") - F.col("b.o")).otherwise(F.col("y")).alias("ny"), F.col("b").isNotNull().alias("found"))
        joined = now.join(moved, ["graph_id", "node_id"], "left")
        place = lambda c: F.when(F.col("found"), F.col(f"n{c}")).otherwise(F.col(c)).alias(c)
        status = F.when(F.col("found"), "placed").when(F.col("found").isNotNull(), "blocked").otherwise(F.col("status"))
        now = written(joined.select("graph_id", "node_id", "parent_id", "ord", place("x"), place("y"), "width", "height", "turn", status.alias("status")), "partial")
    return now.select("graph_id", "node_id", "x", "y", "width", "height", "status")


def repaired_routes(before: DataFrame, after: DataFrame, edges: DataFrame, routes: DataFrame, router: Callable[[DataFrame, DataFrame], DataFrame] = quality.elbow_routes, clearance: float = 0.0) -> DataFrame:
    """``routes`` after nodes moved from ``before`` to ``after``: those of moved nodes, and those that a moved node
    came in the way of, are drawn anew; the others are kept as they are."""
    was = before.select("graph_id", "node_id", F.col("x").alias("was_x"), F.col("y").alias("was_y"))
    moved = after.join(was, ["graph_id", "node_id"]).where("x <> was_x or y <> was_y").select("graph_id", "node_id", "x", "y", "width", "height")
    return routing.update_routes(routes, after, edges, routing.affected_edges(routes, edges, moved, clearance), router)

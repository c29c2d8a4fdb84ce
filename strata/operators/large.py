"""Components and longest-path layers of graphs that are too large for a task: joins and aggregates over written rounds.

Components: alternating large and small stars, rounds in the logarithm of the largest component.  Layers: all nodes without
predecessors left go at once, a round a layer; edges that left are gone from the next round's tables.  A round's tables are removed
when the next is written.  Callers send only graphs above a number of edges here; the others fit a task (``plans.runner``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import removed, written

_PAIR = ("graph_id", "a", "b")


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select("graph_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = pairs.unionByName(pairs.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("graph_id", "a").agg(F.min("b").alias("m")).select("graph_id", "a", F.least("a", "m").alias("m"))
    return _downward(both.where("b > a").join(least, ["graph_id", "a"]).select("graph_id", F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least of them."""
    least = pairs.groupBy("graph_id", "a").agg(F.min("b").alias("m"))
    others = pairs.join(least, ["graph_id", "a"]).select("graph_id", F.col("b").alias("a"), F.col("m").alias("b"))
    return _downward(others.unionByName(least.select("graph_id", "a", F.col("m").alias("b"))))


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 80) -> DataFrame:
    """(graph_id, node_id, component): the least ``ord`` of each node's component.  Direction, repeats, self-loops and edges with an
    end that is no node don't matter."""
    at = nodes.select("graph_id", "node_id", F.col("ord").cast("long").alias("o"))
    ends = edges.select("graph_id", "source_id", "target_id").distinct()
    ends = ends.join(at.withColumnsRenamed({"node_id": "source_id", "o": "a"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "o": "b"}), ["graph_id", "target_id"])
    now, said = written(_downward(ends.select(*_PAIR)), "stars"), None
    for _ in range(most_rounds):
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(*_PAIR).cast("decimal(38,0)"))).first())
        if seen == said or not seen[0]:
            roots = now.select("graph_id", F.col("a").alias("o"), F.col("b").alias("root"))
            return at.join(roots, ["graph_id", "o"], "left").select("graph_id", "node_id", F.coalesce("root", "o").alias("component"))
        after = written(_small_star(_large_star(now)), "stars")
        removed(now)
        now, said = after, seen
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def longest_path_layers(nodes: DataFrame, edges: DataFrame, from_sink: bool = False) -> DataFrame:
    """(graph_id, node_id, layer) by longest paths from sources; or sinks on the last layer and layers counted from them.
    Edges with an end that is no node don't matter; a cycle is an error."""
    s, t = ("target_id", "source_id") if from_sink else ("source_id", "target_id")
    have = nodes.select("graph_id", "node_id")
    arcs = edges.select("graph_id", F.col(s).alias("s"), F.col(t).alias("t")).distinct()
    for c in ("s", "t"):
        arcs = arcs.join(have.withColumnRenamed("node_id", c), ["graph_id", c], "left_semi")
    arcs, left, done, layer = written(arcs, "arcs"), written(have, "left"), None, 0
    while left.limit(1).count():
        held = arcs.select("graph_id", F.col("t").alias("node_id")).distinct()
        stay = written(left.join(held, ["graph_id", "node_id"], "left_semi"), "left")
        gone = written(left.join(stay, ["graph_id", "node_id"], "left_anti").withColumn("layer", F.lit(layer)), "layer")
        if not gone.limit(1).count():
            raise ValueError("edges form a cycle")
        rest = written(arcs.join(stay.withColumnRenamed("node_id", "s"), ["graph_id", "s"], "left_semi"), "arcs")
        removed(arcs, left)
        arcs, left, layer = rest, stay, layer + 1
        done = gone if done is None else done.unionByName(gone)
        if layer % 50 == 0:  # a plan of some fifty files at most
            done = written(done, "layers")
    if done is None:
        return have.withColumn("layer", F.lit(0))
    if not from_sink:
        return done
    last = done.groupBy("graph_id").agg(F.max("layer").alias("last"))
    return done.join(last, "graph_id").select("graph_id", "node_id", (F.col("last") - F.col("layer")).alias("layer"))


def by_size(nodes: DataFrame, edges: DataFrame, in_task, in_rounds, most: int = 200_000) -> DataFrame:
    """``in_task(nodes, edges)`` for graphs of at most ``most`` nodes and as many edges, ``in_rounds`` for the others; both give the same
    rows for a graph, so ``most`` decides nothing but where the work is done."""
    sizes = nodes.groupBy("graph_id").count().unionByName(edges.groupBy("graph_id").count())
    large = sizes.where(F.col("count") > most).select("graph_id").distinct()
    if not large.limit(1).count():
        return in_task(nodes, edges)
    large = written(large, "large")
    part = lambda df, how: df.join(large, "graph_id", how)
    return in_task(part(nodes, "left_anti"), part(edges, "left_anti")).unionByName(in_rounds(part(nodes, "left_semi"), part(edges, "left_semi")))

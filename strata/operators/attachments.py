"""What hangs on nodes: ports aligned along a side, and comments in rows beside the node that they comment on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aligned_ports(ports: DataFrame, sides: DataFrame, size: float = 8.0, spacing: float = 10.0) -> DataFrame:
    """Middles of ports (graph_id, node_id, side, index) along their side, by its ``alignment`` and ``extent``
    (graph_id, node_id, side, alignment, extent).

    BEGIN, CENTER and END keep the spacing at that end or the middle; JUSTIFIED spreads them from end to end, a single
    one in the middle; DISTRIBUTED parts the side evenly.  Another alignment is an error.
    """
    at = Window.partitionBy("graph_id", "node_id", "side")
    p = ports.join(sides, ["graph_id", "node_id", "side"]).withColumn("n", F.count("*").over(at))
    i, n, extent, kind = F.col("index"), F.col("n"), F.col("extent"), F.col("alignment")
    room = extent - (n * size + (n - 1) * spacing)
    run = i * (size + spacing) + size / 2
    justified = F.when(n == 1, extent / 2).otherwise(size / 2 + i * (extent - size) / (n - 1))
    along = F.when(kind == "BEGIN", run).when(kind == "END", room + run).when(kind == "CENTER", room / 2 + run).when(kind == "JUSTIFIED", justified).when(kind == "DISTRIBUTED", extent * (i + 1) / (n + 1))
    along = F.coalesce(along, F.raise_error(F.concat(F.lit("no alignment of ports: "), F.coalesce(kind, F.lit("null")))))
    return p.select("graph_id", "node_id", "side", "index", "alignment", along.alias("along"))


def comment_hosts(edges: DataFrame, comments: DataFrame) -> DataFrame:
    """(graph_id, node_id, host_id): of the nodes marked as comments (graph_id, node_id), those with one edge, and the
    node at its other end, unless that is a comment of this kind too."""
    ends = edges.select("graph_id", F.inline(F.array(F.struct(F.col("source_id").alias("node_id"), F.col("target_id").alias("host_id")), F.struct(F.col("target_id").alias("node_id"), F.col("source_id").alias("host_id")))))
    one = ends.join(comments.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi").groupBy("graph_id", "node_id").agg(F.count("*").alias("n"), F.min("host_id").alias("host_id")).where("n = 1")
    return one.select("graph_id", "node_id", "host_id").join(one.select("graph_id", F.col("node_id").alias("host_id")), ["graph_id", "host_id"], "left_anti").select("graph_id", "node_id", "host_id")


def comment_boxes(nodes: DataFrame, hosts: DataFrame, gap: float = 10.0) -> DataFrame:
    """Boxes of comments: those of a node go by turns above and below it, in authored order, each row centred on it."""
    c = nodes.select("graph_id", "node_id", "ord", "width", "height").join(hosts, ["graph_id", "node_id"])
    host = nodes.select("graph_id", F.col("node_id").alias("host_id"), F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("width").alias("hw"), F.col("height").alias("hh"))
    k = F.row_number().over(Window.partitionBy("graph_id", "host_id").orderBy("ord", "node_id"))
    c = c.withColumn("k", k).withColumn("above", F.col("k") % 2 == 1).join(host, ["graph_id", "host_id"])
    row = Window.partitionBy("graph_id", "host_id", "above")
    before = row.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    so_far, wide = F.coalesce(F.sum(F.col("width") + gap).over(before), F.lit(0.0)), F.sum(F.col("width") + gap).over(row) - gap
    y = F.when(F.col("above"), F.col("hy") - gap - F.col("height")).otherwise(F.col("hy") + F.col("hh") + gap)
    return c.select("graph_id", "node_id", "host_id", (F.col("hx") + F.col("hw") / 2 - wide / 2 + so_far).alias("x"), y.alias("y"), "width", "height")

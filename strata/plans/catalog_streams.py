"""Routes of the trade graphs kept by a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.graphs import TRADE_SQL, trade_graphs
from ..storage import shared_dir, written
from ..streaming import routes as R
from ..streaming.edges import run_available
from .catalog import query


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    """Boxes, then edges by weight, then every seventh nation moved, as three revisions."""
    n, e = (written(t, "trade") for t in trade_graphs(spark, d))
    box = [F.col(c) for c in ("x", "y", "width", "height")]
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    nodes = n.select("graph_id", F.lit(1).cast("long").alias("revision"), F.lit("node").alias("op"), F.col("node_id").alias("id"), *none("source_id", "target_id"), F.lit(None).cast("int").alias("priority"), *box)
    edges = e.select("graph_id", F.lit(2).cast("long").alias("revision"), F.lit("edge").alias("op"), F.col("edge_id").alias("id"), "source_id", "target_id", F.col("weight").cast("int").alias("priority"), *[F.lit(None).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    moved = nodes.where("cast(id as int) % 7 = 0").withColumns({"revision": F.lit(3).cast("long"), "x": F.col("x") + 60})
    return nodes.unionByName(edges).unionByName(moved)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    folder = written(_diffs(spark, d), "diffs").inputFiles()[0].rsplit("/", 1)[0]
    return run_available(spark, R.route_changes(spark.readStream.schema(R.DIFFS).parquet(folder)), shared_dir(spark))


@query()
def stream_routes(spark: SparkSession, d: str) -> DataFrame:
    """Points of the routes as of the last revision."""
    r = R.latest_routes(_changes(spark, d))
    return r.select("graph_id", "edge_id", "revision", F.posexplode("points").alias("k", "p")).select("graph_id", "edge_id", "revision", "k", "p.x", "p.y")


@query("SELECT e.graph_id, e.edge_id, round(s.x + s.width / 2 + CASE WHEN s.ord % 7 = 0 THEN 60 ELSE 0 END, 6) AS x1, round(s.y + s.height / 2, 6) AS y1, round(t.x + t.width / 2 + CASE WHEN t.ord % 7 = 0 THEN 60 ELSE 0 END, 6) AS x2, round(t.y + t.height / 2, 6) AS y2, s.ord % 7 = 0 OR t.ord % 7 = 0 AS moved FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.source_id JOIN nodes t ON t.graph_id = e.graph_id AND t.node_id = e.target_id", TRADE_SQL)
def stream_route_ends(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of every route after the stream; routes of moved nations are of the last revision."""
    p = lambda i, c: F.round(F.element_at("points", i)[c], 6)
    r = R.latest_routes(_changes(spark, d))
    moved = (F.substring("edge_id", 1, 2).cast("int") % 7 == 0) | (F.substring("edge_id", 4, 2).cast("int") % 7 == 0)
    return r.where(~moved | (F.col("revision") == 3)).select("graph_id", "edge_id", p(1, "x").alias("x1"), p(1, "y").alias("y1"), p(-1, "x").alias("x2"), p(-1, "y").alias("y2"), moved.alias("moved"))

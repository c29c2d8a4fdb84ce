"""Queries over routes searched around the boxes of the trade drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources.graphs import TRADE_SQL
from .catalog import query
from .catalog_compaction import _drawing


def _routes(spark: SparkSession, d: str) -> DataFrame:
    return search.searched_routes(*_drawing(spark, d))


@query()
def trade_searched_routes(spark: SparkSession, d: str) -> DataFrame:
    """Points of every edge's route among real boxes."""
    return _routes(spark, d).select("graph_id", "edge_id", F.posexplode("points").alias("k", "p")).select("graph_id", "edge_id", "k", "p.x", "p.y")


@query("SELECT graph_id, edge_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY weight DESC, ord) - 1 AS INTEGER) AS turn, true AS found FROM edges WHERE source_id <> target_id", TRADE_SQL)
def trade_search_turns(spark: SparkSession, d: str) -> DataFrame:
    """In which turn each edge was drawn, and whether a way was found."""
    return _routes(spark, d).select("graph_id", "edge_id", "turn", F.col("points").isNotNull().alias("found"))

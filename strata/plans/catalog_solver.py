"""Queries over constraints of several strengths on the trade graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import solver as S
from ..sources.graphs import TRADE_SQL, trade_graphs
from ..storage import written
from .catalog import query

_COLUMNS = " member AS (SELECT *, ord % 5 AS g, row_number() OVER (PARTITION BY graph_id, ord % 5 ORDER BY ord) AS k, count(*) OVER (PARTITION BY graph_id, ord % 5) AS n FROM nodes)"


def _solved(spark: SparkSession, d: str) -> DataFrame:
    """Columns of nodes: left sides aligned, 15 apart; the first one of each is held, the last one pulls 7 to the right."""
    n = written(trade_graphs(spark, d)[0], "trade")
    groups = n.select("graph_id", (F.col("ord") % 5).cast("string").alias("group_id"), "node_id", F.col("ord").alias("k"))
    ends = groups.groupBy("graph_id", "group_id").agg(F.min_by("node_id", "k").alias("first"), F.max_by("node_id", "k").alias("last"))
    at = F.col("group_id").cast("double") * 100
    parts = [
        S.aligned(groups, "x"),
        S.distributed(groups, 15.0),
        S.pinned(ends.select("graph_id", F.col("first").alias("node_id"), at.alias("at")), "x", "strong"),
        S.pinned(ends.select("graph_id", F.col("last").alias("node_id"), (at + 7).alias("at")), "x", "medium"),
        S.pinned(ends.select("graph_id", F.col("first").alias("node_id"), F.lit(10.0).alias("at")), "y", "strong"),
    ]
    return S.solved(n, reduce(DataFrame.unionByName, parts))


@query("SELECT graph_id, node_id, round(g * 100.0, 6) AS x, round(10 + coalesce(sum(height + 15.0) OVER (PARTITION BY graph_id, g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS y FROM member", TRADE_SQL, _COLUMNS)
def constraints_solved(spark: SparkSession, d: str) -> DataFrame:
    """Places that meet all required constraints and the strong ones."""
    return _solved(spark, d).where("kind = 'node'").select("graph_id", F.col("id").alias("node_id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT graph_id, 'pin:x:medium:' || node_id AS constraint_id, 7.0 AS missed, 'violated' AS status FROM member WHERE k = n", TRADE_SQL, _COLUMNS)
def constraints_missed(spark: SparkSession, d: str) -> DataFrame:
    """Constraints that stronger ones keep from being met, and by how much."""
    return _solved(spark, d).where("status <> 'ok'").select("graph_id", F.col("id").alias("constraint_id"), F.round("missed", 6).alias("missed"), "status")

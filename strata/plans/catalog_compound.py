"""Queries over compound drawings: nations inside their regions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compound as C
from ..sources.graphs import TRADE_SQL, trade_graphs
from ..storage import written
from .catalog import _PLACE, query
from .catalog_drawings import _PLACED, _TRADE_LAYERS
from .registry import layered

_OLD = TRADE_SQL.replace("nodes AS (", "trade_nodes AS (").replace("edges AS (", "trade_edges AS (")
_MEMBER = """ home AS (SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS node_id, 'R' || n_regionkey AS scope, n_regionkey FROM nation),
seen AS (SELECT e.graph_id, CASE WHEN a.scope = b.scope THEN a.scope ELSE '' END AS scope, CASE WHEN a.scope = b.scope THEN e.source_id ELSE a.scope END AS source_id, CASE WHEN a.scope = b.scope THEN e.target_id ELSE b.scope END AS target_id, min(e.ord) AS ord, sum(e.weight) AS weight, count(*) AS members
  FROM trade_edges e JOIN home a ON a.node_id = e.source_id JOIN home b ON b.node_id = e.target_id GROUP BY ALL)"""
#: The nations of a region, as graphs of their own.
_INNER = """ nodes AS (SELECT t.graph_id || '/' || scope AS graph_id, node_id, t.ord, t.width, t.height FROM trade_nodes t JOIN home USING (node_id)),
edges AS (SELECT graph_id || '/' || scope AS graph_id, source_id || '>' || target_id AS edge_id, source_id, target_id, ord, weight FROM seen WHERE scope <> '')"""
_SHIFT = " near AS (SELECT split_part(graph_id, '/', 1) AS graph_id, split_part(graph_id, '/', 2) AS scope, node_id, x - min(x) OVER w + 12 AS x, y - min(y) OVER w + 12 AS y, width, height, max(x + width) OVER w - min(x) OVER w + 24 AS w, max(y + height) OVER w - min(y) OVER w + 24 AS h FROM placed WINDOW w AS (PARTITION BY graph_id))"
_OUTER = """ nodes AS (SELECT DISTINCT graph_id, scope AS node_id, CAST(substr(scope, 2) AS BIGINT) AS ord, w AS width, h AS height FROM near),
edges AS (SELECT graph_id, source_id || '>' || target_id AS edge_id, source_id, target_id, ord, weight FROM seen WHERE scope = '')"""


def _again(sql: str) -> str:
    """The same relations once more, under other names."""
    return re.sub(r"\b(nodes|edges|ori|dag|walk|lay|pos|size|lx|placed)\b", r"\g<1>2", sql)


_OUTERMOST = " far AS (SELECT graph_id, node_id, x - min(x) OVER w + 12 AS x, y - min(y) OVER w + 12 AS y, width, height FROM placed2 WINDOW w AS (PARTITION BY graph_id))"


def _compound(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Trade graphs whose nations stand in their regions."""
    n, e = (written(t, "trade") for t in trade_graphs(spark, d))
    nation = spark.read.parquet(f"{d}/nation.parquet").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("node_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent_id"), "n_regionkey")
    n = n.drop("parent_id").join(nation, "node_id")
    regions = n.select("graph_id", F.col("parent_id").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("n_regionkey").cast("int").alias("ord"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height")).distinct()
    return n.select("graph_id", "node_id", "parent_id", "ord", "width", "height").unionByName(regions), e


@query("SELECT * FROM seen", _OLD, _MEMBER)
def compound_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Edges as the scopes see them."""
    n, e = _compound(spark, d)
    return C.scope_edges(C.lineage(n), e)


@query(
    "SELECT graph_id, node_id, round(x, 6) AS x, round(y, 6) AS y, width, height FROM far UNION ALL SELECT n.graph_id, n.node_id, round(f.x + n.x, 6), round(f.y + n.y, 6), n.width, n.height FROM near n JOIN far f ON f.graph_id = n.graph_id AND f.node_id = n.scope",
    _OLD,
    _MEMBER,
    _INNER,
    _TRADE_LAYERS,
    _PLACE,
    _PLACED,
    _SHIFT,
    *[_again(x) for x in (_OUTER, _TRADE_LAYERS, _PLACE, _PLACED)],
    _OUTERMOST,
    recursive=True,
)
def compound_places(spark: SparkSession, d: str) -> DataFrame:
    """World places of nations and regions."""
    boxes = C.world_boxes(C.compound_places(*_compound(spark, d), layered))
    return boxes.select("graph_id", "node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "width", "height")

"""Queries over arrangements of a selection, on the trade graphs as they are authored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import partial as P
from ..operators import quality
from ..sources.graphs import TRADE_SQL, trade_graphs
from ..storage import written
from .catalog import _PLACE, query
from .catalog_compound import _again
from .catalog_drawings import _PLACED, _TRADE_LAYERS
from .registry import layered

_SELECTED = """ chosen AS (SELECT * FROM nodes WHERE ord % 7 = 3),
nodes2 AS (SELECT * FROM chosen),
edges2 AS (SELECT * FROM edges e WHERE EXISTS (SELECT 1 FROM chosen c WHERE c.graph_id = e.graph_id AND c.node_id = e.source_id) AND EXISTS (SELECT 1 FROM chosen c WHERE c.graph_id = e.graph_id AND c.node_id = e.target_id))"""
_SLIDE = """ put AS (SELECT p.graph_id, p.node_id, p.x - min(p.x) OVER w + min(c.x) OVER w AS x, p.y - min(p.y) OVER w + min(c.y) OVER w AS y, p.width, p.height FROM placed2 p JOIN chosen c USING (graph_id, node_id) WINDOW w AS (PARTITION BY p.graph_id)),
barred AS (SELECT n.graph_id, 'x' AS axis, o.x - 20 - n.x - n.width AS low, o.x + o.width + 20 - n.x AS high FROM put n JOIN nodes o USING (graph_id) WHERE o.ord % 7 <> 3 AND n.y < o.y + o.height + 20 AND o.y < n.y + n.height + 20
  UNION ALL SELECT n.graph_id, 'y', o.y - 20 - n.y - n.height, o.y + o.height + 20 - n.y FROM put n JOIN nodes o USING (graph_id) WHERE o.ord % 7 <> 3 AND n.x < o.x + o.width + 20 AND o.x < n.x + n.width + 20),
ends AS (SELECT DISTINCT b.graph_id, b.axis, e AS slide FROM (SELECT graph_id, axis, unnest([low, high, 0]) AS e FROM barred) b
  WHERE NOT EXISTS (SELECT 1 FROM barred c WHERE c.graph_id = b.graph_id AND c.axis = b.axis AND c.low < b.e AND b.e < c.high)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY abs(slide), axis, -slide) AS k FROM ends) WHERE k = 1),
result AS (SELECT n.graph_id, n.node_id, n.x + CASE WHEN axis = 'x' THEN slide ELSE 0 END AS x, n.y + CASE WHEN axis = 'y' THEN slide ELSE 0 END AS y, width, height, 'placed' AS status FROM put n JOIN best USING (graph_id)
  UNION ALL SELECT graph_id, node_id, x, y, width, height, 'fixed' FROM nodes WHERE ord % 7 <> 3)"""
_SQL = (TRADE_SQL, _SELECTED, *[_again(x) for x in (_TRADE_LAYERS, _PLACE, _PLACED)], _SLIDE)


def _partial(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, e = (written(t, "trade") for t in trade_graphs(spark, d))
    return n, e, P.partial_places(n, e, n.where("ord % 7 = 3"), layered)


@query("SELECT graph_id, node_id, round(x, 6) AS x, round(y, 6) AS y, status FROM result", *_SQL, recursive=True)
def partial_places(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh nation arranged anew among the others, who stay."""
    return _partial(spark, d)[2].select("graph_id", "node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "status")


@query(
    "SELECT e.graph_id, e.edge_id, 2 AS k, round((s.x + s.width / 2 + t.x + t.width / 2) / 2, 6) AS x, round(t.y + t.height / 2, 6) AS y FROM edges e JOIN result s ON s.graph_id = e.graph_id AND s.node_id = e.source_id JOIN result t ON t.graph_id = e.graph_id AND t.node_id = e.target_id",
    *_SQL,
    recursive=True,
)
def partial_routes(spark: SparkSession, d: str) -> DataFrame:
    """Second bends of all routes when those that the selection affects are drawn anew: as if all were."""
    n, e, after = _partial(spark, d)
    routes = P.repaired_routes(n, after, e, quality.elbow_routes(n, e))
    return routes.select("graph_id", "edge_id", F.lit(2).alias("k"), F.round(F.get("points", F.lit(2))["x"], 6).alias("x"), F.round(F.get("points", F.lit(2))["y"], 6).alias("y"))

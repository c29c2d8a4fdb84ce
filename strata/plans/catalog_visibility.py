"""Queries over shortest ways around the boxes of the trade drawings, and the curves that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import visibility
from ..sources.graphs import TRADE_SQL
from .catalog import _PLACE, query
from .catalog_compaction import _drawing
from .catalog_drawings import _PLACED, _TRADE_LAYERS


def _span(c: str) -> tuple[str, str]:
    """When a line from a to b is between a barrier's sides along an axis: from, to (1e-6 inside)."""
    low, high, step = f"({c}1 + 1e-6 - a.{c})", f"({c}2 - 1e-6 - a.{c})", f"(b.{c} - a.{c})"
    inside = f"a.{c} > {c}1 + 1e-6 AND a.{c} < {c}2 - 1e-6"
    return tuple(f"CASE WHEN abs{step} < 1e-9 THEN {still} ELSE {side}({low} / {step}, {high} / {step}) END" for side, still in (("least", f"CASE WHEN {inside} THEN -1e300 ELSE 1e300 END"), ("greatest", "1e300")))


_X, _Y = _span("x"), _span("y")
_SEE = f""" bar AS (SELECT graph_id, node_id, x - 8 AS x1, y - 8 AS y1, x + width + 8 AS x2, y + height + 8 AS y2 FROM placed),
pts AS MATERIALIZED (SELECT graph_id, node_id, k, [x1, x2, x2, x1, (x1 + x2) / 2, x2, (x1 + x2) / 2, x1][k + 1] AS x, [y1, y1, y2, y2, y1, (y1 + y2) / 2, y2, (y1 + y2) / 2][k + 1] AS y FROM bar, range(8) r(k)),
see AS MATERIALIZED (SELECT a.graph_id, a.node_id AS an, a.k AS ak, b.node_id AS bn, b.k AS bk, sqrt((any_value(a.x) - any_value(b.x)) ** 2 + (any_value(a.y) - any_value(b.y)) ** 2) AS d
  FROM pts a JOIN pts b ON a.graph_id = b.graph_id AND (a.node_id, a.k) <> (b.node_id, b.k) JOIN bar r ON r.graph_id = a.graph_id
  GROUP BY a.graph_id, a.node_id, a.k, b.node_id, b.k HAVING NOT bool_or(greatest(0, {_X[0]}, {_Y[0]}) < least(1, {_X[1]}, {_Y[1]})))"""
_HOPS = 24
#: Lengths of the shortest ways from each box over at most ``_HOPS`` corners.
_FAR = " far0 AS MATERIALIZED (SELECT graph_id, an AS src, bn, bk, min(d) AS d FROM see WHERE ak >= 4 GROUP BY ALL)," + ",".join(
    f" far{i + 1} AS MATERIALIZED (SELECT graph_id, src, bn, bk, min(d) AS d FROM (SELECT * FROM far{i} UNION ALL SELECT p.graph_id, p.src, s.bn, s.bk, p.d + s.d FROM far{i} p JOIN see s ON s.graph_id = p.graph_id AND s.an = p.bn AND s.ak = p.bk WHERE p.bk < 4) GROUP BY ALL)" for i in range(_HOPS)
)


@query("SELECT p.graph_id, p.node_id, CAST(p.k AS INTEGER) AS k, count(s.bk) AS seen FROM pts p LEFT JOIN see s ON s.graph_id = p.graph_id AND s.an = p.node_id AND s.ak = p.k GROUP BY ALL", TRADE_SQL, _TRADE_LAYERS, _PLACE, _PLACED, _SEE, recursive=True)
def trade_corner_views(spark: SparkSession, d: str) -> DataFrame:
    """How many corners and middles of sides each of them sees among the barriers."""
    return visibility.corner_views(_drawing(spark, d)[0])


@query(f"SELECT g.graph_id, g.edge_id, round(min(f.d) + 16, 4) AS length FROM dag g LEFT JOIN far{_HOPS} f ON f.graph_id = g.graph_id AND f.src = g.s AND f.bn = g.t AND f.bk >= 4 GROUP BY ALL", TRADE_SQL, _TRADE_LAYERS, _PLACE, _PLACED, _SEE, _FAR, recursive=True)
def trade_visible_ways(spark: SparkSession, d: str) -> DataFrame:
    """Length of the shortest way of every edge around all boxes."""
    return visibility.visible_ways(*_drawing(spark, d)).select("graph_id", "edge_id", F.round("length", 4).alias("length"))


@query()
def trade_bezier_routes(spark: SparkSession, d: str) -> DataFrame:
    """Control points of the curves that follow the ways; ``k`` counts an edge's stretches."""
    r = visibility.visible_ways(*_drawing(spark, d)).select("graph_id", "edge_id", F.posexplode("curves").alias("k", "c"))
    return r.select("graph_id", "edge_id", "k", *[F.round(F.get("c", F.lit(i))[a], 6).alias(f"{a}{i}") for i in range(4) for a in "xy"])

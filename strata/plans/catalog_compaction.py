"""Queries over compaction of the trade drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction
from ..operators import graph as G
from ..sources.graphs import TRADE_SQL
from ..storage import written
from .catalog import _PLACE, _layers, query
from .catalog_drawings import _PLACED, _TRADE_LAYERS, _trade


def _pushed(name: str, source: str, to_right: bool, lock: str = "false") -> str:
    """Places after a push; ``source``: a relation of boxes with n_in and n_out."""
    x = "-x - width" if to_right else "x"
    back = "-max(px) - any_value(width)" if to_right else "max(px)"
    return f""" {name}_t AS (SELECT *, {x} AS tx, {lock} AS lock, min({x}) OVER (PARTITION BY graph_id) AS low FROM {source}),
{name}_c AS (SELECT a.graph_id, a.node_id AS a, b.node_id AS b, a.width + 20 AS d FROM {name}_t a JOIN {name}_t b ON a.graph_id = b.graph_id AND (a.tx, a.width, a.node_id) < (b.tx, b.width, b.node_id) AND a.y < b.y + b.height + 20 AND b.y < a.y + a.height + 20),
{name}_w AS (SELECT graph_id, node_id, CASE WHEN lock THEN tx ELSE low END AS px FROM {name}_t UNION SELECT w.graph_id, c.b, greatest(w.px + c.d, CASE WHEN t.lock THEN t.tx ELSE t.low END) FROM {name}_w w JOIN {name}_c c ON c.graph_id = w.graph_id AND c.a = w.node_id JOIN {name}_t t ON t.graph_id = c.graph_id AND t.node_id = c.b),
{name} AS (SELECT graph_id, node_id, {back} AS x, any_value(y) AS y, any_value(width) AS width, any_value(height) AS height, any_value(n_in) AS n_in, any_value(n_out) AS n_out FROM {name}_w JOIN {name}_t USING (graph_id, node_id) GROUP BY ALL)"""


_BOXES = " boxes AS (SELECT p.graph_id, p.node_id, p.x, p.y, p.width, p.height, (SELECT count(*) FROM dag WHERE dag.graph_id = p.graph_id AND dag.t = p.node_id) AS n_in, (SELECT count(*) FROM dag WHERE dag.graph_id = p.graph_id AND dag.s = p.node_id) AS n_out FROM placed p)"
_RESULT = "SELECT graph_id, node_id, round(x, 6) AS x, round(y, 6) AS y FROM {}"
_FIRST = _pushed("lefts", "boxes", False)


def _drawing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = (written(t, "trade") for t in _trade(spark, d))
    return G.place_simple(n, G.order_in_layers(n, _layers(n, e))), e


def _add(name: str, kind: str, sql: str | None, *ctes: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = compaction.compacted(*_drawing(spark, d), kind)
        return out.select("graph_id", "node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))

    run.__name__ = name
    if sql:
        query(sql, TRADE_SQL, _TRADE_LAYERS, _PLACE, _PLACED, _BOXES, *ctes, recursive=True)(run)
    else:
        query()(run)


_add("trade_compacted_left", "LEFT", _RESULT.format("lefts"), _FIRST)
_add("trade_compacted_right", "RIGHT", _RESULT.format("rights"), _pushed("rights", "boxes", True))
_add("trade_compacted_constraints", "LEFT_RIGHT_CONSTRAINT_LOCKING", _RESULT.format("rights"), _FIRST, _pushed("rights", "lefts", True, "n_in + n_out = 0"))
_add("trade_compacted_connections", "LEFT_RIGHT_CONNECTION_LOCKING", _RESULT.format("rights"), _FIRST, _pushed("rights", "lefts", True, "n_in > n_out"))
_add("trade_compacted_edges", "EDGE_LENGTH", None)

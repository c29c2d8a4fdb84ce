"""Queries over orthogonal routes with hypersegments: every edge of the trade graphs, through all layers it passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cross_places, end_labels
from ..operators import graph as G
from ..operators import hypersegments as H
from ..sources.graphs import TRADE_SQL
from ..storage import written
from .catalog import _PLACE, _layers, query
from .catalog_drawings import _PLACED, _TRADE_LAYERS, _trade

#: ``pos`` with dummies: behind the source of their edge, in order of edges.
_LONG = _TRADE_LAYERS[: _TRADE_LAYERS.index("pos AS (")] + """
piece AS (SELECT d.graph_id, d.edge_id, d.s, d.t, e.ord, a.layer AS sl, b.layer AS tl, n.ord AS first, unnest(range(a.layer, b.layer)) AS l FROM dag d JOIN edges e USING (graph_id, edge_id)
  JOIN lay a ON a.graph_id = d.graph_id AND a.node_id = d.s JOIN lay b ON b.graph_id = d.graph_id AND b.node_id = d.t JOIN nodes n ON n.graph_id = d.graph_id AND n.node_id = d.s),
member AS (SELECT l.graph_id, l.node_id, l.layer, n.ord AS first, 0 AS next, 0 AS last, n.width, n.height FROM lay l JOIN nodes n USING (graph_id, node_id)
  UNION ALL SELECT graph_id, '__dummy:' || edge_id || ':' || l, l, first, 1, ord, 0, 0 FROM piece WHERE l > sl),
pos AS (SELECT graph_id, node_id, layer, row_number() OVER (PARTITION BY graph_id, layer ORDER BY first, next, last) - 1 AS pos, width, height FROM member)"""
_WAYS = """ seg AS (SELECT graph_id, edge_id, ord, l - sl AS segment, l AS layer, CASE WHEN l = sl THEN s ELSE '__dummy:' || edge_id || ':' || l END AS from_id, CASE WHEN l + 1 = tl THEN t ELSE '__dummy:' || edge_id || ':' || (l + 1) END AS to_id FROM piece),
way AS (SELECT s.*, a.x + a.width AS x1, a.y + a.height / 2 AS y1, b.x AS x2,
    b.y + b.height * (row_number() OVER (PARTITION BY s.graph_id, s.to_id ORDER BY a.pos, s.ord) / (count(*) OVER (PARTITION BY s.graph_id, s.to_id) + 1)) AS y2
  FROM seg s JOIN placed a ON a.graph_id = s.graph_id AND a.node_id = s.from_id JOIN placed b ON b.graph_id = s.graph_id AND b.node_id = s.to_id)"""
_SQL = (TRADE_SQL, _LONG, _PLACE, _PLACED, _WAYS)


def _ends(spark: SparkSession, d: str) -> DataFrame:
    n, e = (written(t, "trade") for t in _trade(spark, d))  # read many times below
    every, order, segments = (written(t, "drawing") for t in H.expanded(n, e, written(_layers(n, e), "layers")))
    return written(H.gap_ends(written(G.place_simple(every, order), "placed"), order, segments), "ends")


@query()
def trade_routes(spark: SparkSession, d: str) -> DataFrame:
    """Points of the routes of all edges, in flow direction."""
    r = H.edge_routes(H.gap_routes(_ends(spark, d)))
    return r.select("graph_id", "edge_id", F.posexplode("points").alias("k", "p")).select("graph_id", "edge_id", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query()
def trade_gap_slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots of each gap's trunks."""
    return H.gap_routes(_ends(spark, d)).groupBy("graph_id", "layer").agg(F.max("slots").alias("slots"), F.sum((F.col("slot") < 0).cast("long")).alias("straight"))


@query("SELECT graph_id, edge_id, segment, layer, from_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM way", *_SQL, recursive=True)
def trade_gap_ends(spark: SparkSession, d: str) -> DataFrame:
    """Where every edge leaves and enters each gap."""
    return _ends(spark, d).select("graph_id", "edge_id", "segment", "layer", "from_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    """SELECT graph_id, layer, from_id, round(max(low), 6) AS low, round(max(high), 6) AS high, CAST(count(*) FILTER (sides + CAST(y > low AS INT) + CAST(y < high AS INT) >= 3) AS BIGINT) AS junctions, max(members) AS members
FROM (SELECT *, min(y) OVER w AS low, max(y) OVER w AS high FROM (SELECT graph_id, layer, from_id, y, count(DISTINCT o) AS sides FROM (SELECT graph_id, layer, from_id, y1 AS y, 0 AS o FROM way UNION ALL SELECT graph_id, layer, from_id, y2, 1 FROM way) GROUP BY ALL) WINDOW w AS (PARTITION BY graph_id, layer, from_id))
JOIN (SELECT graph_id, layer, from_id, count(*) AS members FROM way GROUP BY ALL) USING (graph_id, layer, from_id) WHERE high > low GROUP BY ALL""",
    *_SQL,
    recursive=True,
)
def trade_trunks(spark: SparkSession, d: str) -> DataFrame:
    """Trunks of hypersegments, how many edges share them, and their junctions."""
    return H.trunks(_ends(spark, d)).select("graph_id", "layer", "from_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.col("junctions").cast("long").alias("junctions"), "members")


@query(
    "SELECT graph_id, edge_id, 2 * count(*) FILTER (y1 <> y2) AS bends, round(sum(abs(y1 - y2)) + max(x2) - min(x1), 4) AS length FROM way GROUP BY ALL",
    *_SQL,
    recursive=True,
)
def trade_route_bends(spark: SparkSession, d: str) -> DataFrame:
    """Bends and length of every route, measured on its points."""
    r = H.edge_routes(H.gap_routes(_ends(spark, d)))
    steps = F.zip_with("points", F.slice("points", 2, F.size("points") - 1), lambda a, b: F.coalesce(F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]), F.lit(0.0)))
    length = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)
    return r.select("graph_id", "edge_id", (F.size("points") - 2).cast("long").alias("bends"), F.round(length, 4).alias("length"))


@query()
def trade_end_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels at both ends of every route, moved to where they cover least."""
    n, e = (written(t, "trade") for t in _trade(spark, d))
    every, order, segments = (written(t, "drawing") for t in H.expanded(n, e, written(_layers(n, e), "layers")))
    placed = written(G.place_simple(every, order, 80.0, 30.0), "placed")
    routes = written(H.edge_routes(H.gap_routes(H.gap_ends(placed, order, segments))), "routes")
    end = lambda name, i, dx: F.struct(F.lit(name).alias("end"), (F.element_at("points", i)["x"] + dx).alias("x"), (F.element_at("points", i)["y"] + 2.0).alias("y"))
    labels = routes.select("graph_id", "edge_id", F.inline(F.array(end("TAIL", 1, 2.0), end("HEAD", -1, -22.0))), F.lit(20.0).alias("width"), F.lit(8.0).alias("height"))
    return end_labels.placed_end_labels(labels, routes, placed.where("width > 0").select("graph_id", "x", "y", "width", "height"))


@query()
def trade_simplex_places(spark: SparkSession, d: str) -> DataFrame:
    """Heights of nodes and dummies at which all edges together climb least."""
    n, e = (written(t, "trade") for t in _trade(spark, d))
    every, order, segments = (written(t, "drawing") for t in H.expanded(n, e, written(_layers(n, e), "layers")))
    return cross_places.simplex_places(every, order, segments.join(e.select("graph_id", "edge_id", "weight"), ["graph_id", "edge_id"])).select("graph_id", "node_id", F.round("y", 6).alias("y"))

"""Queries over curves, lines of any direction, whole drawings, attachments, owners, wrapping and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves
from ..functions import geometry as g
from ..operators import attachments, graph, measures, packing, quality, routing
from ..sources.graphs import CONTAINMENT_SQL, TRADE_SQL, TRANSITION_SQL, containment, transition_graphs
from ..storage import written
from . import registry
from .catalog import _BOX, _ELBOW, _PLACE, _UP, SQL, _layers, _shelf, query
from .catalog_drawings import _LABEL, _LCG, _PLACED, _PORTS, _TRADE_LAYERS, _labelled, _trade, _trade_ports
from .catalog_routes import _moved


def _r(c: Column | str, name: str) -> Column:
    return (F.round(c, 6) + 0.0).alias(name)


def _s_curves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every edge as one cubic that leaves and enters level."""
    n, e = transition_graphs(spark, d)
    return n, e, _s_curves_of(n, e)


def _s_curves_of(n: DataFrame, e: DataFrame) -> DataFrame:
    return quality.elbow_routes(n, e).select("graph_id", "edge_id", curves.s_curve(F.col("points")).alias("c"))


def _cubic(t: str) -> str:
    """Where an edge's cubic is at ``t``, as SQL for x and y."""
    at = lambda a, c1, c2, b: f"{a} * (1 - {t}) * (1 - {t}) * (1 - {t}) + 3 * {c1} * (1 - {t}) * (1 - {t}) * {t} + 3 * {c2} * (1 - {t}) * {t} * {t} + {b} * {t} * {t} * {t}"
    return f"{at('sx', '(sx + tx) / 2', '(sx + tx) / 2', 'tx')} AS x, {at('sy', 'sy', 'ty', 'ty')} AS y"


_FLAT = f" flat AS (SELECT graph_id, edge_id, k, {_cubic('(k / n)')} FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT) + 1)) AS k FROM (SELECT *, greatest(1, ceil(sqrt(sqrt((tx - sx) * (tx - sx) / 4 + (ty - sy) * (ty - sy)) * 0.75 / 0.5))) AS n FROM seg0)))"


@query("SELECT graph_id, edge_id, CAST(k AS INTEGER) AS k, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM flat", TRANSITION_SQL, _ELBOW, _FLAT)
def curve_points(spark: SparkSession, d: str) -> DataFrame:
    """Curves as lines that stay within half a unit of them."""
    return curves.flat_points(_s_curves(spark, d)[2]).select("graph_id", "edge_id", "k", _r("x", "x"), _r("y", "y"))


@query(f"SELECT graph_id, edge_id, round(x, 6) + 0.0 AS cut_x, round(y, 6) + 0.0 AS cut_y, sx + (tx - sx) * 7 / 32 AS before_x, sy + (ty - sy) / 16 AS before_y, ty - (ty - sy) * 9 / 16 AS after_y FROM (SELECT *, {_cubic('0.25')} FROM seg0)", TRANSITION_SQL, _ELBOW)
def curve_split(spark: SparkSession, d: str) -> DataFrame:
    """Curves cut at a quarter of their parameter: the cut and the control points next to it."""
    c = _s_curves(spark, d)[2].select("graph_id", "edge_id", curves.split_cubic(F.col("c"), F.lit(0.25)).alias("s"))
    return c.select("graph_id", "edge_id", _r("s.after.a.x", "cut_x"), _r("s.after.a.y", "cut_y"), F.col("s.before.c2.x").alias("before_x"), F.col("s.before.c2.y").alias("before_y"), F.col("s.after.c1.y").alias("after_y"))


def _through(x1: str, y1: str, x2: str, y2: str) -> str:
    """Whether a line runs through the open inside of node b, as SQL."""
    def times(a, way, low, high):
        t = [f"({c} - ({a})) / ({way})" for c in (low, high)]
        inside = f"({a}) > {low} AND ({a}) < {high}"
        return tuple(f"CASE WHEN ({way}) <> 0 THEN {f}({t[0]}, {t[1]}) WHEN {inside} THEN {yes} ELSE {no} END" for f, yes, no in (("least", "-1e300", "1e300"), ("greatest", "1e300", "-1e300")))

    (fx, ux), (fy, uy) = times(x1, f"{x2} - {x1}", "b.x", "b.x + b.width"), times(y1, f"{y2} - {y1}", "b.y", "b.y + b.height")
    return f"greatest(0, {fx}, {fy}) < least(1, {ux}, {uy}) - 1e-10"


def _not_own(hits: DataFrame, edges: DataFrame) -> DataFrame:
    return hits.join(edges.select("graph_id", "edge_id", "source_id", "target_id"), ["graph_id", "edge_id"]).where("node_id <> source_id and node_id <> target_id")


@query(f"SELECT s.graph_id, s.edge_id, b.node_id FROM seg0 s JOIN edges e USING (graph_id, edge_id) JOIN nodes b ON b.graph_id = s.graph_id AND b.node_id NOT IN (e.source_id, e.target_id) WHERE {_through('s.sx', 's.sy', 's.tx', 's.ty')}", TRANSITION_SQL, _ELBOW)
def straight_line_hits(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the line between two others runs through."""
    n, e = transition_graphs(spark, d)
    lines = quality.elbow_routes(n, e).select("graph_id", "edge_id", F.array(F.element_at("points", 1), F.element_at("points", -1)).alias("points"))
    return _not_own(quality.line_hits(lines, n), e).select("graph_id", "edge_id", "node_id")


@query(f"SELECT DISTINCT p.graph_id, p.edge_id, b.node_id FROM flat p JOIN flat q ON q.graph_id = p.graph_id AND q.edge_id = p.edge_id AND q.k = p.k + 1 JOIN edges e ON e.graph_id = p.graph_id AND e.edge_id = p.edge_id JOIN nodes b ON b.graph_id = p.graph_id AND b.node_id NOT IN (e.source_id, e.target_id) WHERE {_through('p.x', 'p.y', 'q.x', 'q.y')}", TRANSITION_SQL, _ELBOW, _FLAT)
def curve_hits(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that the curve between two others runs through."""
    n, e = (written(t, "graphs") for t in transition_graphs(spark, d))  # each is read more than once
    c = _s_curves_of(n, e)
    ends = e.select("graph_id", "edge_id", "source_id", "target_id")
    return quality.curve_hits(c.join(ends, ["graph_id", "edge_id"]), n)


@query("SELECT graph_id, edge_id, round(CASE WHEN most = 0 THEN 0 WHEN m > 0 AND (m * sqrt(2) + most - m) / 2 <= m * sqrt(2) THEN sign(dx) / sqrt(2) WHEN abs(dx) > abs(dy) THEN sign(dx) ELSE 0 END, 6) + 0.0 AS x, round(CASE WHEN most = 0 THEN 0 WHEN m > 0 AND (m * sqrt(2) + most - m) / 2 <= m * sqrt(2) THEN sign(dy) / sqrt(2) WHEN abs(dx) > abs(dy) THEN 0 ELSE sign(dy) END, 6) + 0.0 AS y FROM (SELECT *, tx - sx AS dx, ty - sy AS dy, least(abs(tx - sx), abs(ty - sy)) AS m, greatest(abs(tx - sx), abs(ty - sy)) AS most FROM seg0)", TRANSITION_SQL, _ELBOW)
def route_directions(spark: SparkSession, d: str) -> DataFrame:
    """Which way octilinear routes run in their middle."""
    r = routing.octilinear_routes(*transition_graphs(spark, d))
    way = g.direction_at(F.col("points"), g.path_length(F.col("points")) / 2)
    return r.select("graph_id", "edge_id", way.alias("w")).select("graph_id", "edge_id", _r("w.x", "x"), _r("w.y", "y"))


@query("SELECT graph_id, edge_id, k, round(CASE k WHEN 0 THEN sx ELSE (sx + tx) / 2 END, 6) AS ax, round(CASE k WHEN 0 THEN sy ELSE (sy + ty) / 2 END, 6) AS ay, round((sx + tx) / 2, 6) AS c1x, round(CASE k WHEN 0 THEN sy ELSE ((sy + ty) / 2 + ty) / 2 END, 6) AS c1y, round((sx + tx) / 2, 6) AS c2x, round(CASE k WHEN 0 THEN (sy + (sy + ty) / 2) / 2 ELSE ty END, 6) AS c2y, round(CASE k WHEN 0 THEN (sx + tx) / 2 ELSE tx END, 6) AS bx, round(CASE k WHEN 0 THEN (sy + ty) / 2 ELSE ty END, 6) AS \"by\" FROM seg0, (VALUES (0), (1)) p(k)", TRANSITION_SQL, _ELBOW)
def spline_routes(spark: SparkSession, d: str) -> DataFrame:
    """Splines with an elbow's points and the middle of its stem as control points, as cubics."""
    r = quality.elbow_routes(*transition_graphs(spark, d))
    at = lambda i: F.element_at("points", i)
    middle = g.point((at(2)["x"] + at(3)["x"]) / 2, (at(2)["y"] + at(3)["y"]) / 2)
    five = F.array(at(1), at(2), middle, at(3), at(4))
    c = r.select("graph_id", "edge_id", F.posexplode(curves.spline_pieces(five)).alias("k", "c"))
    return c.select("graph_id", "edge_id", "k", *[_r(f"c.{p}.{x}", f"{p}{x}") for p in ("a", "c1", "c2", "b") for x in "xy"])


_MARKS = "CASE {0}.ord % 5 WHEN 1 THEN {1} WHEN 2 THEN {2} WHEN 3 THEN {3} WHEN 4 THEN {4} ELSE 0 END"


@query("SELECT e.graph_id, e.edge_id, s.o > t.o AS reversed FROM edges e JOIN ranks s ON s.graph_id = e.graph_id AND s.node_id = e.source_id JOIN ranks t ON t.graph_id = e.graph_id AND t.node_id = e.target_id", TRANSITION_SQL, f" ranks AS (SELECT graph_id, node_id, ord + {_MARKS.format('nodes', 2, -1, 1, -2)} * count(*) OVER (PARTITION BY graph_id) AS o FROM nodes)")
def cycle_model_order_constrained(spark: SparkSession, d: str) -> DataFrame:
    """Nodes but the first of each graph want to be last, first, last but one or before the first."""
    n, e = transition_graphs(spark, d)
    kinds = F.create_map(*[F.lit(x) for x in (1, "LAST_SEPARATE", 2, "FIRST", 3, "LAST", 4, "FIRST_SEPARATE")])
    marks = n.select("graph_id", "node_id", F.try_element_at(kinds, F.col("ord") % 5).alias("kind"))
    return graph.constrained_orientation(n, e, marks.where("kind is not null"))


@query("SELECT n.graph_id, n.node_id, CAST(coalesce(o.w, 0) AS BIGINT) AS out_weight, CAST(coalesce(i.w, 0) AS BIGINT) AS in_weight FROM nodes n LEFT JOIN (SELECT graph_id, source_id AS node_id, sum(greatest(0, weight - 2) + 1) AS w FROM edges WHERE source_id <> target_id GROUP BY ALL) o USING (graph_id, node_id) LEFT JOIN (SELECT graph_id, target_id AS node_id, sum(greatest(0, weight - 2) + 1) AS w FROM edges WHERE source_id <> target_id GROUP BY ALL) i USING (graph_id, node_id)", TRANSITION_SQL)
def degree_by_priority(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    return graph.priority_degrees(n, e, e.select("graph_id", "edge_id", (F.col("weight") - 2).alias("priority")))


@query("SELECT graph_id, CAST(l AS INTEGER) AS layer, count(*) AS dummies FROM (SELECT d.graph_id, unnest(range(a.layer + 1, b.layer)) AS l FROM dag d JOIN lay a ON a.graph_id = d.graph_id AND a.node_id = d.s JOIN lay b ON b.graph_id = d.graph_id AND b.node_id = d.t WHERE b.layer - a.layer > 1) GROUP BY ALL", TRADE_SQL, _TRADE_LAYERS, recursive=True)
def trade_dummies(spark: SparkSession, d: str) -> DataFrame:
    n, e = _trade(spark, d)
    return graph.passing_edges(e, _layers(n, e))


_OWNED = " links AS (SELECT 'C' || c_custkey || '-N' AS edge_id, 'C' || c_custkey AS s, 'N' || c_nationkey AS t FROM customer UNION ALL SELECT 'C' || c_custkey || '-R', 'C' || c_custkey, 'R' || (c_custkey % 5) FROM customer UNION ALL SELECT 'C' || c_custkey || '-C', 'C' || c_custkey, 'C' || greatest(1, c_custkey // 2) FROM customer), every AS (SELECT graph_id, node_id, ancestor_id, depth FROM up UNION ALL SELECT graph_id, node_id, node_id, 0 FROM geo)"


@query("SELECT 'geo' AS graph_id, l.edge_id, arg_min(a.ancestor_id, a.depth) FILTER (b.ancestor_id IS NOT NULL) AS owner_id FROM links l JOIN every a ON a.node_id = l.s AND (l.s <> l.t OR a.depth > 0) LEFT JOIN every b ON b.node_id = l.t AND b.ancestor_id = a.ancestor_id GROUP BY l.edge_id", CONTAINMENT_SQL, _UP, _OWNED, recursive=True)
def edge_owners(spark: SparkSession, d: str) -> DataFrame:
    """Who owns edges from each customer to its nation, to a region and to another customer (the first: to itself)."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    text = lambda mark, k: F.concat(F.lit(mark), k.cast("string"))
    me = text("C", F.col("c_custkey"))
    to = lambda name, target: F.struct(F.concat(me, F.lit(name)).alias("edge_id"), me.alias("source_id"), target.alias("target_id"))
    half = F.greatest(F.lit(1), F.expr("c_custkey div 2"))
    e = c.select(F.lit("geo").alias("graph_id"), F.inline(F.array(to("-N", text("N", F.col("c_nationkey"))), to("-R", text("R", F.col("c_custkey") % 5)), to("-C", text("C", half)))))
    return graph.edge_owners(containment(spark, d), e)


@query("SELECT graph_id, node_id, CASE WHEN node_id LIKE 'C%' THEN x + 3 WHEN node_id LIKE 'N%' THEN x ELSE x END AS x, CASE WHEN node_id LIKE 'C%' THEN y + 4 ELSE y END AS y FROM geo", CONTAINMENT_SQL)
def places_in_parents(spark: SparkSession, d: str) -> DataFrame:
    """World places, with all customers moved, as places in their parents again."""
    n = containment(spark, d)
    moved = F.col("node_id").startswith("C")
    w = graph.world_frames(n).withColumns({"world_x": F.col("world_x") + F.when(moved, 3.0).otherwise(0.0), "world_y": F.col("world_y") + F.when(moved, 4.0).otherwise(0.0)})
    return graph.native_places(w, n)


_LINKS = " odd AS (SELECT e.* FROM edges e JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = e.source_id JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = e.target_id WHERE a.ord % 2 = 1 AND b.ord % 2 = 0 QUALIFY row_number() OVER (PARTITION BY e.graph_id, e.source_id ORDER BY e.ord) = 1), hosted AS (SELECT graph_id, source_id AS node_id, min(target_id) AS host_id FROM odd GROUP BY ALL HAVING count(*) = 1), told AS (SELECT h.graph_id, h.node_id, h.host_id, n.ord, n.width, n.height, row_number() OVER (PARTITION BY h.graph_id, h.host_id ORDER BY n.ord) AS k FROM hosted h JOIN nodes n USING (graph_id, node_id))"


@query("SELECT t.graph_id, t.node_id, t.host_id, n.x + n.width / 2 - (sum(t.width + 10) OVER r - 10) / 2 + coalesce(sum(t.width + 10) OVER (PARTITION BY t.graph_id, t.host_id, t.k % 2 ORDER BY t.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, CASE WHEN t.k % 2 = 1 THEN n.y - 10 - t.height ELSE n.y + n.height + 10 END AS y, t.width, t.height FROM told t JOIN nodes n ON n.graph_id = t.graph_id AND n.node_id = t.host_id WINDOW r AS (PARTITION BY t.graph_id, t.host_id, t.k % 2)", TRANSITION_SQL, _LINKS)
def comment_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Every other node as a comment on the first of the rest that it leads to."""
    n, e = transition_graphs(spark, d)
    at = n.select("graph_id", "node_id", (F.col("ord") % 2).alias("p"))
    e = e.join(at.withColumnsRenamed({"node_id": "source_id", "p": "sp"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "p": "tp"}), ["graph_id", "target_id"]).where("sp = 1 and tp = 0")
    e = e.groupBy("graph_id", "source_id").agg(F.min_by("target_id", "ord").alias("target_id"))
    return attachments.comment_boxes(n, attachments.comment_hosts(e, n.where("ord % 2 = 1")))


@query("SELECT q.graph_id, q.node_id, q.side, q.\"index\", q.kind AS alignment, round(CASE q.kind WHEN 'BEGIN' THEN run WHEN 'END' THEN height - (n * 18 - 10) + run WHEN 'CENTER' THEN (height - (n * 18 - 10)) / 2 + run WHEN 'JUSTIFIED' THEN CASE WHEN n = 1 THEN height / 2 ELSE 4 + q.\"index\" * (height - 8) / (n - 1) END ELSE height * (q.\"index\" + 1) / (n + 1) END, 6) AS along FROM (SELECT p.graph_id, p.node_id, p.side, p.\"index\", p.\"index\" * 18 + 4 AS run, d.height, count(*) OVER (PARTITION BY p.graph_id, p.node_id, p.side) AS n, CASE o.ord % 5 WHEN 0 THEN 'BEGIN' WHEN 1 THEN 'CENTER' WHEN 2 THEN 'END' WHEN 3 THEN 'JUSTIFIED' ELSE 'DISTRIBUTED' END AS kind FROM ports p JOIN placed d USING (graph_id, node_id) JOIN nodes o USING (graph_id, node_id)) q", TRADE_SQL, _TRADE_LAYERS, _PLACE, _PLACED, _PORTS, recursive=True)
def trade_ports_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Nodes align their ports by turns in the five ways."""
    p = _trade_ports(spark, d)[0]
    kinds = F.array(*[F.lit(k) for k in ("BEGIN", "CENTER", "END", "JUSTIFIED", "DISTRIBUTED")])
    n = _trade(spark, d)[0].select("graph_id", "node_id", F.explode(F.array(F.lit("EAST"), F.lit("WEST"))).alias("side"), F.get(kinds, F.col("ord") % 5).alias("alignment"), F.col("height").alias("extent"))
    return attachments.aligned_ports(p, n).withColumn("along", F.round("along", 6))


@query(SQL["route_points"])
def routes_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """Routes cut into their segments and joined again."""
    r = quality.elbow_routes(*transition_graphs(spark, d))
    pieces = r.select("graph_id", "edge_id", F.posexplode(g.segments(F.col("points"))).alias("piece", "s")).select("graph_id", "edge_id", "piece", F.array("s.a", "s.b").alias("points"))
    p = routing.rejoined(pieces).select("graph_id", "edge_id", F.posexplode("points").alias("k", "p"))
    return p.select("graph_id", "edge_id", F.col("k").cast("long").alias("k"), "p.x", "p.y")


@query("SELECT graph_id, node_id, CAST((layer >= 1)::INT + (layer >= 3)::INT AS INTEGER) AS \"row\", CAST(layer - CASE WHEN layer >= 3 THEN 3 WHEN layer >= 1 THEN 1 ELSE 0 END AS INTEGER) AS layer FROM lay", TRADE_SQL, _TRADE_LAYERS, recursive=True)
def trade_wrapped_at_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Rows that start at layers 1 and 3; a cut at 0 and one far beyond do nothing."""
    n, e = _trade(spark, d)
    cuts = n.select("graph_id").distinct().select("graph_id", F.explode(F.array(*map(F.lit, (0, 1, 3, 1000)))).alias("layer"))
    return graph.wrapped_at(_layers(n, e), cuts)


_ROWS = " wide AS (SELECT graph_id, layer, max(width) AS w FROM pos GROUP BY ALL), rowed AS (SELECT graph_id, 0 AS layer, 0 AS r, CAST(0 AS DOUBLE) AS s, w FROM wide WHERE layer = 0 UNION ALL SELECT p.graph_id, p.layer + 1, CASE WHEN p.s + p.w + 20 + n.w > 250 THEN p.r + 1 ELSE p.r END, CASE WHEN p.s + p.w + 20 + n.w > 250 THEN 0 ELSE p.s + p.w + 20 END, n.w FROM rowed p JOIN wide n ON n.graph_id = p.graph_id AND n.layer = p.layer + 1)"


@query("SELECT graph_id, CAST(layer AS INTEGER) AS layer, CAST(r AS INTEGER) AS \"row\", s AS start FROM rowed", TRADE_SQL, _TRADE_LAYERS, _ROWS, recursive=True)
def trade_wrapped_by_width(spark: SparkSession, d: str) -> DataFrame:
    n, e = _trade(spark, d)
    sizes = _layers(n, e).join(n.select("graph_id", "node_id", "width"), ["graph_id", "node_id"]).groupBy("graph_id", "layer").agg(F.max("width").alias("size"))
    return graph.wrapped_by_width(sizes, 250.0)


@query("SELECT s.graph_id, count(*) AS routed, count(a.edge_id) AS affected, count(*) - count(a.edge_id) AS reused, count(*) FILTER (n.node_id IN (e.source_id, e.target_id)) AS changed FROM seg0 s JOIN edges e USING (graph_id, edge_id) JOIN nodes n ON n.graph_id = s.graph_id AND n.ord = 0 LEFT JOIN (" + SQL["affected_edges"] + ") a ON a.graph_id = s.graph_id AND a.edge_id = s.edge_id GROUP BY s.graph_id", TRANSITION_SQL, _ELBOW)
def update_counts(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    before, (after, moved) = quality.elbow_routes(n, e), _moved(n)
    affected = routing.affected_edges(before, e, moved)
    return routing.update_counts(before, routing.update_routes(before, after, e, affected, quality.elbow_routes), affected)


_FRAME = " whole AS (SELECT graph_id, min(x1) AS x1, max(x2) AS x2, min(y1) AS y1, max(y2) AS y2 FROM (SELECT graph_id, x AS x1, x + width AS x2, y AS y1, y + height AS y2 FROM nodes UNION ALL SELECT graph_id, x1, x2, y1, y2 FROM seg UNION ALL SELECT graph_id, x1, x2, y1, y2 FROM lab) GROUP BY graph_id)"


@query("SELECT graph_id, 12 - x1 AS dx, 12 - y1 AS dy, x2 - x1 + 24 AS width, y2 - y1 + 24 AS height FROM whole", TRANSITION_SQL, _ELBOW, _LABEL, _FRAME)
def drawing_frames(spark: SparkSession, d: str) -> DataFrame:
    """Where drawings with their routes and labels begin, and how large they are."""
    return quality.frames(*_labelled(spark, d))


@query("SELECT graph_id, edge_id, round(sx + 12 - x1, 6) AS start_x, round(sy + 12 - y1, 6) AS start_y, round(tx + 12 - x1, 6) AS end_x, round(ty + 12 - y1, 6) AS end_y FROM seg0 JOIN whole USING (graph_id)", TRANSITION_SQL, _ELBOW, _LABEL, _FRAME)
def drawing_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes moved with their drawings."""
    n, r, at = _labelled(spark, d)
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    return quality.moved_routes(r, quality.frames(n, r, at)).select("graph_id", "edge_id", _r(first["x"], "start_x"), _r(first["y"], "start_y"), _r(last["x"], "end_x"), _r(last["y"], "end_y"))


def _counted(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT graph_id FROM ({SQL[n]})" for n in names)


_BACK = "SELECT a.graph_id FROM seg a JOIN seg b ON b.graph_id = a.graph_id AND b.edge_id = a.edge_id AND a.k < b.k WHERE (a.y1 = a.y2 AND b.y1 = b.y2 AND a.y1 = b.y1 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) > 1e-6) OR (a.x1 = a.x2 AND b.x1 = b.x2 AND a.x1 = b.x1 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 1e-6)"


@query(
    "SELECT w.graph_id, coalesce(f.defects, 0) AS defects, coalesce(c.crossings, 0) AS crossings, coalesce(o.overlap, 0.0) AS overlap, CAST(coalesce(r.bends, 0) AS BIGINT) AS bends, coalesce(r.length, 0.0) AS length, (w.x2 - w.x1) * (w.y2 - w.y1) AS area FROM whole w"
    f" LEFT JOIN (SELECT graph_id, count(*) AS defects FROM ({_counted('quality_node_hits', 'label_overlaps', 'labels_over_nodes', 'label_hits')} UNION ALL {_BACK}) GROUP BY graph_id) f USING (graph_id)"
    f" LEFT JOIN ({SQL['crossings_off_terminals']}) c USING (graph_id) LEFT JOIN ({SQL['quality_overlap']}) o USING (graph_id) LEFT JOIN (SELECT graph_id, sum(bends) AS bends, round(sum(length), 6) AS length FROM ({SQL['quality_routes']}) GROUP BY graph_id) r USING (graph_id)",
    TRANSITION_SQL, _ELBOW, _LABEL, _FRAME,
)
def quality_tuples(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    _, r, at = _labelled(spark, d)
    return measures.quality_tuples(n, e, r, at)


_OCT = " way AS (SELECT graph_id, edge_id, sx, sy, tx, ty, sx + sign(tx - sx) * least(abs(tx - sx), abs(ty - sy)) AS mx, sy + sign(ty - sy) * least(abs(tx - sx), abs(ty - sy)) AS my FROM seg0), oct AS (SELECT graph_id, edge_id, sx AS ax, sy AS ay, mx AS bx, my AS b_y FROM way UNION ALL SELECT graph_id, edge_id, mx, my, tx, ty FROM way), box AS (SELECT graph_id, 'n' || node_id AS id, x AS x1, x + width AS x2, y AS y1, y + height AS y2 FROM nodes UNION ALL SELECT graph_id, 'e' || edge_id, x1, x2, y1, y2 FROM lab)"


def _side(a: str, c: str) -> str:
    """On which side of segment ``a`` both ends of segment ``c`` lie, as the product of two signed areas."""
    return " * ".join(f"(({a}.bx - {a}.ax) * ({c}.{y} - {a}.ay) - ({a}.b_y - {a}.ay) * ({c}.{x} - {a}.ax))" for x, y in (("ax", "ay"), ("bx", "b_y")))


@query(
    "SELECT n.graph_id, coalesce(i.n, 0) AS invalid, coalesce(o.n, 0) AS overlaps, coalesce(p.n, 0) AS path_order, coalesce(c.n, 0) AS crossings, coalesce(w.n, 0) AS bends, coalesce(w.length, 0) AS length FROM (SELECT DISTINCT graph_id FROM nodes) n"
    " LEFT JOIN (SELECT graph_id, count(*) AS n FROM edges WHERE source_id = target_id GROUP BY ALL) i USING (graph_id)"
    " LEFT JOIN (SELECT a.graph_id, count(*) AS n FROM box a JOIN box b ON a.graph_id = b.graph_id AND a.id < b.id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 GROUP BY ALL) o USING (graph_id)"
    " LEFT JOIN (SELECT a.graph_id, count(*) AS n FROM nodes a JOIN nodes b ON b.graph_id = a.graph_id AND b.ord = a.ord + 1 AND b.x <= a.x GROUP BY ALL) p USING (graph_id)"
    f" LEFT JOIN (SELECT a.graph_id, count(*) AS n FROM oct a JOIN oct b ON a.graph_id = b.graph_id AND a.edge_id < b.edge_id AND {_side('a', 'b')} < 0 AND {_side('b', 'a')} < 0 GROUP BY ALL) c USING (graph_id)"
    " LEFT JOIN (SELECT graph_id, count(*) AS n, round(sum(least(abs(tx - sx), abs(ty - sy)) * sqrt(2) + abs(abs(tx - sx) - abs(ty - sy))), 6) AS length FROM seg0 GROUP BY ALL) w USING (graph_id)",
    TRANSITION_SQL, _ELBOW, _LABEL, _OCT,
)
def statechart_scores(spark: SparkSession, d: str) -> DataFrame:
    """Octilinear routes, labels in the middle of elbows, and a path through all nodes; self-loops have no route."""
    n, e = transition_graphs(spark, d)
    r = routing.octilinear_routes(n, e)
    return measures.statechart_scores(n, e, r, _labelled(spark, d)[2], n.select("graph_id", F.col("ord").alias("k"), "node_id"))


@query("SELECT graph_id, node_id, x, y, CASE WHEN x = max(x) OVER (PARTITION BY graph_id, y) THEN max(x + width) OVER (PARTITION BY graph_id) - x ELSE width END AS width, max(height) OVER (PARTITION BY graph_id, y) AS height FROM shelf", TRANSITION_SQL, *_shelf(15.0, 15.0, "s.x + s.width + 15.0 + i.width > i.most", "n.ord % 2 DESC, n.y, n.x, n.width * n.height, n.ord", _BOX), recursive=True)
def arrange_box_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Odd nodes first, then by authored place; boxes fill their rows."""
    n = transition_graphs(spark, d)[0].withColumn("first", F.col("ord") % 2)
    return packing.box_packing(n, priority="first", interactive=True, expand=True)


@query("SELECT graph_id, CAST(k AS INTEGER) - 1 AS k, s >> 47 = 1 AS flag, (s >> 24) / 16777216.0 AS fraction, CAST(CASE WHEN s >> 16 >= 2147483648 THEN (s >> 16) - 4294967296 ELSE s >> 16 END AS INTEGER) AS number FROM lcg WHERE k > 0", TRANSITION_SQL, _LCG.format(most=5), recursive=True)
def lcg_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Booleans, fractions and integers of each graph's generator, five draws each."""
    seed = F.col("graph_id").cast("long")
    of = F.arrays_zip(*[packing.lcg_bits(5, seed, b).alias(f"b{b}") for b in (1, 24, 32)])
    r = transition_graphs(spark, d)[0].select("graph_id").distinct().select("graph_id", F.posexplode(of).alias("k", "z"))
    signed = F.when(F.col("z.b32") >= 1 << 31, F.col("z.b32") - (1 << 32)).otherwise(F.col("z.b32"))
    return r.select("graph_id", "k", (F.col("z.b1") == 1).alias("flag"), (F.col("z.b24") / float(1 << 24)).alias("fraction"), signed.cast("int").alias("number"))


_CROSS = " seen AS (SELECT l.graph_id, l.node_id, l.layer, n.y, n.width, n.height, row_number() OVER (PARTITION BY l.graph_id, l.layer ORDER BY n.y + n.height / 2, n.ord) - 1 AS pos FROM lay l JOIN nodes n USING (graph_id, node_id)), pushed AS (SELECT b.graph_id, b.node_id, max(a.y + coalesce((SELECT sum(c.height + 20) FROM seen c WHERE c.graph_id = b.graph_id AND c.layer = b.layer AND c.pos >= a.pos AND c.pos < b.pos), 0)) AS y FROM seen b JOIN seen a ON a.graph_id = b.graph_id AND a.layer = b.layer AND a.pos <= b.pos GROUP BY ALL)"


@query("SELECT s.graph_id, s.node_id, CAST(s.layer AS INTEGER) AS layer, x0 + (lw - s.width) / 2 AS x, p.y - min(p.y) OVER (PARTITION BY s.graph_id) + 12.0 AS y, s.width, s.height FROM seen s JOIN pushed p USING (graph_id, node_id) JOIN lx ON lx.graph_id = s.graph_id AND lx.layer = s.layer", TRADE_SQL, _TRADE_LAYERS, _PLACE, _CROSS, recursive=True)
def trade_places_by_cross(spark: SparkSession, d: str) -> DataFrame:
    """The layered arrangement with two phases of our choice: order and heights follow authored places."""
    n, e = _trade(spark, d)
    return registry.arrange(n, e, "layered", order_nodes=graph.order_by_place, place_nodes=graph.place_by_cross)

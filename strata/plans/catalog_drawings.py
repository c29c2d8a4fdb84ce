"""Queries over labels, scans by place, ports, options, constraints and random places, and a larger graph family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import constraints, graph, labels, options, packing, quality, scans
from ..operators import kernels as K
from ..sources.graphs import TRADE_SQL, TRANSITION_SQL, trade_graphs, transition_graphs
from .catalog import _DAG_LAYERS, _ELBOW, _ENDS, _PLACE, _layers, query
from .runner import per_graph

#: Layers without one row a path: the graphs of this family have too many.
_TRADE_LAYERS = _DAG_LAYERS.replace("UNION ALL SELECT w.graph_id, e.t, w.d + 1", "UNION SELECT w.graph_id, e.t, w.d + 1")


def _trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = trade_graphs(spark, d)
    return n, graph.oriented(e, graph.model_order_orientation(n, e))


@query("SELECT graph_id, node_id, CAST(layer AS INTEGER) AS layer, pos FROM pos", TRADE_SQL, _TRADE_LAYERS, recursive=True)
def trade_layers(spark: SparkSession, d: str) -> DataFrame:
    n, e = _trade(spark, d)
    return graph.order_in_layers(n, _layers(n, e))


@query("SELECT a.graph_id, a.sl AS layer, count(*) AS crossings FROM ends a JOIN ends b ON a.graph_id = b.graph_id AND a.sl = b.sl AND a.sp < b.sp AND a.tp > b.tp GROUP BY ALL", TRADE_SQL, _TRADE_LAYERS, _ENDS, recursive=True)
def trade_crossings(spark: SparkSession, d: str) -> DataFrame:
    n, e = _trade(spark, d)
    return graph.layer_crossings(e, graph.order_in_layers(n, _layers(n, e)))


@query("SELECT p.graph_id, p.node_id, p.layer, round(coalesce(m.b, p.pos), 6) AS barycenter, row_number() OVER (PARTITION BY p.graph_id, p.layer ORDER BY coalesce(m.b, p.pos), p.pos) - 1 AS pos FROM pos p LEFT JOIN (SELECT graph_id, t AS node_id, sum(sp) / count(*) AS b FROM ends GROUP BY ALL) m USING (graph_id, node_id)", TRADE_SQL, _TRADE_LAYERS, _ENDS, recursive=True)
def trade_barycenters(spark: SparkSession, d: str) -> DataFrame:
    n, e = _trade(spark, d)
    return graph.barycenters(e, graph.order_in_layers(n, _layers(n, e)))


@query("SELECT p.graph_id, p.node_id, p.layer, x0 + (lw - width) / 2 AS x, most / 2 - lh / 2 + coalesce(sum(height + 20.0) OVER (PARTITION BY p.graph_id, p.layer ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 12.0 AS y, width, height FROM pos p JOIN lx USING (graph_id, layer)", TRADE_SQL, _TRADE_LAYERS, _PLACE, recursive=True)
def trade_places(spark: SparkSession, d: str) -> DataFrame:
    n, e = _trade(spark, d)
    return graph.place_simple(n, graph.order_in_layers(n, _layers(n, e)))


_PLACED = " placed AS (SELECT p.graph_id, p.node_id, p.layer, p.pos, x0 + (lw - width) / 2 AS x, most / 2 - lh / 2 + coalesce(sum(height + 20.0) OVER (PARTITION BY p.graph_id, p.layer ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 12.0 AS y, width, height FROM pos p JOIN lx USING (graph_id, layer))"
_PORTS = " seat AS (SELECT d.graph_id, d.edge_id, d.s AS node_id, 'EAST' AS side, b.pos AS fp, b.layer AS fl, e.ord FROM dag d JOIN edges e USING (graph_id, edge_id) JOIN pos b ON b.graph_id = d.graph_id AND b.node_id = d.t UNION ALL SELECT d.graph_id, d.edge_id, d.t, 'WEST', a.pos, a.layer, e.ord FROM dag d JOIN edges e USING (graph_id, edge_id) JOIN pos a ON a.graph_id = d.graph_id AND a.node_id = d.s), ranked AS (SELECT *, row_number() OVER (PARTITION BY graph_id, node_id, side ORDER BY fp, fl, ord) AS r, count(*) OVER (PARTITION BY graph_id, node_id, side) AS n FROM seat), ports AS (SELECT q.graph_id, q.edge_id, q.node_id, q.side, q.r - 1 AS \"index\", CASE q.side WHEN 'EAST' THEN p.x + p.width ELSE p.x END AS x, p.y + p.height * (q.r / (q.n + 1)) AS y, p.layer FROM ranked q JOIN placed p USING (graph_id, node_id))"


def _trade_ports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = _trade(spark, d)
    order = graph.order_in_layers(n, _layers(n, e))
    return graph.placed_ports(graph.place_simple(n, order), e, order), order


@query('SELECT graph_id, edge_id, node_id, side, "index", round(x, 6) AS x, round(y, 6) AS y FROM ports', TRADE_SQL, _TRADE_LAYERS, _PLACE, _PLACED, _PORTS, recursive=True)
def trade_ports(spark: SparkSession, d: str) -> DataFrame:
    p = _trade_ports(spark, d)[0]
    return p.select("graph_id", "edge_id", "node_id", "side", "index", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_SPANS = " spans AS (SELECT a.graph_id, a.edge_id, a.layer, least(a.y, b.y) AS lo, greatest(a.y, b.y) AS hi FROM ports a JOIN ports b ON b.graph_id = a.graph_id AND b.edge_id = a.edge_id AND a.side = 'EAST' AND b.side = 'WEST' AND b.layer = a.layer + 1 AND a.y <> b.y)"


@query("SELECT graph_id, layer, max(n) AS tracks FROM (SELECT p.graph_id, p.layer, p.edge_id, count(*) AS n FROM spans p JOIN spans q ON q.graph_id = p.graph_id AND q.layer = p.layer AND q.lo <= p.lo AND q.hi > p.lo GROUP BY ALL) GROUP BY ALL", TRADE_SQL, _TRADE_LAYERS, _PLACE, _PLACED, _PORTS, _SPANS, recursive=True)
def trade_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks for vertical stretches between two layers: as many as the most of them that overlap."""
    return graph.track_demand(*_trade_ports(spark, d))


@query()
def trade_track_routes(spark: SparkSession, d: str) -> DataFrame:
    """Points of the routes between neighbouring layers, each edge with ports of its own."""
    r = graph.track_routes(*_trade_ports(spark, d))
    return r.select("graph_id", "edge_id", "track", F.posexplode("points").alias("k", "p")).select("graph_id", "edge_id", "track", "k", "p.x", "p.y")


@query("SELECT d.graph_id, d.edge_id, CAST((a.layer + b.layer) // 2 AS INTEGER) AS layer, '__dummy:' || d.edge_id || ':' || ((a.layer + b.layer) // 2) AS dummy_id, 8.0 * length(d.edge_id) AS width, CAST(12.0 AS DOUBLE) AS height FROM dag d JOIN lay a ON a.graph_id = d.graph_id AND a.node_id = d.s JOIN lay b ON b.graph_id = d.graph_id AND b.node_id = d.t WHERE b.layer - a.layer > 1", TRADE_SQL, _TRADE_LAYERS, recursive=True)
def trade_label_dummies(spark: SparkSession, d: str) -> DataFrame:
    n, e = _trade(spark, d)
    return graph.label_dummies(e, _layers(n, e), _label_sizes(e))


@query("SELECT graph_id, s AS source_id, CAST(l AS INTEGER) AS layer, count(*) AS members, arg_min(edge_id, ord) AS first_edge FROM (SELECT d.graph_id, d.s, d.edge_id, e.ord, unnest(range(a.layer + 1, b.layer)) AS l FROM dag d JOIN edges e USING (graph_id, edge_id) JOIN lay a ON a.graph_id = d.graph_id AND a.node_id = d.s JOIN lay b ON b.graph_id = d.graph_id AND b.node_id = d.t WHERE b.layer - a.layer > 1) GROUP BY ALL", TRADE_SQL, _TRADE_LAYERS, recursive=True)
def trade_merged_dummies(spark: SparkSession, d: str) -> DataFrame:
    n, e = _trade(spark, d)
    return graph.merged_dummies(e, _layers(n, e))


@query("SELECT l.graph_id, l.node_id, CAST(l.layer AS INTEGER) AS layer, row_number() OVER (PARTITION BY l.graph_id, l.layer ORDER BY n.y + n.height / 2, n.ord) - 1 AS pos FROM lay l JOIN nodes n USING (graph_id, node_id)", TRADE_SQL, _TRADE_LAYERS, recursive=True)
def trade_order_by_place(spark: SparkSession, d: str) -> DataFrame:
    n, e = _trade(spark, d)
    return graph.order_by_place(n, _layers(n, e))


@query("SELECT graph_id, node_id, CAST(layer AS INTEGER) AS layer, count(*) OVER (PARTITION BY graph_id, layer) - 1 - pos AS pos FROM pos", TRADE_SQL, _TRADE_LAYERS, recursive=True)
def trade_mirrored(spark: SparkSession, d: str) -> DataFrame:
    n, e = _trade(spark, d)
    return graph.mirrored(graph.order_in_layers(n, _layers(n, e)))


@query()
def trade_layer_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Crossings of the authored order, after sweeps, and after greedy switches."""
    def rows(ids, _, es):
        lay = K.longest_path(len(ids), es)
        start = [[a for a in range(len(ids)) if lay[a] == k] for k in range(max(lay, default=-1) + 1)]
        swept = K.layer_sweep(lay, es)
        yield tuple(int(K.count_crossings(x, es)) for x in (start, swept, K.greedy_switch(swept, es)))

    return per_graph(*_trade(spark, d), rows, "authored int, swept int, switched int")


def _label_sizes(edges: DataFrame) -> DataFrame:
    """Eight to a letter of the edge's name, one line high."""
    return edges.select("graph_id", "edge_id", (F.length("edge_id") * 8.0).alias("width"), F.lit(12.0).alias("height"))


_LABEL = " lab AS (SELECT graph_id, edge_id, (sx + tx) / 2 - 4.0 * length(edge_id) AS x1, (sx + tx) / 2 + 4.0 * length(edge_id) AS x2, (sy + ty) / 2 - 6.0 AS y1, (sy + ty) / 2 + 6.0 AS y2 FROM seg0)"


def _labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n, e = transition_graphs(spark, d)
    r = quality.elbow_routes(n, e)
    return n, r, labels.centred_labels(r, _label_sizes(e))


@query("SELECT a.graph_id, a.edge_id, b.edge_id AS other_id FROM lab a JOIN lab b ON a.graph_id = b.graph_id AND a.edge_id < b.edge_id AND a.x1 < b.x2 - 1e-6 AND a.x2 > b.x1 + 1e-6 AND a.y1 < b.y2 - 1e-6 AND a.y2 > b.y1 + 1e-6", TRANSITION_SQL, _ELBOW, _LABEL)
def label_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_overlaps(_labelled(spark, d)[2])


@query("SELECT a.graph_id, a.edge_id, b.node_id FROM lab a JOIN nodes b ON a.graph_id = b.graph_id AND a.x1 < b.x + b.width - 1e-6 AND a.x2 > b.x + 1e-6 AND a.y1 < b.y + b.height - 1e-6 AND a.y2 > b.y + 1e-6", TRANSITION_SQL, _ELBOW, _LABEL)
def labels_over_nodes(spark: SparkSession, d: str) -> DataFrame:
    n, _, at = _labelled(spark, d)
    return labels.labels_over_nodes(at, n)


@query("SELECT DISTINCT s.graph_id, s.edge_id, l.edge_id AS label_of FROM seg s JOIN lab l ON l.graph_id = s.graph_id AND l.edge_id <> s.edge_id WHERE (s.y1 = s.y2 AND s.y1 > l.y1 + 1e-6 AND s.y1 < l.y2 - 1e-6 AND least(s.x2, l.x2) - greatest(s.x1, l.x1) > 1e-6) OR (s.x1 = s.x2 AND s.x1 > l.x1 + 1e-6 AND s.x1 < l.x2 - 1e-6 AND least(s.y2, l.y2) - greatest(s.y1, l.y1) > 1e-6)", TRANSITION_SQL, _ELBOW, _LABEL)
def label_hits(spark: SparkSession, d: str) -> DataFrame:
    _, r, at = _labelled(spark, d)
    return labels.label_hits(r, at)


@query("SELECT graph_id, count(*) AS crossings FROM (SELECT DISTINCT h.graph_id, least(h.edge_id, v.edge_id) AS a, greatest(h.edge_id, v.edge_id) AS b, round(v.x1, 6) AS x, round(h.y1, 6) AS y FROM seg h JOIN seg v ON h.graph_id = v.graph_id AND h.edge_id <> v.edge_id WHERE h.y1 = h.y2 AND h.x2 > h.x1 AND v.x1 = v.x2 AND v.y2 > v.y1 AND v.x1 > h.x1 + 1e-6 AND v.x1 < h.x2 - 1e-6 AND h.y1 > v.y1 + 1e-6 AND h.y1 < v.y2 - 1e-6) c WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN edges f ON f.graph_id = e.graph_id JOIN nodes n ON n.graph_id = e.graph_id AND n.node_id IN (e.source_id, e.target_id) AND n.node_id IN (f.source_id, f.target_id) WHERE e.graph_id = c.graph_id AND e.edge_id = c.a AND f.edge_id = c.b AND c.x BETWEEN n.x - 12 AND n.x + n.width + 12 AND c.y BETWEEN n.y - 12 AND n.y + n.height + 12) GROUP BY graph_id", TRANSITION_SQL, _ELBOW)
def crossings_off_terminals(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    return quality.crossings_off_terminals(quality.elbow_routes(n, e), e, n)


@query("SELECT graph_id, node_id, before_id FROM (SELECT a.graph_id, a.node_id, b.node_id AS before_id, row_number() OVER (PARTITION BY a.graph_id, a.node_id ORDER BY b.x + b.width / 2 DESC, b.node_id DESC) AS k FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node_id <> b.node_id AND a.y < b.y + b.height + 20 AND b.y - 20 < a.y + a.height AND (b.x + b.width / 2, b.node_id) < (a.x + a.width / 2, a.node_id)) WHERE k = 1", TRANSITION_SQL)
def nearest_before(spark: SparkSession, d: str) -> DataFrame:
    return scans.nearest_before(transition_graphs(spark, d)[0], 20.0)


@query("SELECT graph_id, edge_id, other_id, round(sum(n), 6) AS shared FROM (SELECT a.graph_id, a.edge_id, b.edge_id AS other_id, CASE WHEN a.y1 = a.y2 THEN least(a.x2, b.x2) - greatest(a.x1, b.x1) ELSE least(a.y2, b.y2) - greatest(a.y1, b.y1) END AS n FROM seg a JOIN seg b ON a.graph_id = b.graph_id AND a.edge_id < b.edge_id WHERE (a.y1 = a.y2 AND b.y1 = b.y2 AND a.x2 - a.x1 > 1e-6 AND b.x2 - b.x1 > 1e-6 AND abs(a.y1 - b.y1) < 10) OR (a.x1 = a.x2 AND b.x1 = b.x2 AND a.y2 - a.y1 > 1e-6 AND b.y2 - b.y1 > 1e-6 AND abs(a.x1 - b.x1) < 10)) WHERE n > 1e-6 GROUP BY ALL", TRANSITION_SQL, _ELBOW)
def segment_conflicts(spark: SparkSession, d: str) -> DataFrame:
    r = scans.segment_conflicts(quality.elbow_routes(*transition_graphs(spark, d)), 10.0)
    return r.withColumn("shared", F.round("shared", 6))


_CUT = " hit AS (SELECT s.graph_id, s.edge_id, s.k, CASE WHEN s.y1 = s.y2 THEN greatest(s.x1, n.x) ELSE greatest(s.y1, n.y) END AS a, CASE WHEN s.y1 = s.y2 THEN least(s.x2, n.x + n.width) ELSE least(s.y2, n.y + n.height) END AS b FROM seg s JOIN nodes n USING (graph_id) WHERE (s.y1 = s.y2 AND s.x2 > s.x1 AND s.y1 > n.y + 1e-6 AND s.y1 < n.y + n.height - 1e-6 AND s.x1 < n.x + n.width AND n.x < s.x2) OR (s.x1 = s.x2 AND s.y2 > s.y1 AND s.x1 > n.x + 1e-6 AND s.x1 < n.x + n.width - 1e-6 AND s.y1 < n.y + n.height AND n.y < s.y2)), far AS (SELECT *, max(b) OVER (PARTITION BY graph_id, edge_id, k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM hit), gone AS (SELECT graph_id, edge_id, k, sum(greatest(0, b - greatest(a, coalesce(upto, a)))) AS n FROM far GROUP BY ALL)"


@query("SELECT s.graph_id, s.edge_id, s.k, round(x2 - x1 + y2 - y1 - coalesce(n, 0), 6) + 0.0 AS outside FROM seg s LEFT JOIN gone USING (graph_id, edge_id, k)", TRANSITION_SQL, _ELBOW, _CUT)
def outside_nodes(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    return scans.outside_nodes(quality.elbow_routes(n, e), n).withColumn("outside", F.round("outside", 6) + 0.0)


@query("SELECT DISTINCT n.graph_id, n.node_id AS point_id, s.edge_id FROM nodes n JOIN seg s USING (graph_id) WHERE n.x + n.width / 2 BETWEEN s.x1 - 1e-6 AND s.x2 + 1e-6 AND n.y + n.height / 2 BETWEEN s.y1 - 1e-6 AND s.y2 + 1e-6 AND abs((s.x2 - s.x1) * (n.y + n.height / 2 - s.y1) - (s.y2 - s.y1) * (n.x + n.width / 2 - s.x1)) < 1e-6", TRANSITION_SQL, _ELBOW)
def nodes_on_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes that pass the very middle of a node, their own ends too."""
    n, e = transition_graphs(spark, d)
    middles = n.select("graph_id", F.col("node_id").alias("point_id"), F.expr("x + width / 2").alias("x"), F.expr("y + height / 2").alias("y"))
    return scans.on_routes(middles, quality.elbow_routes(n, e))


@query("SELECT graph_id, edge_id, k - 1 AS k, x, y FROM (SELECT graph_id, edge_id, row_number() OVER (PARTITION BY graph_id, edge_id ORDER BY i) AS k, x, y FROM (SELECT graph_id, edge_id, 0 AS i, sx AS x, sy AS y FROM seg0 UNION ALL SELECT graph_id, edge_id, 1, (sx + tx) / 2, sy FROM seg0 WHERE sx <> tx AND sy <> ty UNION ALL SELECT graph_id, edge_id, 2, (sx + tx) / 2, ty FROM seg0 WHERE sx <> tx AND sy <> ty UNION ALL SELECT graph_id, edge_id, 3, tx, ty FROM seg0 WHERE sx <> tx OR sy <> ty))", TRANSITION_SQL, _ELBOW)
def route_points(spark: SparkSession, d: str) -> DataFrame:
    """Routes as rows of points, without those that straight runs don't need."""
    r = quality.elbow_routes(*transition_graphs(spark, d)).select("graph_id", "edge_id", F.posexplode(g.simplify(F.col("points"))).alias("k", "p"))
    return r.select("graph_id", "edge_id", F.col("k").cast("long").alias("k"), "p.x", "p.y")


def _along(s: str) -> str:
    """Where an elbow of ``seg0`` is after the way ``s``, as SQL for x and y."""
    a, b = "abs(tx - sx) / 2", "abs(ty - sy)"
    x = f"CASE WHEN {s} <= {a} THEN sx + sign(tx - sx) * {s} WHEN {s} <= {a} + {b} THEN (sx + tx) / 2 ELSE (sx + tx) / 2 + sign(tx - sx) * ({s} - {a} - {b}) END"
    y = f"CASE WHEN {s} <= {a} THEN sy WHEN {s} <= {a} + {b} THEN sy + sign(ty - sy) * ({s} - {a}) ELSE ty END"
    return f"round({x}, 6) + 0.0 AS {{0}}_x, round({y}, 6) + 0.0 AS {{0}}_y"


_LONG = "(abs(tx - sx) + abs(ty - sy))"
_FROM, _UPTO = f"least(15.0, {_LONG})", f"greatest(least(15.0, {_LONG}), {_LONG} - 10.0)"


@query(f"SELECT graph_id, edge_id, {_along(_FROM).format('start')}, {_along(_UPTO).format('end')}, round({_UPTO} - {_FROM}, 6) + 0.0 AS length FROM seg0", TRANSITION_SQL, _ELBOW)
def route_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Routes without their first 15 and last 10."""
    r = quality.elbow_routes(*transition_graphs(spark, d)).select("graph_id", "edge_id", g.trimmed(F.col("points"), F.lit(15.0), F.lit(10.0)).alias("p"))
    at = lambda i, c, n: (F.round(F.element_at("p", i)[c], 6) + 0.0).alias(f"{n}_{c}")
    return r.select("graph_id", "edge_id", at(1, "x", "start"), at(1, "y", "start"), at(-1, "x", "end"), at(-1, "y", "end"), (F.round(g.path_length(F.col("p")), 6) + 0.0).alias("length"))


@query(f"SELECT graph_id, edge_id, round({_LONG} / 3, 6) + 0.0 AS before_length, round({_LONG} - {_LONG} / 3, 6) + 0.0 AS after_length, {_along(f'({_LONG} / 3)').format('cut')} FROM seg0", TRANSITION_SQL, _ELBOW)
def route_split(spark: SparkSession, d: str) -> DataFrame:
    """Routes cut after a third."""
    r = quality.elbow_routes(*transition_graphs(spark, d)).select("graph_id", "edge_id", g.split(F.col("points"), g.path_length(F.col("points")) / 3).alias("s"))
    cut = F.element_at("s.before", -1)
    return r.select("graph_id", "edge_id", (F.round(g.path_length(F.col("s.before")), 6) + 0.0).alias("before_length"), (F.round(g.path_length(F.col("s.after")), 6) + 0.0).alias("after_length"), (F.round(cut["x"], 6) + 0.0).alias("cut_x"), (F.round(cut["y"], 6) + 0.0).alias("cut_y"))


@query("SELECT graph_id, edge_id, edge_id || '_s0' AS section_id, sx AS start_x, sy AS start_y, CASE WHEN sx <> tx AND sy <> ty THEN 2 ELSE 0 END AS n_bends, tx AS end_x, ty AS end_y FROM seg0", TRANSITION_SQL, _ELBOW)
def route_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of routes: start, bends, end."""
    s = quality.elbow_routes(*transition_graphs(spark, d)).select("graph_id", "edge_id", g.section(F.col("edge_id"), g.simplify(F.col("points"))).alias("s"))
    return s.select("graph_id", "edge_id", F.col("s.id").alias("section_id"), F.col("s.startPoint.x").alias("start_x"), F.col("s.startPoint.y").alias("start_y"), F.size("s.bendPoints").alias("n_bends"), F.col("s.endPoint.x").alias("end_x"), F.col("s.endPoint.y").alias("end_y"))


_SCOPES = ("1-URGENT", "2-HIGH", "3-MEDIUM")


def _order_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of customers' graphs from their orders: the scope is the priority, names are long for every other order."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    long_name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("draw.layered."), F.col("o_orderstatus"))).otherwise(F.col("o_orderstatus"))
    return o.select(F.col("o_custkey").cast("string").alias("graph_id"), F.col("o_orderpriority").alias("scope"), long_name.alias("name"), F.col("o_orderkey").cast("string").alias("value")).groupBy("graph_id", "scope", "name").agg(F.min("value").alias("value"))


_OPTIONS = " opt AS (SELECT CAST(o_custkey AS VARCHAR) AS graph_id, o_orderpriority AS scope, CASE WHEN o_orderkey % 2 = 0 THEN 'draw.layered.' ELSE '' END || o_orderstatus AS name, min(CAST(o_orderkey AS VARCHAR)) AS value FROM orders GROUP BY ALL), best AS (SELECT graph_id, split_part(name, '.', -1) AS option, value, scope, row_number() OVER (PARTITION BY graph_id, split_part(name, '.', -1) ORDER BY scope, length(name), name) AS k FROM opt WHERE scope IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))"


@query("SELECT graph_id, option, value, scope FROM best WHERE k = 1", _OPTIONS)
def option_merge(spark: SparkSession, d: str) -> DataFrame:
    return options.merged_options(_order_options(spark, d), _SCOPES)


@query("SELECT g.graph_id, f.option, coalesce(b.value, f.fallback) AS value, b.value IS NULL AS is_default FROM (SELECT DISTINCT graph_id FROM opt) g, (VALUES ('F', 'none'), ('P', '20')) f(option, fallback) LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON b.graph_id = g.graph_id AND b.option = f.option", _OPTIONS)
def option_defaults(spark: SparkSession, d: str) -> DataFrame:
    o = _order_options(spark, d)
    return options.with_defaults(options.merged_options(o, _SCOPES), o, {"P": "20", "F": "none"})


@query("SELECT l.graph_id, l.node_id, round(coalesce(arg_min(n.x + n.width / 2, n.node_id) FILTER (n.ord % 4 = 0) OVER g, avg(n.x + n.width / 2) OVER g) - n.width / 2, 6) AS x FROM lay l JOIN nodes n USING (graph_id, node_id) WINDOW g AS (PARTITION BY l.graph_id, l.layer)", TRADE_SQL, _TRADE_LAYERS, recursive=True)
def constraints_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Layers as groups; every fourth node is pinned where it stands."""
    n, e = _trade(spark, d)
    groups = _layers(n, e).withColumnRenamed("layer", "group_id")
    pins = n.where("ord % 4 = 0").select("graph_id", "node_id", F.expr("x + width / 2").alias("at"))
    return constraints.aligned(n, groups, pins).withColumn("x", F.round("x", 6))


@query("SELECT graph_id, node_id, round(CASE WHEN c > 1 THEN first + coalesce(sum(width) OVER (PARTITION BY graph_id, layer ORDER BY x, node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (last - first - total) / (c - 1) * (row_number() OVER (PARTITION BY graph_id, layer ORDER BY x, node_id) - 1) ELSE x END, 6) AS x FROM (SELECT l.graph_id, l.node_id, l.layer, n.x, n.width, count(*) OVER g AS c, sum(n.width) OVER g AS total, min(n.x) OVER g AS first, last_value(n.x + n.width) OVER (PARTITION BY l.graph_id, l.layer ORDER BY n.x, n.node_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM lay l JOIN nodes n USING (graph_id, node_id) WINDOW g AS (PARTITION BY l.graph_id, l.layer))", TRADE_SQL, _TRADE_LAYERS, recursive=True)
def constraints_distributed(spark: SparkSession, d: str) -> DataFrame:
    n, e = _trade(spark, d)
    return constraints.distributed(n, _layers(n, e).withColumnRenamed("layer", "group_id")).withColumn("x", F.round("x", 6))


_LCG = " lcg AS (SELECT graph_id, 0 AS k, xor(CAST(graph_id AS BIGINT), 25214903917) & 281474976710655 AS s FROM (SELECT DISTINCT graph_id FROM nodes) UNION ALL SELECT graph_id, k + 1, CAST((CAST(s AS HUGEINT) * 25214903917 + 11) % 281474976710656 AS BIGINT) FROM lcg WHERE k < {most}), draw AS (SELECT a.graph_id, a.k // 2 AS k, ((a.s >> 22) * 134217728 + (b.s >> 21)) / 9007199254740992.0 AS d FROM lcg a JOIN lcg b ON b.graph_id = a.graph_id AND b.k = a.k + 1 WHERE a.k % 2 = 1)"


@query("SELECT graph_id, CAST(k AS INTEGER) AS k, round(d, 12) AS d FROM draw", TRANSITION_SQL, _LCG.format(most=8), recursive=True)
def lcg_draws(spark: SparkSession, d: str) -> DataFrame:
    """The first four draws of each graph's generator."""
    n = transition_graphs(spark, d)[0].select("graph_id").distinct()
    r = n.select("graph_id", F.posexplode(packing.lcg_doubles(4, F.col("graph_id").cast("long"))).alias("k", "d"))
    return r.select("graph_id", "k", F.round("d", 12).alias("d"))


_RANDOM = " room AS (SELECT n.graph_id, any_value(n.a) AS area, greatest(sqrt(any_value(n.a) + 450.0 * (1 + count(e.edge_id)) * any_value(n.c)) * 1.6, any_value(n.w)) AS w, greatest(sqrt(any_value(n.a) + 450.0 * (1 + count(e.edge_id)) * any_value(n.c)) / 1.6, any_value(n.h)) AS h FROM (SELECT graph_id, sum(width * height) AS a, count(*) AS c, max(width) AS w, max(height) AS h FROM nodes GROUP BY graph_id) n LEFT JOIN edges e USING (graph_id) GROUP BY n.graph_id)"


@query("SELECT n.graph_id, n.node_id, round(12.0 + a.d * (r.w - n.width), 6) AS x, round(12.0 + b.d * (r.h - n.height), 6) AS y, n.width, n.height FROM nodes n JOIN room r USING (graph_id) JOIN draw a ON a.graph_id = n.graph_id AND a.k = n.ord * 2 JOIN draw b ON b.graph_id = n.graph_id AND b.k = n.ord * 2 + 1", TRANSITION_SQL, _LCG.format(most=40), _RANDOM, recursive=True)
def arrange_random(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    out = packing.random_places(n, e, F.col("graph_id").cast("long"))
    return out.select("graph_id", "node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "width", "height")


@query("SELECT graph_id, edge_id, round(abs(tx - sx) / 2, 6) AS retraced FROM seg0 WHERE abs(tx - sx) / 2 > 1e-6 AND sy <> ty UNION ALL SELECT graph_id, edge_id, round(abs(tx - sx) / 2, 6) FROM seg0 WHERE abs(tx - sx) / 2 > 1e-6 AND sy = ty", TRANSITION_SQL, _ELBOW)
def self_retraces(spark: SparkSession, d: str) -> DataFrame:
    """Routes that go back over their last segment."""
    r = quality.elbow_routes(*transition_graphs(spark, d))
    back = r.select("graph_id", "edge_id", F.concat("points", F.array(F.element_at("points", 3))).alias("points"))
    return quality.self_retraces(back).withColumn("retraced", F.round("retraced", 6))


@query("SELECT graph_id, node_id, least(x, x + width / 2 - 4.0 * length(node_id)) AS x, y, greatest(x + width, x + width / 2 + 4.0 * length(node_id)) - least(x, x + width / 2 - 4.0 * length(node_id)) AS width, height + 12.0 AS height FROM nodes", TRANSITION_SQL)
def node_and_label_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a label below them."""
    n = transition_graphs(spark, d)[0]
    half = F.length("node_id") * 4.0
    label = n.select("graph_id", "node_id", (F.expr("x + width / 2") - half).alias("x1"), (F.expr("x + width / 2") + half).alias("x2"), F.expr("y + height").alias("y1"), F.expr("y + height + 12.0").alias("y2"))
    return quality.unions(n, label)


@query("SELECT graph_id, node_id, floor(width / 3 * 64 + 0.5) / 64 AS width, floor(height / 7 * 64 + 0.5) / 64 AS height FROM nodes", TRANSITION_SQL)
def snapped_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = transition_graphs(spark, d)[0]
    return n.select("graph_id", "node_id", g.snap(F.col("width") / 3).alias("width"), g.snap(F.col("height") / 7).alias("height"))


@query("SELECT graph_id, node_id, CASE WHEN ord % 2 = 0 THEN ord + 0.5 ELSE ord END AS top, CASE WHEN ord % 2 = 0 THEN ord + 0.5 ELSE 0 END AS \"right\", CASE WHEN ord % 2 = 0 THEN ord + 0.5 ELSE 0 END AS bottom, CASE WHEN ord % 2 = 0 THEN ord + 0.5 ELSE 2 * ord END AS \"left\" FROM nodes", TRANSITION_SQL)
def parsed_paddings(spark: SparkSession, d: str) -> DataFrame:
    """Paddings written as one number or by side."""
    n = transition_graphs(spark, d)[0]
    text = F.when(F.col("ord") % 2 == 0, F.concat(F.col("ord").cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit("[top="), F.col("ord").cast("string"), F.lit(", left = "), (F.col("ord") * 2).cast("string"), F.lit("]")))
    return n.select("graph_id", "node_id", g.parse_padding(text).alias("p")).select("graph_id", "node_id", "p.top", "p.right", "p.bottom", "p.left")

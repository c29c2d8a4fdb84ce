"""Queries over the graph families, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph as G
from ..operators import kernels as K
from ..operators import packing as P
from ..operators import large, patches, quality
from ..sources.graphs import CONTAINMENT_SQL, TRANSITION_SQL, containment, transition_graphs
from .runner import per_graph

QUERIES, SQL = {}, {}
_ORIENT = """
ori AS (SELECT e.graph_id, e.edge_id, s.ord > t.ord AS reversed, e.source_id, e.target_id, e.ord, e.weight
  FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.source_id JOIN nodes t ON t.graph_id = e.graph_id AND t.node_id = e.target_id),
dag AS (SELECT graph_id, edge_id, CASE WHEN reversed THEN target_id ELSE source_id END AS s, CASE WHEN reversed THEN source_id ELSE target_id END AS t FROM ori WHERE source_id <> target_id)"""
_LAYERS = _ORIENT + """,
walk AS (SELECT graph_id, node_id, 0 AS d FROM nodes UNION ALL SELECT w.graph_id, e.t, w.d + 1 FROM walk w JOIN (SELECT DISTINCT graph_id, s, t FROM dag) e ON e.graph_id = w.graph_id AND e.s = w.node_id),
lay AS (SELECT graph_id, node_id, max(d) AS layer FROM walk GROUP BY ALL),
pos AS (SELECT l.graph_id, l.node_id, l.layer, row_number() OVER (PARTITION BY l.graph_id, l.layer ORDER BY n.ord) - 1 AS pos, n.width, n.height
  FROM lay l JOIN nodes n USING (graph_id, node_id))"""
_DAG_ORIENT, _DAG_LAYERS = _ORIENT, _LAYERS
_ELBOW = """
seg0 AS (SELECT e.graph_id, e.edge_id, s.x + s.width / 2 AS sx, s.y + s.height / 2 AS sy, t.x + t.width / 2 AS tx, t.y + t.height / 2 AS ty
  FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.source_id JOIN nodes t ON t.graph_id = e.graph_id AND t.node_id = e.target_id WHERE e.source_id <> e.target_id),
seg AS (SELECT graph_id, edge_id, 0 AS k, least(sx, (sx + tx) / 2) AS x1, greatest(sx, (sx + tx) / 2) AS x2, sy AS y1, sy AS y2 FROM seg0
  UNION ALL SELECT graph_id, edge_id, 1, (sx + tx) / 2, (sx + tx) / 2, least(sy, ty), greatest(sy, ty) FROM seg0
  UNION ALL SELECT graph_id, edge_id, 2, least(tx, (sx + tx) / 2), greatest(tx, (sx + tx) / 2), ty, ty FROM seg0)"""


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{','.join(ctes)} " if ctes else "") + sql
        return f

    return add


def _dag(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = transition_graphs(spark, d)
    return n, G.oriented(e, G.model_order_orientation(n, e))


def _layers(n: DataFrame, e: DataFrame, from_sink: bool = False) -> DataFrame:
    return per_graph(n, e, lambda ids, _, es: zip(ids, K.longest_path(len(ids), es, from_sink), strict=True), "node_id string, layer int")


@query("SELECT n.graph_id, n.node_id, CAST(coalesce(o.w, 0) AS BIGINT) AS out_weight, CAST(coalesce(i.w, 0) AS BIGINT) AS in_weight FROM nodes n LEFT JOIN (SELECT graph_id, source_id AS node_id, sum(weight) AS w FROM edges WHERE source_id <> target_id GROUP BY ALL) o USING (graph_id, node_id) LEFT JOIN (SELECT graph_id, target_id AS node_id, sum(weight) AS w FROM edges WHERE source_id <> target_id GROUP BY ALL) i USING (graph_id, node_id)", TRANSITION_SQL)
def degree_weighted(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(*transition_graphs(spark, d))


@query("SELECT graph_id, node_id, string_agg(n, ',' ORDER BY ord, n) AS neighbours FROM (SELECT graph_id, source_id AS node_id, target_id AS n, ord FROM edges WHERE source_id <> target_id UNION ALL SELECT graph_id, target_id, source_id, ord FROM edges WHERE source_id <> target_id) GROUP BY ALL", TRANSITION_SQL)
def adjacency_lists(spark: SparkSession, d: str) -> DataFrame:
    return G.adjacency(transition_graphs(spark, d)[1])


@query("SELECT graph_id, edge_id FROM edges WHERE source_id = 'error' OR target_id = 'error'", TRANSITION_SQL)
def dangling_endpoints(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    return G.dangling(n.where("node_id <> 'error'"), e)


@query("SELECT graph_id, edge_id FROM edges WHERE source_id IN (SELECT node_id FROM nodes n WHERE n.graph_id = edges.graph_id AND n.ord < 2)", TRANSITION_SQL)
def selection_semi(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    return e.join(n.where("ord < 2").select("graph_id", F.col("node_id").alias("source_id")), ["graph_id", "source_id"], "left_semi").select("graph_id", "edge_id")


@query("SELECT r.graph_id, r.node_id, min(n.ord) AS component FROM reach r JOIN nodes n ON n.graph_id = r.graph_id AND n.node_id = r.other GROUP BY ALL", TRANSITION_SQL, " reach AS (SELECT graph_id, node_id, node_id AS other FROM nodes UNION SELECT r.graph_id, r.node_id, CASE WHEN e.source_id = r.other THEN e.target_id ELSE e.source_id END FROM reach r JOIN edges e ON e.graph_id = r.graph_id AND r.other IN (e.source_id, e.target_id))", recursive=True)
def components(spark: SparkSession, d: str) -> DataFrame:
    kernel = lambda n, e: per_graph(n, e, lambda ids, _, es: zip(ids, K.components(len(ids), es), strict=True), "node_id string, component long")
    return large.by_size(*transition_graphs(spark, d), kernel, large.components)


_UP = " up AS (SELECT graph_id, node_id, parent_id AS ancestor_id, 1 AS depth FROM geo WHERE parent_id IS NOT NULL UNION ALL SELECT u.graph_id, u.node_id, g.parent_id, u.depth + 1 FROM up u JOIN geo g ON g.graph_id = u.graph_id AND g.node_id = u.ancestor_id WHERE g.parent_id IS NOT NULL)"


@query("SELECT graph_id, node_id, ancestor_id, depth FROM up", CONTAINMENT_SQL, _UP, recursive=True)
def ancestors_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.closure(containment(spark, d))


@query("SELECT g.graph_id, g.node_id, any_value(g.x) + coalesce(sum(a.x), 0) AS world_x, any_value(g.y) + coalesce(sum(a.y), 0) AS world_y FROM geo g LEFT JOIN up u USING (graph_id, node_id) LEFT JOIN geo a ON a.graph_id = u.graph_id AND a.node_id = u.ancestor_id GROUP BY g.graph_id, g.node_id", CONTAINMENT_SQL, _UP, recursive=True)
def world_frames(spark: SparkSession, d: str) -> DataFrame:
    return G.world_frames(containment(spark, d))


@query("SELECT graph_id, edge_id, reversed FROM ori", TRANSITION_SQL, _ORIENT)
def cycle_model_order(spark: SparkSession, d: str) -> DataFrame:
    return G.model_order_orientation(*transition_graphs(spark, d))


@query("SELECT e.graph_id, e.edge_id, t.x + t.width / 2 < s.x + s.width / 2 AS reversed FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.source_id JOIN nodes t ON t.graph_id = e.graph_id AND t.node_id = e.target_id", TRANSITION_SQL)
def cycle_interactive_predicate(spark: SparkSession, d: str) -> DataFrame:
    return G.interactive_orientation(*transition_graphs(spark, d))


def _acyclic(name: str, kernel):
    def run(spark: SparkSession, d: str) -> DataFrame:
        """Which edges the kernel turns round so that no cycle is left; self-loops stay."""
        def rows(ids, names, es):
            back = kernel(len(ids), es)
            K.longest_path(len(ids), K._flow(es, back))  # raises if a cycle is left
            yield from zip(names, map(bool, back), strict=True)

        return per_graph(*transition_graphs(spark, d), rows, "edge_id string, reversed boolean")

    run.__name__ = name
    query()(run)


_acyclic("cycle_greedy", K.greedy_orientation)
_acyclic("cycle_depth_first", K.dfs_orientation)


@query("SELECT graph_id, node_id, layer FROM lay", TRANSITION_SQL, _LAYERS, recursive=True)
def layer_longest_path_source(spark: SparkSession, d: str) -> DataFrame:
    return large.by_size(*_dag(spark, d), lambda n, e: _layers(n, e), lambda n, e: large.longest_path_layers(n, e))


@query("SELECT graph_id, node_id, max(d) OVER () * 0 + max(h) OVER (PARTITION BY graph_id) - h AS layer FROM (SELECT graph_id, node_id, max(d) AS h, 0 AS d FROM walk GROUP BY graph_id, node_id)", TRANSITION_SQL, _ORIENT, " walk AS (SELECT graph_id, node_id, 0 AS d FROM nodes UNION ALL SELECT w.graph_id, e.s, w.d + 1 FROM walk w JOIN (SELECT DISTINCT graph_id, s, t FROM dag) e ON e.graph_id = w.graph_id AND e.t = w.node_id)", recursive=True)
def layer_longest_path_sink(spark: SparkSession, d: str) -> DataFrame:
    return large.by_size(*_dag(spark, d), lambda n, e: _layers(n, e, True), lambda n, e: large.longest_path_layers(n, e, True))


@query()
def layer_network_simplex(spark: SparkSession, d: str) -> DataFrame:
    return per_graph(*_dag(spark, d), lambda ids, _, es: zip(ids, K.network_simplex(len(ids), es), strict=True), "node_id string, layer int")


#: Every layering of a graph of up to five nodes, and the least weighted length of its edges among those that fit.
_EVERY = " flow AS (SELECT graph_id, s, t, sum(weight) AS w FROM (SELECT d.graph_id, d.s, d.t, e.weight FROM dag d JOIN edges e USING (graph_id, edge_id)) GROUP BY ALL), num AS (SELECT n.graph_id, n.node_id, n.ord FROM nodes n), try AS (SELECT range AS code FROM range(3125)), cost AS (SELECT f.graph_id, c.code, sum(f.w * (CAST(floor(c.code / pow(5, b.ord)) AS BIGINT) % 5 - CAST(floor(c.code / pow(5, a.ord)) AS BIGINT) % 5)) AS cost, min(CAST(floor(c.code / pow(5, b.ord)) AS BIGINT) % 5 - CAST(floor(c.code / pow(5, a.ord)) AS BIGINT) % 5) AS least FROM flow f JOIN num a ON a.graph_id = f.graph_id AND a.node_id = f.s JOIN num b ON b.graph_id = f.graph_id AND b.node_id = f.t, try c GROUP BY ALL)"


@query("SELECT graph_id, CAST(min(cost) AS BIGINT) AS cost FROM cost WHERE least >= 1 GROUP BY graph_id", TRANSITION_SQL, _ORIENT, _EVERY)
def layer_network_simplex_cost(spark: SparkSession, d: str) -> DataFrame:
    """Weighted length of all edges between the layers that network simplex finds: the least there is."""
    def rows(ids, _, es):
        layer = K.network_simplex(len(ids), es)
        if es:
            yield (int(sum(w * (layer[t] - layer[s]) for s, t, w in es)),)

    return per_graph(*_dag(spark, d), rows, "cost long")


@query()
def layer_coffman_graham(spark: SparkSession, d: str) -> DataFrame:
    return per_graph(*_dag(spark, d), lambda ids, _, es: zip(ids, K.coffman_graham(len(ids), es, 2), strict=True), "node_id string, layer int")


@query("SELECT graph_id, node_id, layer, pos FROM pos", TRANSITION_SQL, _LAYERS, recursive=True)
def in_layer_order_model(spark: SparkSession, d: str) -> DataFrame:
    n, e = _dag(spark, d)
    return G.order_in_layers(n, _layers(n, e))


@query("SELECT d.graph_id, d.edge_id, CAST(l - a.layer AS INTEGER) AS segment, CASE WHEN l = a.layer THEN d.s ELSE '__dummy:' || d.edge_id || ':' || l END AS from_id, CASE WHEN l + 1 = b.layer THEN d.t ELSE '__dummy:' || d.edge_id || ':' || (l + 1) END AS to_id, CAST(l AS INTEGER) AS layer FROM (SELECT d.*, a.layer AS sl, b.layer AS tl, unnest(range(a.layer, b.layer)) AS l FROM dag d JOIN lay a ON a.graph_id = d.graph_id AND a.node_id = d.s JOIN lay b ON b.graph_id = d.graph_id AND b.node_id = d.t) d JOIN lay a ON a.graph_id = d.graph_id AND a.node_id = d.s JOIN lay b ON b.graph_id = d.graph_id AND b.node_id = d.t", TRANSITION_SQL, _LAYERS, recursive=True)
def long_edge_split(spark: SparkSession, d: str) -> DataFrame:
    n, e = _dag(spark, d)
    return G.split_long_edges(e, _layers(n, e))


_ENDS = " ends AS (SELECT d.graph_id, d.edge_id, a.layer AS sl, a.pos AS sp, b.pos AS tp, d.t FROM dag d JOIN pos a ON a.graph_id = d.graph_id AND a.node_id = d.s JOIN pos b ON b.graph_id = d.graph_id AND b.node_id = d.t WHERE b.layer = a.layer + 1)"


@query("SELECT a.graph_id, a.sl AS layer, count(*) AS crossings FROM ends a JOIN ends b ON a.graph_id = b.graph_id AND a.sl = b.sl AND a.sp < b.sp AND a.tp > b.tp GROUP BY ALL", TRANSITION_SQL, _LAYERS, _ENDS, recursive=True)
def crossings_between_layers(spark: SparkSession, d: str) -> DataFrame:
    n, e = _dag(spark, d)
    return G.layer_crossings(e, G.order_in_layers(n, _layers(n, e)))


@query("SELECT p.graph_id, p.node_id, p.layer, round(coalesce(m.b, p.pos), 6) AS barycenter, row_number() OVER (PARTITION BY p.graph_id, p.layer ORDER BY coalesce(m.b, p.pos), p.pos) - 1 AS pos FROM pos p LEFT JOIN (SELECT graph_id, t AS node_id, sum(sp) / count(*) AS b FROM ends GROUP BY ALL) m USING (graph_id, node_id)", TRANSITION_SQL, _LAYERS, _ENDS, recursive=True)
def barycenter_step(spark: SparkSession, d: str) -> DataFrame:
    n, e = _dag(spark, d)
    return G.barycenters(e, G.order_in_layers(n, _layers(n, e)))


@query()
def layer_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Layers and positions after barycenter sweeps and greedy switches."""
    def rows(ids, _, es):
        order = K.greedy_switch(K.layer_sweep(K.longest_path(len(ids), es), es), es)
        yield from ((ids[a], k, pos) for k, row in enumerate(order) for pos, a in enumerate(row))

    return per_graph(*_dag(spark, d), rows, "node_id string, layer int, pos int")


_PLACE = """ size AS (SELECT graph_id, layer, max(width) AS lw, sum(height) + (count(*) - 1) * 20.0 AS lh FROM pos GROUP BY ALL),
lx AS (SELECT *, coalesce(sum(lw + 20.0) OVER (PARTITION BY graph_id ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 12.0 AS x0, max(lh) OVER (PARTITION BY graph_id) AS most FROM size)"""


@query("SELECT p.graph_id, p.node_id, p.layer, x0 + (lw - width) / 2 AS x, most / 2 - lh / 2 + coalesce(sum(height + 20.0) OVER (PARTITION BY p.graph_id, p.layer ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 12.0 AS y, width, height FROM pos p JOIN lx USING (graph_id, layer)", TRANSITION_SQL, _LAYERS, _PLACE, recursive=True)
def place_simple(spark: SparkSession, d: str) -> DataFrame:
    n, e = _dag(spark, d)
    return G.place_simple(n, G.order_in_layers(n, _layers(n, e)))


def _spore_sql(far: str) -> str:
    def step(c: str, size: str) -> str:
        return f"coalesce(sign({c} - lag({c}) OVER w) * {far.format(delta=f'abs({c} - lag({c}) OVER w)', need=f'lag({size}) OVER w + 20.0')}, 0.0)"

    return f"SELECT graph_id, node_id, sum(dx) OVER (PARTITION BY graph_id ORDER BY ord) + 0.0 AS x, sum(dy) OVER (PARTITION BY graph_id ORDER BY ord) + 0.0 AS y, width, height FROM (SELECT graph_id, node_id, ord, width, height, {step('x', 'width')} AS dx, {step('y', 'height')} AS dy FROM nodes WINDOW w AS (PARTITION BY graph_id ORDER BY ord))"


@query(_spore_sql("({need})"), TRANSITION_SQL)
def arrange_spore_compaction(spark: SparkSession, d: str) -> DataFrame:
    return P.relative_spread(transition_graphs(spark, d)[0], True)


@query(_spore_sql("greatest({delta}, {need})"), TRANSITION_SQL)
def arrange_spore_overlap(spark: SparkSession, d: str) -> DataFrame:
    return P.relative_spread(transition_graphs(spark, d)[0], False)


_SHELF = " shelf AS (SELECT graph_id, ord, node_id, width, height, {left} AS x, {left} AS y, height AS row, most FROM input WHERE k = 1 UNION ALL SELECT i.graph_id, i.ord, i.node_id, i.width, i.height, CASE WHEN {wrap} THEN {left} ELSE s.x + s.width + {gap} END, CASE WHEN {wrap} THEN s.y + s.row + {gap} ELSE s.y END, CASE WHEN {wrap} THEN i.height ELSE greatest(s.row, i.height) END, i.most FROM shelf s JOIN input i ON i.graph_id = s.graph_id AND i.k = s.k + 1)"


def _shelf(left: float, gap: float, wrap: str, order: str, most: str) -> tuple[str, str]:
    given = f" input AS (SELECT n.graph_id, n.ord, n.node_id, n.width, n.height, row_number() OVER (PARTITION BY n.graph_id ORDER BY {order}) AS k, m.most FROM nodes n JOIN ({most}) m USING (graph_id))"
    body = _SHELF.format(left=f"CAST({left} AS DOUBLE)", gap=gap, wrap=wrap).replace("SELECT graph_id, ord, node_id", "SELECT graph_id, k, ord, node_id", 1).replace("SELECT i.graph_id, i.ord", "SELECT i.graph_id, i.k, i.ord", 1)
    return given, body


@query("SELECT graph_id, node_id, x, y, width, height FROM shelf", TRANSITION_SQL, *_shelf(0.0, 20.0, "s.x + s.width + 20.0 + i.width > i.most", "n.ord", "SELECT graph_id, greatest(1.0, sqrt(sum((width + 20.0) * (height + 20.0))) * 1.5) AS most FROM nodes GROUP BY graph_id"), recursive=True)
def arrange_rectpack(spark: SparkSession, d: str) -> DataFrame:
    return P.rectangle_packing(transition_graphs(spark, d)[0])


_BOX = "SELECT graph_id, greatest(widest, sqrt((t2 + sqrt(t2) * 15.0) * CAST(CAST(1.3 AS FLOAT) AS DOUBLE))) + 15.0 AS most FROM (SELECT graph_id, widest, t + sqrt(t) * 30.0 AS t2 FROM (SELECT graph_id, max(width) AS widest, sum(width * height) + count(*) * coalesce(stddev_samp(width * height), 0) AS t FROM nodes GROUP BY graph_id))"


@query("SELECT graph_id, node_id, x, y, width, height FROM shelf", TRANSITION_SQL, *_shelf(15.0, 15.0, "s.x + s.width + 15.0 + i.width > i.most", "n.width * n.height, n.ord", _BOX), recursive=True)
def arrange_box(spark: SparkSession, d: str) -> DataFrame:
    return P.box_packing(transition_graphs(spark, d)[0])


@query("SELECT graph_id, node_id, x - min(x) OVER g + 12.0 AS x, y - min(y) OVER g + 12.0 AS y, width, height, max(x + width) OVER g - min(x) OVER g + 24.0 AS bounds_width, max(y + height) OVER g - min(y) OVER g + 24.0 AS bounds_height FROM nodes WINDOW g AS (PARTITION BY graph_id)", TRANSITION_SQL)
def provider_bounds(spark: SparkSession, d: str) -> DataFrame:
    return P.normalised(transition_graphs(spark, d)[0])


@query("SELECT graph_id, edge_id, round(x2 - x1 + y2 - y1, 6) AS first_part FROM seg WHERE k = 0", TRANSITION_SQL, _ELBOW)
def route_elbow(spark: SparkSession, d: str) -> DataFrame:
    r = quality.route_segments(quality.elbow_routes(*transition_graphs(spark, d)))
    return r.where("k = 0").select("graph_id", "edge_id", F.round(F.expr("x2 - x1 + y2 - y1"), 6).alias("first_part"))


@query("SELECT graph_id, edge_id, round(sum(x2 - x1 + y2 - y1), 6) AS length, round(sum(x2 - x1 + y2 - y1), 6) AS manhattan, 0 AS diagonals, CAST(2 * max(CASE WHEN k = 1 AND y2 > y1 THEN 1 ELSE 0 END) * max(CASE WHEN k = 0 AND x2 > x1 THEN 1 ELSE 0 END) AS INTEGER) AS bends FROM seg GROUP BY ALL", TRANSITION_SQL, _ELBOW)
def quality_routes(spark: SparkSession, d: str) -> DataFrame:
    return quality.route_measures(quality.elbow_routes(*transition_graphs(spark, d)))


@query("SELECT s.graph_id, s.edge_id, s.k, n.node_id FROM seg s JOIN nodes n USING (graph_id) WHERE (s.y1 = s.y2 AND s.y1 > n.y + 1e-6 AND s.y1 < n.y + n.height - 1e-6 AND least(s.x2, n.x + n.width) - greatest(s.x1, n.x) > 1e-6) OR (s.x1 = s.x2 AND s.x1 > n.x + 1e-6 AND s.x1 < n.x + n.width - 1e-6 AND least(s.y2, n.y + n.height) - greatest(s.y1, n.y) > 1e-6)", TRANSITION_SQL, _ELBOW)
def quality_node_hits(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    return quality.node_hits(quality.elbow_routes(n, e), n)


@query("SELECT graph_id, count(*) AS crossings FROM (SELECT DISTINCT h.graph_id, least(h.edge_id, v.edge_id) AS a, greatest(h.edge_id, v.edge_id) AS b, round(v.x1, 6) AS x, round(h.y1, 6) AS y FROM seg h JOIN seg v ON h.graph_id = v.graph_id AND h.edge_id <> v.edge_id WHERE h.y1 = h.y2 AND h.x2 > h.x1 AND v.x1 = v.x2 AND v.y2 > v.y1 AND v.x1 > h.x1 + 1e-6 AND v.x1 < h.x2 - 1e-6 AND h.y1 > v.y1 + 1e-6 AND h.y1 < v.y2 - 1e-6) GROUP BY graph_id", TRANSITION_SQL, _ELBOW)
def quality_crossings(spark: SparkSession, d: str) -> DataFrame:
    return quality.route_crossings(quality.elbow_routes(*transition_graphs(spark, d)))


@query("SELECT a.graph_id, a.node_id, b.node_id AS other_id, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x) AS overlap_x, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y) AS overlap_y FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node_id < b.node_id WHERE a.x < b.x + b.width AND b.x < a.x + a.width AND a.y < b.y + b.height AND b.y < a.y + a.height", TRANSITION_SQL)
def rect_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return quality.node_overlaps(transition_graphs(spark, d)[0])


@query("SELECT graph_id, edge_id, round(ax + CASE WHEN dx = 0 AND dy = 0 THEN aw / 2 ELSE dx * least(CASE WHEN dx <> 0 THEN aw / 2 / abs(dx) END, CASE WHEN dy <> 0 THEN ah / 2 / abs(dy) END) END, 6) AS x, round(ay + CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dy * least(CASE WHEN dx <> 0 THEN aw / 2 / abs(dx) END, CASE WHEN dy <> 0 THEN ah / 2 / abs(dy) END) END, 6) AS y FROM (SELECT e.graph_id, e.edge_id, s.x + s.width / 2 AS ax, s.y + s.height / 2 AS ay, s.width AS aw, s.height AS ah, t.x + t.width / 2 - s.x - s.width / 2 AS dx, t.y + t.height / 2 - s.y - s.height / 2 AS dy FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.source_id JOIN nodes t ON t.graph_id = e.graph_id AND t.node_id = e.target_id WHERE e.source_id <> e.target_id)", TRANSITION_SQL)
def border_routes(spark: SparkSession, d: str) -> DataFrame:
    r = quality.straight_routes(*transition_graphs(spark, d))
    return r.select("graph_id", "edge_id", F.round(F.expr("points[0].x"), 6).alias("x"), F.round(F.expr("points[0].y"), 6).alias("y"))


@query("SELECT graph_id, node_id, field, old, new FROM (SELECT graph_id, node_id, unnest(['x', 'y']) AS field, unnest([x, y]) AS old, unnest([CASE WHEN ord % 2 = 0 THEN x + 5 ELSE x END, CASE WHEN ord = 3 THEN NULL ELSE y END]) AS new FROM nodes) WHERE old IS DISTINCT FROM new", TRANSITION_SQL)
def patches_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = transition_graphs(spark, d)[0]
    new = n.withColumns({"x": F.when(F.col("ord") % 2 == 0, F.col("x") + 5).otherwise(F.col("x")), "y": F.when(F.col("ord") != 3, F.col("y"))})
    return patches.node_patches(n, new)


@query()
def arrange_stress(spark: SparkSession, d: str) -> DataFrame:
    def rows(ids, _, es):
        yield from ((a, float(p[0]), float(p[1])) for a, p in zip(ids, K.stress_arrangement(len(ids), es)[0], strict=True))

    return per_graph(*transition_graphs(spark, d), rows, "node_id string, x double, y double")


_NUM = "regexp_replace(regexp_replace(CAST(CAST({0} AS DECIMAL(30, 6)) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
_AT = lambda x, y: _NUM.format(x) + " || ' ' || " + _NUM.format(y)


@query(f"SELECT graph_id, edge_id, 'M ' || {_AT('sx', 'sy')} || CASE WHEN sx <> tx AND sy <> ty THEN ' L ' || {_AT('(sx + tx) / 2', 'sy')} || ' L ' || {_AT('(sx + tx) / 2', 'ty')} ELSE '' END || CASE WHEN sx <> tx OR sy <> ty THEN ' L ' || {_AT('tx', 'ty')} ELSE '' END AS path FROM seg0", TRANSITION_SQL, _ELBOW)
def svg_path_lines(spark: SparkSession, d: str) -> DataFrame:
    r = quality.elbow_routes(*transition_graphs(spark, d))
    return r.select("graph_id", "edge_id", g.svg_path(g.simplify(F.col("points"))).alias("path"))

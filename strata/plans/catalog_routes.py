"""Queries over routes, curves, updates of routes, candidates, wrapping, partitions, components and spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import curves
from ..functions import geometry as g
from ..operators import graph as G
from ..operators import quality
from ..operators import routing as R
from ..sources.graphs import TRANSITION_SQL, transition_graphs
from ..storage import written
from . import registry
from .catalog import _DAG_LAYERS as _LAYERS
from .catalog import _ELBOW, QUERIES, SQL, _dag, _layers, query

_ENDS = """ ends AS (SELECT e.graph_id, e.edge_id, e.ord, e.source_id, e.target_id, s.x + s.width / 2 AS sx, s.y + s.height / 2 AS sy, t.x + t.width / 2 AS tx, t.y + t.height / 2 AS ty,
  s.x AS nx, s.y AS ny, s.width AS sw, s.height AS sh FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.source_id JOIN nodes t ON t.graph_id = e.graph_id AND t.node_id = e.target_id)"""


def _r(c: str | Column) -> Column:
    return F.round(c, 6) + 0.0


def _elbows(spark: SparkSession, d: str) -> DataFrame:
    return quality.elbow_routes(*transition_graphs(spark, d))


@query("SELECT graph_id, edge_id, round(sx + sign(tx - sx) * m, 6) + 0.0 AS turn_x, round(sy + sign(ty - sy) * m, 6) + 0.0 AS turn_y, round(m * sqrt(2.0) + greatest(abs(tx - sx), abs(ty - sy)) - m, 6) + 0.0 AS length FROM (SELECT *, least(abs(tx - sx), abs(ty - sy)) AS m FROM ends WHERE source_id <> target_id)", TRANSITION_SQL, _ENDS)
def route_octilinear(spark: SparkSession, d: str) -> DataFrame:
    r = R.octilinear_routes(*transition_graphs(spark, d))
    return r.select("graph_id", "edge_id", _r(F.expr("points[1].x")).alias("turn_x"), _r(F.expr("points[1].y")).alias("turn_y"), _r(g.path_length(F.col("points"))).alias("length"))


_LANES = " lanes AS (SELECT *, (row_number() OVER (p ORDER BY ord) - 1 - (count(*) OVER p - 1) / 2) * 12.0 AS lane, CASE WHEN source_id < target_id THEN 1 ELSE -1 END AS way FROM ends WHERE source_id <> target_id WINDOW p AS (PARTITION BY graph_id, least(source_id, target_id), greatest(source_id, target_id))), across AS (SELECT *, (tx - sx) * way AS dx, (ty - sy) * way AS dy, sqrt((tx - sx) ** 2 + (ty - sy) ** 2) AS far FROM lanes)"


@query("SELECT graph_id, edge_id, CAST(lane AS DOUBLE) AS lane, round((sx + tx) / 2 + CASE WHEN far > 0 THEN -dy / far ELSE 0 END * lane, 6) + 0.0 AS mid_x, round((sy + ty) / 2 + CASE WHEN far > 0 THEN dx / far ELSE 1 END * lane, 6) + 0.0 AS mid_y FROM across", TRANSITION_SQL, _ENDS, _LANES)
def route_parallel(spark: SparkSession, d: str) -> DataFrame:
    r = R.parallel_lanes(*transition_graphs(spark, d))
    return r.select("graph_id", "edge_id", "lane", _r("mid.x").alias("mid_x"), _r("mid.y").alias("mid_y"))


@query("SELECT graph_id, edge_id, nx + sw + 20.0 * row_number() OVER (PARTITION BY graph_id, source_id ORDER BY ord) AS out_x, sy - sh / 4 AS top, sy + sh / 4 AS bottom FROM ends WHERE source_id = target_id", TRANSITION_SQL, _ENDS)
def route_self_loop(spark: SparkSession, d: str) -> DataFrame:
    r = R.self_loops(*transition_graphs(spark, d))
    return r.select("graph_id", "edge_id", F.expr("points[1].x").alias("out_x"), F.expr("points[0].y").alias("top"), F.expr("points[3].y").alias("bottom"))


@query("SELECT graph_id, edge_id, CASE WHEN r THEN nx + sw ELSE nx END AS x, round(ny + sh * (row_number() OVER (PARTITION BY graph_id, source_id, r ORDER BY ty, tx, ord) / (count(*) OVER (PARTITION BY graph_id, source_id, r) + 1)), 6) + 0.0 AS y FROM (SELECT *, tx >= sx AS r FROM ends WHERE source_id <> target_id)", TRANSITION_SQL, _ENDS)
def route_fan(spark: SparkSession, d: str) -> DataFrame:
    return R.fan_anchors(*transition_graphs(spark, d)).select("graph_id", "edge_id", "x", _r("y").alias("y"))


@query("SELECT graph_id, source_id AS node_id, any_value(nx + sw) + 20.0 AS trunk_x, min(least(sy, ty)) AS low, max(greatest(sy, ty)) AS high, count(*) AS branches FROM ends WHERE source_id <> target_id GROUP BY ALL", TRANSITION_SQL, _ENDS)
def route_grouped_bus(spark: SparkSession, d: str) -> DataFrame:
    return R.bus_trunks(*transition_graphs(spark, d))


def _moved(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes after the first of each graph went 30 to the right, and the old and new box of what moved."""
    after = n.withColumn("x", F.when(F.col("ord") == 0, F.col("x") + 30).otherwise(F.col("x")))
    cols = ("graph_id", "node_id", "x", "y", "width", "height")
    return after, n.where("ord = 0").select(*cols).unionByName(after.where("ord = 0").select(*cols))


@query("SELECT graph_id, edge_id, max(i) AS incident FROM (SELECT e.graph_id, e.edge_id, true AS i FROM edges e JOIN nodes n ON n.graph_id = e.graph_id AND n.ord = 0 AND n.node_id IN (e.source_id, e.target_id) UNION ALL SELECT s.graph_id, s.edge_id, false FROM seg s JOIN (SELECT graph_id, x, y, width, height FROM nodes WHERE ord = 0 UNION ALL SELECT graph_id, x + 30, y, width, height FROM nodes WHERE ord = 0) b ON b.graph_id = s.graph_id AND s.x1 <= b.x + b.width + 8 AND s.x2 >= b.x - 8 AND s.y1 <= b.y + b.height + 8 AND s.y2 >= b.y - 8) GROUP BY graph_id, edge_id", TRANSITION_SQL, _ELBOW)
def affected_edges(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    return R.affected_edges(quality.elbow_routes(n, e), e, _moved(n)[1])


@query("SELECT graph_id, edge_id, k, x, y FROM (SELECT graph_id, edge_id, sx, sy, (sx + tx) / 2 AS mx, tx, ty FROM (SELECT e.graph_id, e.edge_id, s.x + s.width / 2 + CASE WHEN s.ord = 0 THEN 30 ELSE 0 END AS sx, s.y + s.height / 2 AS sy, t.x + t.width / 2 + CASE WHEN t.ord = 0 THEN 30 ELSE 0 END AS tx, t.y + t.height / 2 AS ty FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.source_id JOIN nodes t ON t.graph_id = e.graph_id AND t.node_id = e.target_id WHERE e.source_id <> e.target_id)) r, LATERAL (VALUES (0, sx, sy), (1, mx, sy), (2, mx, ty), (3, tx, ty)) AS p(k, x, y)", TRANSITION_SQL)
def route_update_equals_fresh(spark: SparkSession, d: str) -> DataFrame:
    """All points of the routes after a node moved and only what that affects was drawn anew: as if all were."""
    n, e = transition_graphs(spark, d)
    before, (after, moved) = quality.elbow_routes(n, e), _moved(n)
    got = R.update_routes(before, after, e, R.affected_edges(before, e, moved), quality.elbow_routes)
    return got.select("graph_id", "edge_id", F.posexplode("points").alias("k", "p")).select("graph_id", "edge_id", "k", "p.x", "p.y")


@query("SELECT e.graph_id, e.edge_id, 'update' AS op FROM edges e JOIN nodes n ON n.graph_id = e.graph_id AND n.ord = 0 AND n.node_id IN (e.source_id, e.target_id) WHERE e.source_id <> e.target_id", TRANSITION_SQL)
def patches_edges(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    return R.route_patches(quality.elbow_routes(n, e), quality.elbow_routes(_moved(n)[0], e)).drop("points")


@query("SELECT a.graph_id, round(sum(least(a.x2, b.x2) - greatest(a.x1, b.x1) + least(a.y2, b.y2) - greatest(a.y1, b.y1)), 6) AS overlap FROM seg a JOIN seg b ON a.graph_id = b.graph_id AND a.edge_id < b.edge_id AND ((a.y1 = a.y2 AND b.y1 = b.y2 AND a.y1 = b.y1 AND least(a.x2, b.x2) - greatest(a.x1, b.x1) > 1e-6) OR (a.x1 = a.x2 AND b.x1 = b.x2 AND a.x1 = b.x1 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 1e-6)) GROUP BY ALL", TRANSITION_SQL, _ELBOW)
def quality_overlap(spark: SparkSession, d: str) -> DataFrame:
    return R.shared_lengths(_elbows(spark, d))


@query("SELECT graph_id, (max(x2) - min(x1)) * (max(y2) - min(y1)) AS area FROM (SELECT graph_id, x AS x1, x + width AS x2, y AS y1, y + height AS y2 FROM nodes UNION ALL SELECT graph_id, x1, x2, y1, y2 FROM seg) GROUP BY graph_id", TRANSITION_SQL, _ELBOW)
def quality_area(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    box = quality.boxes(n).drop("node_id").unionByName(quality.route_segments(quality.elbow_routes(n, e)).drop("edge_id", "k"))
    return box.groupBy("graph_id").agg(F.expr("(max(x2) - min(x1)) * (max(y2) - min(y1))").alias("area"))


@query("SELECT s.graph_id, CAST(coalesce(any_value(c.crossings), 0) AS BIGINT) AS crossings, CAST(sum(CASE WHEN sx <> tx AND sy <> ty THEN 2 ELSE 0 END) AS BIGINT) AS bends, round(sum(abs(tx - sx) + abs(ty - sy)), 6) AS length, any_value(n.area) AS area FROM seg0 s JOIN (SELECT graph_id, sum(width * height) AS area FROM nodes GROUP BY graph_id) n USING (graph_id) LEFT JOIN (" + SQL["quality_crossings"] + ") c USING (graph_id) GROUP BY s.graph_id", TRANSITION_SQL, _ELBOW)
def soft_quality(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    r = quality.elbow_routes(n, e)
    per = quality.route_measures(r).groupBy("graph_id").agg(F.sum("bends").alias("bends"), F.round(F.sum("manhattan"), 6).alias("length"))
    area = n.groupBy("graph_id").agg(F.sum(F.col("width") * F.col("height")).alias("area"))
    out = per.join(area, "graph_id").join(quality.route_crossings(r), "graph_id", "left")
    return out.select("graph_id", F.coalesce("crossings", F.lit(0)).cast("long").alias("crossings"), "bends", "length", "area")


@query("""SELECT graph_id, CASE WHEN CASE WHEN abs(l2 - lb) > greatest(l2, lb) * 0.02 THEN l2 < lb ELSE false END AND d2 = db THEN 2 WHEN d2 < db THEN 2 ELSE best END AS candidate
FROM (SELECT *, CASE best WHEN 1 THEN l1 ELSE l0 END AS lb, CASE best WHEN 1 THEN d1 ELSE d0 END AS db FROM (SELECT *, CASE WHEN d1 <> d0 THEN CASE WHEN d1 < d0 THEN 1 ELSE 0 END WHEN abs(l1 - l0) > greatest(l1, l0) * 0.02 AND l1 < l0 THEN 1 ELSE 0 END AS best
FROM (SELECT graph_id, CAST(0 AS BIGINT) AS d0, sum(abs(tx - sx) + abs(ty - sy)) AS l0, sum(CASE WHEN least(abs(tx - sx), abs(ty - sy)) > 1e-6 THEN 1 ELSE 0 END) AS d1,
  sum(least(abs(tx - sx), abs(ty - sy)) * sqrt(2.0) + greatest(abs(tx - sx), abs(ty - sy)) - least(abs(tx - sx), abs(ty - sy))) AS l1,
  sum(CASE WHEN least(abs(tx - sx), abs(ty - sy)) > 1e-6 THEN 1 ELSE 0 END) AS d2, sum(sqrt((tx - sx) ** 2 + (ty - sy) ** 2)) AS l2 FROM seg0 GROUP BY graph_id)))""", TRANSITION_SQL, _ELBOW)
def better_candidate_fold(spark: SparkSession, d: str) -> DataFrame:
    """Elbows, octilinear routes and straight lines as candidates; diagonals decide first, then length by 2 %."""
    n, e = transition_graphs(spark, d)
    elbow = quality.elbow_routes(n, e)
    straight = elbow.select("graph_id", "edge_id", F.array(F.element_at("points", 1), F.element_at("points", -1)).alias("points"))
    measured = None
    for k, r in enumerate((elbow, R.octilinear_routes(n, e), straight)):
        m = r.groupBy("graph_id").agg(F.sum(g.diagonals(F.col("points"))).cast("double").alias("diagonals"), F.sum(g.path_length(F.col("points"))).alias("length")).withColumn("candidate", F.lit(k))
        measured = m if measured is None else measured.unionByName(m)
    return R.best_candidate(measured, ["diagonals", "length"], {"length"})


_TURNS = " legs AS (SELECT graph_id, edge_id, abs(tx - sx) / 2 AS h, abs(ty - sy) AS v FROM seg0 WHERE sx <> tx AND sy <> ty)"


@query("SELECT graph_id, edge_id, round(least(10.0, h / 2, v / 2), 6) AS trim, round(2 * h + v - 2 * (2 - pi() / 2) * least(10.0, h / 2, v / 2), 6) AS length FROM legs", TRANSITION_SQL, _ELBOW, _TURNS)
def round_corners_points(spark: SparkSession, d: str) -> DataFrame:
    r = _elbows(spark, d).withColumn("points", g.simplify(F.col("points"))).where("size(points) = 4")
    return r.select("graph_id", "edge_id", F.round(curves.corners(F.col("points"), 10.0)[0]["trim"], 6).alias("trim"), F.round(curves.rounded_length(F.col("points"), 10.0), 6).alias("length"))


def _control(near: str, other: str, outer: str, e: str) -> str:
    return f"round(CASE WHEN {e} > 0 THEN ({e} * {other} - e2 * {outer} + (2 * {e} + 3 * sqrt({e}) * sqrt(e2) + e2) * {near}) / (3 * sqrt({e}) * (sqrt({e}) + sqrt(e2))) ELSE {near} END, 3) + 0.0"


_CURVE = """ pts AS (SELECT graph_id, edge_id, unnest([0, 1, 2, 3]) AS i, unnest([sx, (sx + tx) / 2, (sx + tx) / 2, tx]) AS px, unnest([sy, sy, ty, ty]) AS py FROM seg0),
four AS (SELECT graph_id, edge_id, i AS k, px AS x1, py AS y1, coalesce(lag(px) OVER w, px) AS x0, coalesce(lag(py) OVER w, py) AS y0, lead(px) OVER w AS x2, lead(py) OVER w AS y2, coalesce(lead(px, 2) OVER w, lead(px) OVER w) AS x3, coalesce(lead(py, 2) OVER w, lead(py) OVER w) AS y3 FROM pts WINDOW w AS (PARTITION BY graph_id, edge_id ORDER BY i)),
knots AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS e1, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS e2, sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2) AS e3 FROM four WHERE x2 IS NOT NULL)"""


@query(f"SELECT graph_id, edge_id, k, {_control('x1', 'x2', 'x0', 'e1')} AS c1x, {_control('y1', 'y2', 'y0', 'e1')} AS c1y, {_control('x2', 'x1', 'x3', 'e3')} AS c2x, {_control('y2', 'y1', 'y3', 'e3')} AS c2y FROM knots", TRANSITION_SQL, _ELBOW, _CURVE)
def route_curved(spark: SparkSession, d: str) -> DataFrame:
    """Centripetal Catmull-Rom curves through the points of elbow routes, as Bezier control points."""
    c = _elbows(spark, d).select("graph_id", "edge_id", F.posexplode(curves.catmull_rom(F.col("points"))).alias("k", "c"))
    return c.select("graph_id", "edge_id", "k", *[(F.round(f"c.{p}.{a}", 3) + 0.0).alias(p + a) for p in ("c1", "c2") for a in "xy"])


@query("SELECT graph_id, edge_id, round(sx + sign(tx - sx) * least(l / 4, abs(tx - sx) / 2), 6) + 0.0 AS x, round(sy + sign(ty - sy) * greatest(0.0, l / 4 - abs(tx - sx) / 2), 6) - 6.0 AS y FROM (SELECT *, abs(tx - sx) + abs(ty - sy) AS l FROM seg0)", TRANSITION_SQL, _ELBOW)
def label_on_path(spark: SparkSession, d: str) -> DataFrame:
    """Where a label at a quarter of the way stands, six above the route."""
    r = _elbows(spark, d).withColumn("p", g.point_at(F.col("points"), g.path_length(F.col("points")) * 0.25))
    return r.select("graph_id", "edge_id", _r("p.x").alias("x"), (F.round("p.y", 6) - 6.0).alias("y"))


@query("SELECT graph_id, node_id, CAST(dense_rank() OVER (PARTITION BY graph_id ORDER BY layer, pos % 2) - 1 AS INTEGER) AS layer FROM pos", TRANSITION_SQL, _LAYERS, recursive=True)
def unzip_alternating(spark: SparkSession, d: str) -> DataFrame:
    """Every layer is dealt in turn into two."""
    n, e = _dag(spark, d)
    order = G.order_in_layers(n, _layers(n, e))
    to = F.dense_rank().over(Window.partitionBy("graph_id").orderBy("layer", F.col("pos") % 2)) - 1
    return order.select("graph_id", "node_id", to.cast("int").alias("layer"))


@query("SELECT l.graph_id, l.node_id, CAST(l.layer - p.low + p.base AS BIGINT) AS layer FROM lay l JOIN nodes n USING (graph_id, node_id) JOIN (SELECT graph_id, part, low, coalesce(sum(high - low + 1) OVER (PARTITION BY graph_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM (SELECT l.graph_id, n.ord % 2 AS part, min(layer) AS low, max(layer) AS high FROM lay l JOIN nodes n USING (graph_id, node_id) GROUP BY ALL)) p ON p.graph_id = l.graph_id AND p.part = n.ord % 2", TRANSITION_SQL, _LAYERS, recursive=True)
def partitions_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Partitions (here: parity of the order) take blocks of layers one after the other."""
    n, e = _dag(spark, d)
    lay = _layers(n, e).join(n.select("graph_id", "node_id", (F.col("ord") % 2).alias("part")), ["graph_id", "node_id"])
    span = lay.groupBy("graph_id", "part").agg(F.min("layer").alias("low"), F.max("layer").alias("high"))
    before = Window.partitionBy("graph_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    span = span.withColumn("base", F.coalesce(F.sum(F.expr("high - low + 1")).over(before), F.lit(0)))
    return lay.join(span, ["graph_id", "part"]).select("graph_id", "node_id", F.expr("cast(layer - low + base as bigint)").alias("layer"))


@query("SELECT graph_id, node_id, CAST(layer // 2 AS INTEGER) AS row, CAST(layer % 2 AS INTEGER) AS layer FROM lay", TRANSITION_SQL, _LAYERS, recursive=True)
def wrap_layers(spark: SparkSession, d: str) -> DataFrame:
    return G.wrapped(_layers(*_dag(spark, d)), 2)


@query("SELECT graph_id, layer, count(*) AS n, sum(height) + 20.0 * (count(*) - 1) AS size FROM pos GROUP BY graph_id, layer", TRANSITION_SQL, _LAYERS, recursive=True)
def layer_widths(spark: SparkSession, d: str) -> DataFrame:
    n, e = _dag(spark, d)
    at = _layers(n, e).join(n.select("graph_id", "node_id", "height"), ["graph_id", "node_id"])
    return at.groupBy("graph_id", "layer").agg(F.count("*").alias("n"), (F.sum("height") + 20.0 * (F.count("*") - 1)).alias("size"))


@query("SELECT graph_id, component, coalesce(sum(w + 20.0) OVER (PARTITION BY graph_id ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS x, w AS width FROM (SELECT c.graph_id, c.component, max(n.x + n.width) - min(n.x) AS w FROM (" + SQL["components"] + ") c JOIN nodes n USING (graph_id, node_id) GROUP BY ALL)", TRANSITION_SQL)
def component_strip(spark: SparkSession, d: str) -> DataFrame:
    """Components side by side in the order of their first nodes."""
    n = transition_graphs(spark, d)[0].select("graph_id", "node_id", "x", "width")
    w = QUERIES["components"](spark, d).join(n, ["graph_id", "node_id"]).groupBy("graph_id", "component").agg(F.expr("max(x + width) - min(x)").alias("width"))
    before = Window.partitionBy("graph_id").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    return w.select("graph_id", "component", F.coalesce(F.sum(F.col("width") + 20.0).over(before), F.lit(0.0)).alias("x"), "width")


@query("SELECT graph_id, count(*) AS routes, min(CASE WHEN k >= ceil(0.5 * n) THEN l END) AS p50, min(CASE WHEN k >= ceil(0.95 * n) THEN l END) AS p95, min(CASE WHEN k >= ceil(0.99 * n) THEN l END) AS p99 FROM (SELECT graph_id, l, row_number() OVER (PARTITION BY graph_id ORDER BY l) AS k, count(*) OVER (PARTITION BY graph_id) AS n FROM (SELECT graph_id, abs(tx - sx) + abs(ty - sy) AS l FROM seg0)) GROUP BY graph_id", TRANSITION_SQL, _ELBOW)
def route_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of route lengths."""
    r = _elbows(spark, d).select("graph_id", g.manhattan_length(F.col("points")).alias("l"))
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY l)")
    return r.groupBy("graph_id").agg(F.count("*").alias("routes"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("SELECT e.graph_id, e.edge_id, greatest(CASE WHEN s.ord % 3 = 0 THEN 10.0 * s.ord ELSE 20.0 END, CASE WHEN t.ord % 3 = 0 THEN 10.0 * t.ord ELSE 20.0 END) AS gap FROM edges e JOIN nodes s ON s.graph_id = e.graph_id AND s.node_id = e.source_id JOIN nodes t ON t.graph_id = e.graph_id AND t.node_id = e.target_id", TRANSITION_SQL)
def spacing_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Every third node has a value of its own."""
    n, e = transition_graphs(spark, d)
    return G.resolved_gaps(e, n.where("ord % 3 = 0").select("graph_id", "node_id", (F.col("ord") * 10.0).alias("gap")), 20.0)


@query("SELECT graph_id, node_id, degree, degree >= 6 AS high FROM (SELECT graph_id, node_id, count(*) AS degree FROM (SELECT graph_id, source_id AS node_id FROM edges WHERE source_id <> target_id UNION ALL SELECT graph_id, target_id FROM edges WHERE source_id <> target_id) GROUP BY ALL)", TRANSITION_SQL)
def high_degree_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = transition_graphs(spark, d)[1].where("source_id <> target_id")
    ends = e.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("node_id"))
    return ends.groupBy("graph_id", "node_id").agg(F.count("*").alias("degree")).withColumn("high", F.col("degree") >= 6)


@query("SELECT e.graph_id, e.edge_id AS id, 'missing endpoint' AS problem FROM edges e WHERE 'error' IN (source_id, target_id) UNION ALL SELECT graph_id, node_id, 'bad size' FROM nodes WHERE ord = 1 AND node_id <> 'error'", TRANSITION_SQL)
def invalid_graphs(spark: SparkSession, d: str) -> DataFrame:
    n, e = transition_graphs(spark, d)
    n = n.where("node_id <> 'error'").withColumn("width", F.when(F.col("ord") == 1, -1.0).otherwise(F.col("width")))
    return registry.invalid_rows(n, e)


@query()
def arrange_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Places of every node by every registered algorithm for flat graphs."""
    n, e = (written(t, "graphs") for t in transition_graphs(spark, d))  # every algorithm reads both
    out = None
    for a in registry.algorithms():
        if a not in ("tree", "radial"):
            p = registry.arrange(n, e, a).select(F.lit(a).alias("algorithm"), "graph_id", "node_id", "x", "y")
            out = p if out is None else out.unionByName(p)
    return out

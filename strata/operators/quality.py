"""Quality of drawings over routes (graph_id, edge_id, points) and node rectangles: spatial joins on a grid, then exact tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curves
from ..functions import geometry as g

EPS = g.EPS


def route_measures(routes: DataFrame) -> DataFrame:
    p = F.col("points")
    return routes.select("graph_id", "edge_id", g.bends(p).alias("bends"), F.round(g.path_length(p), 6).alias("length"), F.round(g.manhattan_length(p), 6).alias("manhattan"), g.diagonals(p).alias("diagonals"))


def route_segments(routes: DataFrame) -> DataFrame:
    s = routes.select("graph_id", "edge_id", F.posexplode(g.segments(F.col("points"))).alias("k", "s"))
    return s.select("graph_id", "edge_id", "k", *[f(F.col(f"s.a.{c}"), F.col(f"s.b.{c}")).alias(n) for n, f, c in (("x1", F.least, "x"), ("x2", F.greatest, "x"), ("y1", F.least, "y"), ("y2", F.greatest, "y"))])


def _level(x1: str, x2: str, y1: str, y2: str, size: float) -> Column:
    """0 for a box of up to a cell's size, 1 for up to twice that, and so on: it lies in four cells of its level at most."""
    far = F.greatest(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)) / size
    return F.when(far > 1, F.ceil(F.log2(far))).otherwise(0).cast("int")


def _cells(x1: Column, x2: Column, y1: Column, y2: Column, side: Column) -> Column:
    low = lambda a: F.floor(a / side).cast("long")
    return F.flatten(F.transform(F.sequence(low(x1), low(x2)), lambda i: F.transform(F.sequence(low(y1), low(y2)), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))


def grid_join(a: DataFrame, b: DataFrame, test: Column, size: float = 128.0) -> DataFrame:
    """Pairs of boxes (x1, x2, y1, y2; b's columns end in _b) of one graph that share a cell and pass ``test``.

    The grid has levels, each with cells twice as wide as the one below.  A box goes to the cells of its own level and
    of those coarser levels that its graph has boxes of, so the largest one makes a few rows, not one a small cell.  A
    pair is reported once: at the coarser of its levels, in the cell of the larger of the lower corners.
    """
    corners = ("x1", "x2", "y1", "y2")
    own = lambda df, s: df.withColumn(f"level{s}", _level(*[c + s for c in corners], size))
    a, b = own(a, ""), own(b, "_b")
    levels = a.select("graph_id", "level").unionByName(b.select("graph_id", F.col("level_b").alias("level"))).distinct()
    side = size * F.pow(F.lit(2.0), F.col("l"))

    def dealt(df: DataFrame, s: str) -> DataFrame:
        at = df.join(levels.withColumnRenamed("level", "l"), "graph_id").where(f"l >= level{s}")
        return at.select("*", F.explode(_cells(*[F.col(c + s) for c in corners], side)).alias("__cell")).select("*", "__cell.cx", "__cell.cy").drop("__cell")

    home = (F.col("l") == F.greatest("level", "level_b")) & (F.floor(F.greatest("x1", "x1_b") / side) == F.col("cx")) & (F.floor(F.greatest("y1", "y1_b") / side) == F.col("cy"))
    return dealt(a, "").join(dealt(b, "_b"), ["graph_id", "l", "cx", "cy"]).where(home & test).drop("l", "cx", "cy", "level", "level_b")


def boxes(nodes: DataFrame) -> DataFrame:
    return nodes.select("graph_id", "node_id", F.col("x").alias("x1"), (F.col("x") + F.col("width")).alias("x2"), F.col("y").alias("y1"), (F.col("y") + F.col("height")).alias("y2"))


def _suffixed(df: DataFrame) -> DataFrame:
    return df.select("graph_id", *[F.col(c).alias(f"{c}_b") for c in df.columns if c != "graph_id"])


def node_overlaps(nodes: DataFrame) -> DataFrame:
    b = boxes(nodes).where("x2 > x1 and y2 > y1")
    met = grid_join(b, _suffixed(b), F.expr("node_id < node_id_b and x1 < x2_b and x1_b < x2 and y1 < y2_b and y1_b < y2"))
    return met.select("graph_id", "node_id", F.col("node_id_b").alias("other_id"), (F.least("x2", "x2_b") - F.greatest("x1", "x1_b")).alias("overlap_x"), (F.least("y2", "y2_b") - F.greatest("y1", "y1_b")).alias("overlap_y"))


def node_hits(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Axis-parallel segments that run strictly inside a node, per segment and node."""
    inside = F.expr(f"(y1 = y2 and y1 > y1_b + {EPS} and y1 < y2_b - {EPS} and least(x2, x2_b) - greatest(x1, x1_b) > {EPS}) or (x1 = x2 and x1 > x1_b + {EPS} and x1 < x2_b - {EPS} and least(y2, y2_b) - greatest(y1, y1_b) > {EPS})")
    return grid_join(route_segments(routes), _suffixed(boxes(nodes)), inside).select("graph_id", "edge_id", "k", F.col("node_id_b").alias("node_id"))


def _times(a: str, way: str, low: str, high: str) -> tuple[Column, Column]:
    """When a point that moves from ``a`` by ``way`` in one unit of time is between ``low`` and ``high``; never: inf, -inf."""
    t = [(F.col(c) - F.col(a)) / F.col(way) for c in (low, high)]
    inside = F.expr(f"{a} > {low} and {a} < {high}")
    ever = F.lit(float("inf"))
    return F.when(F.col(way) != 0, F.least(*t)).when(inside, -ever).otherwise(ever), F.when(F.col(way) != 0, F.greatest(*t)).when(inside, ever).otherwise(-ever)


def _through() -> Column:
    """Whether the line from (ax, ay) by (dx, dy) runs through the open inside of the box b."""
    (fx, ux), (fy, uy) = _times("ax", "dx", "x1_b", "x2_b"), _times("ay", "dy", "y1_b", "y2_b")
    return F.greatest(F.lit(0.0), fx, fy) < F.least(F.lit(1.0), ux, uy) - 1e-10


def curve_hits(cubics: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose open inside a curve's chords run through, each once a curve; not the curve's own ends.

    ``cubics``: graph_id, edge_id, source_id, target_id, c.  Boxes of pieces meet nodes on the grid; only pieces that
    meet a node are cut into chords, behind the join.
    """
    pieces = curves.curve_pieces(curves.flat_curves(cubics))
    met = grid_join(pieces, _suffixed(boxes(nodes)), F.expr("x1 <= x2_b and x2 >= x1_b and y1 <= y2_b and y2 >= y1_b and node_id_b <> source_id and node_id_b <> target_id"))
    rows = met.drop("x1", "x2", "y1", "y2").select("*", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("k"))
    at = {k: [curves.on_curve(F.col("k") + i, k) for i in (0, 1)] for k in "xy"}
    chord = F.struct(*[at[k][0].alias(f"a{k}") for k in "xy"], *[(at[k][1] - at[k][0]).alias(f"d{k}") for k in "xy"])
    # As a generated row, for a filter over columns of a projection would repeat their expressions in its own.
    line = rows.select("graph_id", "edge_id", "node_id_b", "x1_b", "x2_b", "y1_b", "y2_b", F.inline(F.array(chord)))
    return line.where(_through()).select("graph_id", "edge_id", F.col("node_id_b").alias("node_id")).distinct()


def line_hits(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments of any direction that run through the open inside of a node, per segment and node."""
    s = routes.select("graph_id", "edge_id", F.posexplode(g.segments(F.col("points"))).alias("k", "s"))
    sides = [f(F.col(f"s.a.{c}"), F.col(f"s.b.{c}")).alias(n) for n, f, c in (("x1", F.least, "x"), ("x2", F.greatest, "x"), ("y1", F.least, "y"), ("y2", F.greatest, "y"))]
    s = s.select("graph_id", "edge_id", "k", *sides, F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.expr("s.b.x - s.a.x").alias("dx"), F.expr("s.b.y - s.a.y").alias("dy"))
    return grid_join(s, _suffixed(boxes(nodes)), _through()).select("graph_id", "edge_id", "k", F.col("node_id_b").alias("node_id"))


def frames(nodes: DataFrame, routes: DataFrame, labels: DataFrame, padding: float = 12.0) -> DataFrame:
    """How far each drawing moves so that nodes, routes and labels (graph_id, x1, x2, y1, y2) start at the padding, and its size then."""
    cols = ("graph_id", "x1", "x2", "y1", "y2")
    every = boxes(nodes).select(*cols).unionByName(route_segments(routes).select(*cols)).unionByName(labels.select(*cols))
    b = every.groupBy("graph_id").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))
    return b.select("graph_id", (padding - F.col("x1")).alias("dx"), (padding - F.col("y1")).alias("dy"), (F.col("x2") - F.col("x1") + 2 * padding).alias("width"), (F.col("y2") - F.col("y1") + 2 * padding).alias("height"))


def moved_routes(routes: DataFrame, by: DataFrame) -> DataFrame:
    """Routes moved by their drawing's (graph_id, dx, dy)."""
    to = F.transform("points", lambda p: g.point(p["x"] + F.col("dx"), p["y"] + F.col("dy")))
    return routes.join(by.select("graph_id", "dx", "dy"), "graph_id").select("graph_id", "edge_id", to.alias("points"))


def route_crossings(routes: DataFrame) -> DataFrame:
    """Points where a horizontal segment crosses a vertical one of another route, strictly inside both; each once a pair."""
    s = route_segments(routes)
    h, v = s.where("y1 = y2 and x2 > x1"), _suffixed(s.where("x1 = x2 and y2 > y1"))
    test = F.expr(f"edge_id <> edge_id_b and x1_b > x1 + {EPS} and x1_b < x2 - {EPS} and y1 > y1_b + {EPS} and y1 < y2_b - {EPS}")
    met = grid_join(h, v, test).select("graph_id", F.least("edge_id", "edge_id_b").alias("a"), F.greatest("edge_id", "edge_id_b").alias("b"), F.round("x1_b", 6).alias("x"), F.round("y1", 6).alias("y"))
    return met.distinct().groupBy("graph_id").agg(F.count("*").alias("crossings"))


def self_retraces(routes: DataFrame) -> DataFrame:
    """Length that a route's axis-parallel segments run over other segments of the same route, per route that does."""
    s = route_segments(routes).where(f"x2 - x1 > {EPS} or y2 - y1 > {EPS}")
    flat, tall = "y1 = y2 and y1_b = y2_b and y1 = y1_b", "x1 = x2 and x1_b = x2_b and x1 = x1_b"
    met = grid_join(s, _suffixed(s), F.expr(f"edge_id = edge_id_b and k < k_b and (({flat}) or ({tall}))"))
    over = F.when(F.expr(flat), F.least("x2", "x2_b") - F.greatest("x1", "x1_b")).otherwise(F.least("y2", "y2_b") - F.greatest("y1", "y1_b"))
    return met.select("graph_id", "edge_id", over.alias("n")).where(f"n > {EPS}").groupBy("graph_id", "edge_id").agg(F.sum("n").alias("retraced"))


def unions(nodes: DataFrame, others: DataFrame) -> DataFrame:
    """The least box around each node and the boxes (graph_id, node_id, x1, x2, y1, y2) that belong to it."""
    every = boxes(nodes).unionByName(others.select("graph_id", "node_id", "x1", "x2", "y1", "y2"))
    b = every.groupBy("graph_id", "node_id").agg(F.min("x1").alias("x"), F.min("y1").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return b.select("graph_id", "node_id", "x", "y", (F.col("x2") - F.col("x")).alias("width"), (F.col("y2") - F.col("y")).alias("height"))


def crossings_off_terminals(routes: DataFrame, edges: DataFrame, nodes: DataFrame, margin: float = 12.0) -> DataFrame:
    """Crossings as ``route_crossings`` counts them, but for points nearer than ``margin`` to a node at which both
    routes end: there lines have to meet."""
    s = route_segments(routes).join(edges.select("graph_id", "edge_id", F.array("source_id", "target_id").alias("ends")), ["graph_id", "edge_id"])
    h, v = s.where("y1 = y2 and x2 > x1"), _suffixed(s.where("x1 = x2 and y2 > y1"))
    test = F.expr(f"edge_id <> edge_id_b and x1_b > x1 + {EPS} and x1_b < x2 - {EPS} and y1 > y1_b + {EPS} and y1 < y2_b - {EPS}")
    met = grid_join(h, v, test).select("graph_id", F.least("edge_id", "edge_id_b").alias("a"), F.greatest("edge_id", "edge_id_b").alias("b"), F.round("x1_b", 6).alias("x"), F.round("y1", 6).alias("y"), F.array_intersect("ends", "ends_b").alias("shared")).distinct()
    near = met.select("*", F.explode("shared").alias("node_id")).join(boxes(nodes), ["graph_id", "node_id"]).where(f"x >= x1 - {margin} and x <= x2 + {margin} and y >= y1 - {margin} and y <= y2 + {margin}")
    off = met.join(near.select("graph_id", "a", "b", "x", "y"), ["graph_id", "a", "b", "x", "y"], "left_anti")
    return off.groupBy("graph_id").agg(F.count("*").alias("crossings"))


def elbow_routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Horizontal-vertical-horizontal routes from centre to centre."""
    at = nodes.select("graph_id", "node_id", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"))
    e = edges.where("source_id <> target_id").join(at.withColumnsRenamed({"node_id": "source_id", "cx": "sx", "cy": "sy"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "cx": "tx", "cy": "ty"}), ["graph_id", "target_id"])
    mid = (F.col("sx") + F.col("tx")) / 2
    return e.select("graph_id", "edge_id", F.array(g.point(F.col("sx"), F.col("sy")), g.point(mid, F.col("sy")), g.point(mid, F.col("ty")), g.point(F.col("tx"), F.col("ty"))).alias("points"))


def straight_routes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """From border to border along the line of the centres."""
    r = nodes.select("graph_id", "node_id", F.struct("x", "y", "width", "height").alias("r"))
    e = edges.where("source_id <> target_id").join(r.withColumnsRenamed({"node_id": "source_id", "r": "a"}), ["graph_id", "source_id"]).join(r.withColumnsRenamed({"node_id": "target_id", "r": "b"}), ["graph_id", "target_id"])
    return e.select("graph_id", "edge_id", F.array(g.border(F.col("a"), F.col("b")), g.border(F.col("b"), F.col("a"))).alias("points"))

"""Set-shaped graph operators: degrees, adjacency, membership, hierarchy, orientation, layers, order."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weighted in- and out-degree of every node; self-loops don't count."""
    real = edges.where("source_id <> target_id")
    ends = real.select("graph_id", F.inline(F.array(F.struct(F.col("source_id").alias("node_id"), F.col("weight").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("target_id").alias("node_id"), F.lit(0).cast("long").alias("o"), F.col("weight").alias("i")))))
    sums = ends.groupBy("graph_id", "node_id").agg(F.sum("o").alias("out_weight"), F.sum("i").alias("in_weight"))
    return nodes.select("graph_id", "node_id").join(sums, ["graph_id", "node_id"], "left").na.fill(0, ["out_weight", "in_weight"])


def adjacency(edges: DataFrame) -> DataFrame:
    """Neighbours in edge order, both directions, self-loops dropped."""
    both = edges.where("source_id <> target_id").select("graph_id", F.inline(F.array(F.struct(F.col("source_id").alias("node_id"), F.col("target_id").alias("n"), F.col("ord").alias("o")), F.struct(F.col("target_id").alias("node_id"), F.col("source_id").alias("n"), F.col("ord").alias("o")))))
    lists = both.groupBy("graph_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("l"))
    return lists.select("graph_id", "node_id", F.array_join("l.n", ",").alias("neighbours"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node."""
    have = nodes.select("graph_id", "node_id")
    gone = [edges.join(have.withColumnRenamed("node_id", c), ["graph_id", c], "left_anti").select("graph_id", "edge_id") for c in ("source_id", "target_id")]
    return gone[0].union(gone[1]).distinct()


def closure(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, ancestor_id, depth) for every proper ancestor: one broadcastable self-join per level, with
    paths doubled every round, so a hierarchy of depth d takes log2(d) rounds.  A cycle is an error."""
    step = nodes.where("parent_id is not null").select("graph_id", "node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("depth"))
    reach, rounds = step, 0
    while True:
        far = reach.select("graph_id", F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("up"), F.col("depth").alias("more"))
        longest = reach.groupBy("graph_id", "node_id").agg(F.max_by("ancestor_id", "depth").alias("ancestor_id"), F.max("depth").alias("depth"))
        new = longest.join(far, ["graph_id", "ancestor_id"]).select("graph_id", "node_id", F.col("up").alias("ancestor_id"), (F.col("depth") + F.col("more")).alias("depth"))
        if rounds >= 3:  # deep ones are written, or each round would compute all before it again
            new = written(new, "closure")
        if not new.limit(1).count():
            return reach
        if new.where("node_id = ancestor_id").limit(1).count():
            raise ValueError("a node is its own ancestor: parents form a cycle")
        reach, rounds = reach.unionByName(new), rounds + 1
        if rounds >= 3:
            reach = written(reach, "closure")


def world_frames(nodes: DataFrame) -> DataFrame:
    """World places: own, parent-relative place plus those of all ancestors."""
    above = closure(nodes).join(nodes.select("graph_id", F.col("node_id").alias("ancestor_id"), F.col("x").alias("ax"), F.col("y").alias("ay")), ["graph_id", "ancestor_id"])
    sums = above.groupBy("graph_id", "node_id").agg(F.sum("ax").alias("sx"), F.sum("ay").alias("sy"))
    return nodes.join(sums, ["graph_id", "node_id"], "left").select("graph_id", "node_id", (F.col("x") + F.coalesce("sx", F.lit(0.0))).alias("world_x"), (F.col("y") + F.coalesce("sy", F.lit(0.0))).alias("world_y"))


def model_order_orientation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges against the authored node order are reversed; the result is acyclic without self-loops."""
    at = nodes.select("graph_id", "node_id", F.col("ord").alias("o"))
    e = edges.join(at.withColumnsRenamed({"node_id": "source_id", "o": "so"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "o": "to"}), ["graph_id", "target_id"])
    return e.select("graph_id", "edge_id", (F.col("so") > F.col("to")).alias("reversed"))


def interactive_orientation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target lies before their source are reversed."""
    at = nodes.select("graph_id", "node_id", (F.col("x") + F.col("width") / 2).alias("c"))
    e = edges.join(at.withColumnsRenamed({"node_id": "source_id", "c": "sc"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "c": "tc"}), ["graph_id", "target_id"])
    return e.select("graph_id", "edge_id", (F.col("tc") < F.col("sc")).alias("reversed"))


def oriented(edges: DataFrame, orientation: DataFrame) -> DataFrame:
    """Edges in flow direction, without self-loops."""
    e = edges.where("source_id <> target_id").join(orientation, ["graph_id", "edge_id"])
    return e.select("graph_id", "edge_id", F.when(F.col("reversed"), F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"), F.when(F.col("reversed"), F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"), "ord", "weight")


def order_in_layers(nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """Position in the layer by authored order."""
    w = Window.partitionBy("graph_id", "layer").orderBy("ord")
    return layers.join(nodes.select("graph_id", "node_id", "ord"), ["graph_id", "node_id"]).select("graph_id", "node_id", "layer", (F.row_number().over(w) - 1).alias("pos"))


def split_long_edges(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Segments between neighbouring layers; a dummy node for each layer that an edge passes."""
    at = layers.select("graph_id", "node_id", "layer")
    e = edges.join(at.withColumnsRenamed({"node_id": "source_id", "layer": "sl"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "layer": "tl"}), ["graph_id", "target_id"])
    e = e.withColumn("l", F.explode(F.sequence(F.col("sl"), F.col("tl") - 1)))
    dummy = lambda layer: F.concat(F.lit("__dummy:"), "edge_id", F.lit(":"), layer.cast("string"))
    return e.select("graph_id", "edge_id", (F.col("l") - F.col("sl")).cast("int").alias("segment"), F.when(F.col("l") == F.col("sl"), F.col("source_id")).otherwise(dummy(F.col("l"))).alias("from_id"), F.when(F.col("l") + 1 == F.col("tl"), F.col("target_id")).otherwise(dummy(F.col("l") + 1)).alias("to_id"), F.col("l").cast("int").alias("layer"))


def layer_crossings(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Crossings of edges between neighbouring layers, per graph and layer.

    Crossings are inversions.  Two target positions differ first at one bit: for each bit, edges with equal higher bits
    are walked by source position, and one whose bit is 0 crosses all before it whose bit is 1.  So an edge is looked at
    once a bit, and never met by every other edge.
    """
    at = order.select("graph_id", "node_id", "layer", "pos")
    e = edges.join(at.withColumnsRenamed({"node_id": "source_id", "layer": "sl", "pos": "sp"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "layer": "tl", "pos": "tp"}), ["graph_id", "target_id"]).where("tl = sl + 1")
    most = order.groupBy("graph_id", F.col("layer").alias("tl")).agg(F.length(F.bin(F.max("pos"))).alias("bits"))
    alike = e.groupBy("graph_id", "sl", "tl", "sp", "tp").agg(F.count("*").alias("n")).join(most, ["graph_id", "tl"])
    bit = alike.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)))
    bit = bit.select("graph_id", "sl", "b", "sp", "n", F.expr("shiftright(tp, b + 1)").alias("high"), F.expr("shiftright(tp, b) & 1").alias("one"))
    by = Window.partitionBy("graph_id", "sl", "b", "high").orderBy("sp").rangeBetween(Window.unboundedPreceding, -1)
    met = bit.withColumn("before", F.sum(F.when(F.col("one") == 1, F.col("n"))).over(by)).where("one = 0 and before is not null")
    return met.groupBy("graph_id", F.col("sl").alias("layer")).agg(F.sum(F.col("n") * F.col("before")).alias("crossings"))


def barycenters(edges: DataFrame, order: DataFrame) -> DataFrame:
    """One forward step: mean position of the neighbours in the layer before, and the order that follows from it."""
    at = order.select("graph_id", "node_id", "layer", "pos")
    up = edges.join(at.withColumnsRenamed({"node_id": "source_id", "layer": "sl", "pos": "sp"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "layer": "tl"}).drop("pos"), ["graph_id", "target_id"]).where("tl = sl + 1")
    mean = up.groupBy("graph_id", F.col("target_id").alias("node_id")).agg(F.sum("sp").alias("s"), F.count("*").alias("n"))
    key = F.coalesce(F.col("s") / F.col("n"), F.col("pos").cast("double"))
    w = Window.partitionBy("graph_id", "layer").orderBy(key, "pos")
    return at.join(mean, ["graph_id", "node_id"], "left").select("graph_id", "node_id", "layer", F.round(key, 6).alias("barycenter"), (F.row_number().over(w) - 1).alias("pos"))


def place_simple(nodes: DataFrame, order: DataFrame, layer_gap: float = 20.0, node_gap: float = 20.0, padding: float = 12.0) -> DataFrame:
    """Layers side by side, each as wide as its widest node; nodes of a layer in a column, columns centred."""
    n = order.join(nodes.select("graph_id", "node_id", "width", "height"), ["graph_id", "node_id"])
    sizes = n.groupBy("graph_id", "layer").agg(F.max("width").alias("lw"), (F.sum("height") + (F.count("*") - 1) * node_gap).alias("lh"))
    before = Window.partitionBy("graph_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("graph_id", "layer", "lw", "lh", (F.coalesce(F.sum(F.col("lw") + layer_gap).over(before), F.lit(0.0)) + padding).alias("lx"), F.max("lh").over(Window.partitionBy("graph_id")).alias("most"))
    above = Window.partitionBy("graph_id", "layer").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    n = n.join(sizes, ["graph_id", "layer"])
    y = F.col("most") / 2 - F.col("lh") / 2 + F.coalesce(F.sum(F.col("height") + node_gap).over(above), F.lit(0.0)) + padding
    return n.select("graph_id", "node_id", "layer", (F.col("lx") + (F.col("lw") - F.col("width")) / 2).alias("x"), y.alias("y"), "width", "height")


def order_by_place(nodes: DataFrame, layers: DataFrame, axis: str = "y") -> DataFrame:
    """Position in the layer by authored place: middles along ``axis``, then authored order."""
    size = {"x": "width", "y": "height"}[axis]
    w = Window.partitionBy("graph_id", "layer").orderBy(F.col(axis) + F.col(size) / 2, "ord")
    return layers.join(nodes.select("graph_id", "node_id", "ord", axis, size), ["graph_id", "node_id"]).select("graph_id", "node_id", "layer", (F.row_number().over(w) - 1).alias("pos"))


def mirrored(order: DataFrame) -> DataFrame:
    """Every layer the other way round."""
    n = F.count("*").over(Window.partitionBy("graph_id", "layer"))
    return order.select("graph_id", "node_id", "layer", (n - 1 - F.col("pos")).cast("long").alias("pos"))


def partition_orientation(edges: DataFrame, partitions: DataFrame) -> DataFrame:
    """Edges run from lower to higher partitions (graph_id, node_id, partition)."""
    at = partitions.select("graph_id", "node_id", "partition")
    e = edges.join(at.withColumnsRenamed({"node_id": "source_id", "partition": "sp"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "partition": "tp"}), ["graph_id", "target_id"])
    return e.select("graph_id", "edge_id", (F.col("sp") > F.col("tp")).alias("reversed"))


def constrained_layers(layers: DataFrame, constraints: DataFrame) -> DataFrame:
    """Layers under constraints (graph_id, node_id, kind): FIRST and LAST nodes go to the outer layers, FIRST_SEPARATE and
    LAST_SEPARATE ones to layers of their own beyond them; layers that this empties go."""
    by = Window.partitionBy("graph_id")
    n = layers.join(constraints.select("graph_id", "node_id", "kind"), ["graph_id", "node_id"], "left")
    first, last, kind = F.min("layer").over(by), F.max("layer").over(by), F.col("kind")
    to = F.when(kind == "FIRST_SEPARATE", first - 1).when(kind == "FIRST", first).when(kind == "LAST", last).when(kind == "LAST_SEPARATE", last + 1).otherwise(F.col("layer"))
    return n.select("graph_id", "node_id", to.alias("l")).select("graph_id", "node_id", (F.dense_rank().over(by.orderBy("l")) - 1).cast("int").alias("layer"))


def resolved_gaps(edges: DataFrame, own: DataFrame, default: float) -> DataFrame:
    """The gap of an edge's nodes: the larger of their own values (graph_id, node_id, gap), the default for one without."""
    own = own.select("graph_id", "node_id", "gap")
    e = edges.join(own.withColumnsRenamed({"node_id": "source_id", "gap": "a"}), ["graph_id", "source_id"], "left").join(own.withColumnsRenamed({"node_id": "target_id", "gap": "b"}), ["graph_id", "target_id"], "left")
    return e.select("graph_id", "edge_id", F.greatest(F.coalesce("a", F.lit(default)), F.coalesce("b", F.lit(default))).alias("gap"))


def wrapped(layers: DataFrame, per_row: int) -> DataFrame:
    """Long sequences of layers continue on a new row after every ``per_row`` layers."""
    if per_row < 1:
        raise ValueError("per_row must be 1 or more")
    return layers.select("graph_id", "node_id", F.expr(f"cast(layer div {per_row} as int)").alias("row"), F.expr(f"cast(layer % {per_row} as int)").alias("layer"))


def label_dummies(edges: DataFrame, layers: DataFrame, sizes: DataFrame) -> DataFrame:
    """The dummy of each long edge that holds its label (graph_id, edge_id, width, height): the one in the middle layer,
    the earlier of two.  Edges between neighbouring layers have none."""
    at = layers.select("graph_id", "node_id", "layer")
    e = edges.join(at.withColumnsRenamed({"node_id": "source_id", "layer": "sl"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "layer": "tl"}), ["graph_id", "target_id"]).where("tl - sl > 1")
    middle = F.expr("(sl + tl) div 2").cast("int")
    return e.join(sizes, ["graph_id", "edge_id"]).select("graph_id", "edge_id", middle.alias("layer"), F.concat(F.lit("__dummy:"), "edge_id", F.lit(":"), middle.cast("string")).alias("dummy_id"), "width", "height")


def merged_dummies(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """One dummy a layer for all long edges of a source, the hyperedge they make: its members, and their first by order."""
    at = layers.select("graph_id", "node_id", "layer")
    e = edges.join(at.withColumnsRenamed({"node_id": "source_id", "layer": "sl"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "layer": "tl"}), ["graph_id", "target_id"]).where("tl - sl > 1")
    passed = e.withColumn("layer", F.explode(F.sequence(F.col("sl") + 1, F.col("tl") - 1)))
    return passed.withColumn("layer", F.col("layer").cast("int")).groupBy("graph_id", "source_id", "layer").agg(F.count("*").alias("members"), F.min(F.struct("ord", "edge_id"))["edge_id"].alias("first_edge"))


def placed_ports(placed: DataFrame, edges: DataFrame, order: DataFrame) -> DataFrame:
    """Ports of a layered drawing: edges leave on the east side and enter on the west, spread evenly over it in the order
    of the nodes at their other ends (by position, then edge order).  Two rows an edge."""
    at = order.select("graph_id", "node_id", F.col("layer").alias("l"), F.col("pos").alias("p"))
    e = edges.join(at.withColumnsRenamed({"node_id": "source_id", "l": "sl", "p": "sp"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "l": "tl", "p": "tp"}), ["graph_id", "target_id"])
    end = lambda node, side, layer, pos: F.struct(F.col(node).alias("node_id"), F.lit(side).alias("side"), F.col(layer).alias("far_layer"), F.col(pos).alias("far_pos"))
    ports = e.select("graph_id", "edge_id", "ord", F.inline(F.array(end("source_id", "EAST", "tl", "tp"), end("target_id", "WEST", "sl", "sp"))))
    side = Window.partitionBy("graph_id", "node_id", "side")
    rank = F.row_number().over(side.orderBy("far_pos", "far_layer", "ord"))
    ports = ports.withColumns({"index": rank - 1, "part": rank / (F.count("*").over(side) + 1)})
    n = placed.select("graph_id", "node_id", "x", "y", "width", "height")
    return ports.join(n, ["graph_id", "node_id"]).select("graph_id", "edge_id", "node_id", "side", "index", F.when(F.col("side") == "EAST", F.col("x") + F.col("width")).otherwise(F.col("x")).alias("x"), (F.col("y") + F.col("height") * F.col("part")).alias("y"))


def _stretches(ports: DataFrame, order: DataFrame) -> DataFrame:
    """Edges to the next layer with the places of both ports."""
    at = order.select("graph_id", "node_id", "layer")
    east = ports.where("side = 'EAST'").join(at, ["graph_id", "node_id"]).select("graph_id", "edge_id", "layer", F.col("x").alias("x1"), F.col("y").alias("y1"))
    west = ports.where("side = 'WEST'").join(at, ["graph_id", "node_id"]).select("graph_id", "edge_id", F.col("layer").alias("to_layer"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return east.join(west, ["graph_id", "edge_id"]).where("to_layer = layer + 1").drop("to_layer")


def track_demand(ports: DataFrame, order: DataFrame) -> DataFrame:
    """How many tracks the gap after a layer needs: the most vertical stretches, between the ports of edges to the next
    layer, that share a height.  Straight edges need none; a stretch may end where another one of its track starts."""
    spans = _stretches(ports, order).where("y1 <> y2")
    ends = spans.select("graph_id", "layer", F.inline(F.array(F.struct(F.least("y1", "y2").alias("at"), F.lit(1).alias("step")), F.struct(F.greatest("y1", "y2").alias("at"), F.lit(-1).alias("step")))))
    steps = ends.groupBy("graph_id", "layer", "at").agg(F.sum("step").alias("step"))
    held = F.sum("step").over(Window.partitionBy("graph_id", "layer").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("held", held).groupBy("graph_id", "layer").agg(F.max("held").alias("tracks"))


def track_routes(ports: DataFrame, order: DataFrame) -> DataFrame:
    """Routes (graph_id, edge_id, track, points) of edges to the next layer: out of the port, along a track of the gap,
    into the other port.  Tracks of a gap are evenly spread between the widest node before and the first one after it; a
    gap is one group of a task."""
    s = _stretches(ports, order)
    gap = Window.partitionBy("graph_id", "layer")
    s = s.withColumns({"left": F.max("x1").over(gap), "right": F.min("x2").over(gap)})
    schema = "graph_id string, edge_id string, layer int, x1 double, y1 double, x2 double, y2 double, left double, right double, track int, tracks int"

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("edge_id")
        rows["track"] = tracks(list(zip(rows["y1"], rows["y2"], strict=True)))
        rows["tracks"] = rows["track"].max() + 1
        return rows[[c.split()[0] for c in schema.split(", ")]]

    dealt = s.groupBy("graph_id", "layer").applyInPandas(kernel, schema)
    x = F.col("left") + (F.col("right") - F.col("left")) * (F.col("track") + 1) / (F.col("tracks") + 1)
    point = lambda a, b: F.struct(F.col(a).alias("x") if isinstance(a, str) else a.alias("x"), F.col(b).alias("y"))
    bent = F.array(point("x1", "y1"), point(x, "y1"), point(x, "y2"), point("x2", "y2"))
    return dealt.select("graph_id", "edge_id", "track", F.when(F.col("track") < 0, F.array(point("x1", "y1"), point("x2", "y2"))).otherwise(bent).alias("points"))


def tracks(spans: list[tuple[float, float]]) -> list[int]:
    """A track for each vertical stretch, none shared by two that overlap: from the top, the free one with the least
    number.  It takes as few as ``track_demand`` tells; a stretch of no length has track -1."""
    free, busy, out, used = [], [], [-1] * len(spans), 0
    for low, high, k in sorted((min(s), max(s), k) for k, s in enumerate(spans) if s[0] != s[1]):
        while busy and busy[0][0] <= low:
            heapq.heappush(free, heapq.heappop(busy)[1])
        if free:
            out[k] = heapq.heappop(free)
        else:
            out[k], used = used, used + 1
        heapq.heappush(busy, (high, out[k]))
    return out


def constrained_orientation(nodes: DataFrame, edges: DataFrame, constraints: DataFrame) -> DataFrame:
    """Edges against the authored order are reversed, where FIRST and LAST nodes (graph_id, node_id, kind) count as a
    whole graph earlier or later, FIRST_SEPARATE and LAST_SEPARATE ones as two."""
    n = nodes.select("graph_id", "node_id", "ord", F.count("*").over(Window.partitionBy("graph_id")).alias("n")).join(constraints.select("graph_id", "node_id", "kind"), ["graph_id", "node_id"], "left")
    kind = F.col("kind")
    times = F.when(kind == "FIRST_SEPARATE", -2).when(kind == "FIRST", -1).when(kind == "LAST", 1).when(kind == "LAST_SEPARATE", 2).otherwise(0)
    at = n.select("graph_id", "node_id", (F.col("ord") + times * F.col("n")).alias("o"))
    e = edges.join(at.withColumnsRenamed({"node_id": "source_id", "o": "so"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "o": "to"}), ["graph_id", "target_id"])
    return e.select("graph_id", "edge_id", (F.col("so") > F.col("to")).alias("reversed"))


def priority_degrees(nodes: DataFrame, edges: DataFrame, priorities: DataFrame) -> DataFrame:
    """In- and out-degrees where an edge counts 1 and its priority (graph_id, edge_id, priority) if that is above 0."""
    e = edges.drop("weight").join(priorities.select("graph_id", "edge_id", "priority"), ["graph_id", "edge_id"], "left")
    return degrees(nodes, e.withColumn("weight", (F.greatest(F.coalesce("priority", F.lit(0)), F.lit(0)) + 1).cast("long")))


def passing_edges(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """How many edges pass each layer, that is need a dummy in it; layers that none passes are left out."""
    at = layers.select("graph_id", "node_id", "layer")
    e = edges.join(at.withColumnsRenamed({"node_id": "source_id", "layer": "a"}), ["graph_id", "source_id"]).join(at.withColumnsRenamed({"node_id": "target_id", "layer": "b"}), ["graph_id", "target_id"])
    passed = e.where("b - a > 1").select("graph_id", F.explode(F.sequence(F.col("a") + 1, F.col("b") - 1)).alias("layer"))
    return passed.groupBy("graph_id", "layer").agg(F.count("*").alias("dummies"))


def edge_owners(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, edge_id, owner_id): the nearest node that holds both ends, or the end that holds the other one; null
    at the top.  A self-loop belongs to its node's container."""
    up = closure(nodes).unionByName(nodes.select("graph_id", "node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("depth")))
    a = edges.select("graph_id", "edge_id", "source_id", "target_id").join(up.withColumnRenamed("node_id", "source_id"), ["graph_id", "source_id"])
    both = a.join(up.select("graph_id", F.col("node_id").alias("target_id"), "ancestor_id"), ["graph_id", "target_id", "ancestor_id"]).where("source_id <> target_id or depth > 0")
    owners = both.groupBy("graph_id", "edge_id").agg(F.min_by("ancestor_id", "depth").alias("owner_id"))
    return edges.select("graph_id", "edge_id").join(owners, ["graph_id", "edge_id"], "left")


def native_places(world: DataFrame, nodes: DataFrame) -> DataFrame:
    """World places (graph_id, node_id, world_x, world_y) of all nodes as places in their parents."""
    above = world.select("graph_id", F.col("node_id").alias("parent_id"), F.col("world_x").alias("px"), F.col("world_y").alias("py"))
    n = world.join(nodes.select("graph_id", "node_id", "parent_id"), ["graph_id", "node_id"]).join(above, ["graph_id", "parent_id"], "left")
    zero = F.lit(0.0)
    return n.select("graph_id", "node_id", (F.col("world_x") - F.coalesce("px", zero)).alias("x"), (F.col("world_y") - F.coalesce("py", zero)).alias("y"))


def wrapped_at(layers: DataFrame, cuts: DataFrame) -> DataFrame:
    """Layers that start a new row at each of their graph's cuts (graph_id, layer); cuts beyond the layers do nothing."""
    lists = cuts.groupBy("graph_id").agg(F.array_sort(F.collect_set("layer")).alias("cuts"))
    n = layers.join(lists, "graph_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>")))
    past = F.filter("cuts", lambda c: (c > 0) & (c <= F.col("layer")))
    return n.select("graph_id", "node_id", F.size(past).alias("row"), (F.col("layer") - F.coalesce(F.array_max(past), F.lit(0))).cast("int").alias("layer"))


def wrapped_by_width(sizes: DataFrame, most: float, gap: float = 20.0) -> DataFrame:
    """(graph_id, layer, size) -> row and start of each layer: a row ends before the layer that would pass ``most``."""
    per = sizes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("layer", "size"))).alias("l"))
    first = F.struct(F.lit(0).alias("row"), F.lit(0.0).alias("end"), F.array().cast("array<struct<layer:int,row:int,start:double>>").alias("out"))

    def step(state, s):
        start = F.when(F.size(state["out"]) == 0, 0.0).otherwise(state["end"] + gap)
        turn = (start > 0) & (start + s["size"] > most)
        row, start = state["row"] + turn.cast("int"), F.when(turn, 0.0).otherwise(start)
        placed = F.struct(s["layer"].cast("int").alias("layer"), row.alias("row"), start.alias("start"))
        return F.struct(row.alias("row"), (start + s["size"]).alias("end"), F.concat(state["out"], F.array(placed)).alias("out"))

    return per.select("graph_id", F.inline(F.aggregate("l", first, step, lambda s: s["out"])))


def place_by_cross(nodes: DataFrame, order: DataFrame, layer_gap: float = 20.0, node_gap: float = 20.0, padding: float = 12.0) -> DataFrame:
    """Layers side by side; nodes stay at their authored height unless the one before them in the layer is in the way,
    then they move down just so far.  The topmost node of a graph is at the padding.

    A node's height is the greatest, over those up to it, of an authored one plus the room of the nodes from there on.
    """
    flow = place_simple(nodes, order, layer_gap, node_gap, padding).select("graph_id", "node_id", "layer", "x", "width", "height")
    n = flow.join(order.select("graph_id", "node_id", "pos"), ["graph_id", "node_id"]).join(nodes.select("graph_id", "node_id", F.col("y").alias("own")), ["graph_id", "node_id"])
    by = Window.partitionBy("graph_id", "layer").orderBy("pos")
    room = F.coalesce(F.sum(F.col("height") + node_gap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    n = n.withColumn("room", room).withColumn("at", F.col("room") + F.max(F.col("own") - F.col("room")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return n.select("graph_id", "node_id", "layer", "x", (F.col("at") - F.min("at").over(Window.partitionBy("graph_id")) + padding).alias("y"), "width", "height")

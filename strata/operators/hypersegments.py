"""Orthogonal routes of layered drawings: every edge, over any number of layers, on tracks of the gaps it passes.

Edges of a gap that share a port are one hypersegment: a trunk with branches to the left and the right.  Trunks whose
heights overlap take different slots.  Which of two goes first decides what their branches cross, and where a branch of one ends at
the height at which the other's begins, only one way is left; rings of such needs are opened by splitting a trunk
in two.  A gap is one group of a task; routes are put together over all gaps by set-shaped joins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph as G

Trunk = tuple[list[float], list[float]]  # heights of the branches to the left, and to the right


def expanded(nodes: DataFrame, edges: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, order, segments) with a dummy of no size wherever an edge passes a layer.

    A layer is ordered by authored order; a dummy stands behind the source of its edge, in order of edges.
    """
    segments = G.split_long_edges(edges, layers).join(edges.select("graph_id", "edge_id", "source_id", F.col("ord").alias("edge_ord")), ["graph_id", "edge_id"])
    rank = nodes.select("graph_id", F.col("node_id").alias("source_id"), F.col("ord").alias("first"))
    dummies = segments.where("segment > 0").join(rank, ["graph_id", "source_id"]).select("graph_id", F.col("from_id").alias("node_id"), "layer", "first", F.lit(1).alias("then"), F.col("edge_ord").alias("last"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"))
    own = layers.join(nodes, ["graph_id", "node_id"]).select("graph_id", "node_id", "layer", F.col("ord").alias("first"), F.lit(0).alias("then"), F.lit(0).alias("last"), "width", "height")
    every = own.unionByName(dummies)
    pos = F.row_number().over(Window.partitionBy("graph_id", "layer").orderBy("first", "then", "last")) - 1
    every = every.select("graph_id", "node_id", "layer", pos.alias("pos"), "width", "height")
    return every.select("graph_id", "node_id", "width", "height"), every.select("graph_id", "node_id", "layer", "pos"), segments.drop("source_id")


def gap_ends(placed: DataFrame, order: DataFrame, segments: DataFrame) -> DataFrame:
    """Both ends of each segment.  All edges leave a node in the middle of its east side; they enter evenly spread over the
    west side, in order of where they come from.  A dummy is a point.  ``left`` and ``right`` bound the gap."""
    pos = order.select("graph_id", "node_id", "pos")
    n = placed.select("graph_id", "node_id", "x", "y", "width", "height")
    s = segments.join(pos.withColumnsRenamed({"node_id": "from_id", "pos": "from_pos"}), ["graph_id", "from_id"])
    side = Window.partitionBy("graph_id", "to_id")
    part = F.row_number().over(side.orderBy("from_pos", "edge_ord")) / (F.count("*").over(side) + 1)
    s = s.withColumn("part", part).withColumn("to_dummy", F.col("to_id").startswith("__dummy:"))
    source = n.select("graph_id", F.col("node_id").alias("from_id"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height") / 2).alias("y1"))
    target = n.select("graph_id", F.col("node_id").alias("to_id"), F.col("x").alias("x2"), F.col("y").alias("ty"), F.col("height").alias("th"))
    s = s.join(source, ["graph_id", "from_id"]).join(target, ["graph_id", "to_id"])
    bounds = placed.join(order.select("graph_id", "node_id", F.col("layer").alias("l")), ["graph_id", "node_id"]).groupBy("graph_id", "l").agg(F.min("x").alias("lx"), F.max(F.col("x") + F.col("width")).alias("rx"))
    s = s.join(bounds.select("graph_id", F.col("l").alias("layer"), F.col("rx").alias("left")), ["graph_id", "layer"])
    s = s.join(bounds.select("graph_id", (F.col("l") - 1).alias("layer"), F.col("lx").alias("right")), ["graph_id", "layer"])
    return s.select("graph_id", "edge_id", "segment", "layer", "from_id", "to_id", "x1", "y1", "x2", (F.col("ty") + F.col("th") * F.col("part")).alias("y2"), "left", "right")


def trunks(ends: DataFrame) -> DataFrame:
    """One row a hypersegment with a trunk, where edges share ports at their sources: its extent, members and junctions
    (heights where three or more of its lines meet)."""
    at = ends.select("graph_id", "layer", "from_id", "edge_id", F.inline(F.array(*[F.struct(F.col(y).alias("y"), F.lit(o).alias("out")) for y, o in (("y1", 0), ("y2", 1))])))
    heights = at.groupBy("graph_id", "layer", "from_id", "y").agg(F.countDistinct("out").alias("sides"))
    span = Window.partitionBy("graph_id", "layer", "from_id")
    heights = heights.withColumns({"low": F.min("y").over(span), "high": F.max("y").over(span)})
    lines = F.col("sides") + (F.col("y") > F.col("low")).cast("int") + (F.col("y") < F.col("high")).cast("int")
    found = heights.where("high > low").groupBy("graph_id", "layer", "from_id").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.sum((lines >= 3).cast("int")).alias("junctions"))
    members = ends.groupBy("graph_id", "layer", "from_id").agg(F.count("*").alias("members"))
    return found.join(members, ["graph_id", "layer", "from_id"])


def _inside(heights: list[float], span: list[float]) -> int:
    return bisect_left(heights, span[-1]) - bisect_right(heights, span[0])


def _extent(t: Trunk) -> list[float]:
    both = t[0] + t[1]
    return [min(both), max(both)]


def crossings(order: list[int], given: list[Trunk]) -> int:
    """Branches that cross trunks when trunks stand in ``order`` from the left."""
    extent = [_extent(t) for t in given]
    return sum(_inside(given[b][0], extent[a]) + _inside(given[a][1], extent[b]) for i, a in enumerate(order) for b in order[i + 1 :])


def _needs(given: list[Trunk], splits: dict[int, tuple[int, float]]) -> list[set[int]]:
    """For each trunk those that must stand before it: it begins a right branch where their left branch comes in."""
    begins: dict[float, list[int]] = {}
    for a, (ins, _) in enumerate(given):
        for y in ins:
            begins.setdefault(y, []).append(a)
    before = [set() for _ in given]
    for a, (_, outs) in enumerate(given):
        for y in outs:
            # b's branch comes from the left at y, a's goes to the right: b has to end before a begins
            before[a].update(b for b in begins.get(y, ()) if b != a)
    for a, (b, _) in splits.items():  # the two parts of a trunk share their line
        before[a].discard(b)
        before[b].add(a)
    return before


def _ring(before: list[set[int]]) -> list[int]:
    """Trunks that no order can serve; empty if there is one."""
    left = [set(b) for b in before]
    ready, gone = [a for a, b in enumerate(left) if not b], set()
    while ready:
        a = ready.pop()
        gone.add(a)
        for c, b in enumerate(left):
            if a in b:
                b.discard(a)
                if not b:
                    ready.append(c)
    return [a for a in range(len(before)) if a not in gone]


def _by_gain(cost: list[list[int]], before: list[set[int]], key: list[float] | None = None) -> list[int]:
    """One after another the trunk, of those that may come next, that saves most by standing before the rest (or whose
    ``key`` is least)."""
    n, order, rest = len(cost), [], set(range(len(cost)))
    gain = [sum(cost[a][b] - cost[b][a] for b in range(n)) for a in range(n)]
    while rest:
        a = min((a for a in rest if not before[a] & rest), key=lambda a: (gain[a] if key is None else key[a], a))
        order.append(a)
        rest.discard(a)
        for b in rest:
            gain[b] -= cost[b][a] - cost[a][b]
    return order


def _improved(order: list[int], cost: list[list[int]], before: list[set[int]]) -> list[int]:
    """Trunks move to other places while that takes crossings away."""
    order, changed = order[:], True
    while changed:
        changed = False
        for a in order[:]:
            i = order.index(a)
            moves = [(0, i)]
            for step, stop in ((1, len(order)), (-1, -1)):
                saved = 0
                for j in range(i + step, stop, step):
                    b = order[j]
                    if (a in before[b]) if step > 0 else (b in before[a]):
                        break
                    saved += (cost[b][a] - cost[a][b]) * step
                    moves.append((saved, j))
            saved, j = min(moves)
            if saved < 0:
                order.insert(j, order.pop(i))
                changed = True
    return order


def arranged(given: list[Trunk]) -> tuple[list[int], dict[int, tuple[int, float]]]:
    """(slot of each trunk, splits): a split trunk keeps its left branches, its right ones move to another trunk at the end of the list, and
    both meet at a height of their own.  Trunks of one slot don't overlap."""
    given = [(sorted(i), sorted(o)) for i, o in given]
    splits: dict[int, tuple[int, float]] = {}
    while ring := _ring(_needs(given, splits)):
        a = min((a for a in ring if a not in splits and a < len(given) - len(splits)), key=lambda a: (_extent(given[a])[1] - _extent(given[a])[0], a))
        low, high = _extent(given[a])
        taken = sorted({y for t in given for y in t[0] + t[1] if low <= y <= high})
        gap, y = max(((q - p), (p + q) / 2) for p, q in zip(taken, taken[1:], strict=False))
        splits[a] = (len(given), y)
        given.append(([y], given[a][1]))
        given[a] = (given[a][0], [y])
    before = _needs(given, splits)
    extent = [_extent(t) for t in given]
    n = len(given)
    cost = [[0 if a == b else _inside(given[b][0], extent[a]) + _inside(given[a][1], extent[b]) for b in range(n)] for a in range(n)]  # a before b
    order = min((_improved(o, cost, before) for o in (_by_gain(cost, before), _by_gain(cost, before, [e[0] for e in extent]))), key=lambda o: sum(cost[a][b] for i, a in enumerate(o) for b in o[i + 1 :]))
    slot = [0] * n
    for i, b in enumerate(order):
        for a in order[:i]:
            if a in before[b] or (extent[a][0] <= extent[b][1] and extent[b][0] <= extent[a][1]):
                slot[b] = max(slot[b], slot[a] + 1)
    return slot, splits


def _of_gap(rows: pd.DataFrame) -> tuple[list[list[int]], list[Trunk]]:
    """Hypersegments of a gap (rows that share a port, directly or not) and the heights of their branches; straight
    ones have no trunk."""
    root = list(range(len(rows)))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    seen: dict[tuple, int] = {}
    for i, (source, target, y2) in enumerate(zip(rows["from_id"], rows["to_id"], rows["y2"], strict=True)):
        for key in (("from", source), ("to", target, y2)):
            root[find(i)] = find(seen.setdefault(key, i))
    members: dict[int, list[int]] = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    y1, y2 = list(rows["y1"]), list(rows["y2"])
    groups = [m for m in members.values() if len({y1[i] for i in m} | {y2[i] for i in m}) > 1]
    return groups, [(sorted({y1[i] for i in m}), sorted({y2[i] for i in m})) for m in groups]


def gap_routes(ends: DataFrame) -> DataFrame:
    """(graph_id, edge_id, segment, layer, slots, slot, points): each segment's way through its gap.  Slots are evenly spread."""
    schema = "graph_id string, edge_id string, segment int, layer int, slots int, slot int, points array<struct<x:double,y:double>>"

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y1", "from_id", "y2", "edge_id"]).reset_index(drop=True)
        groups, given = _of_gap(rows)
        slot, splits = arranged(given)
        slots = max(slot, default=-1) + 1
        left, right = float(rows["left"].iloc[0]), float(rows["right"].iloc[0])
        x_of = lambda k: left + (right - left) * (k + 1) / (slots + 1)
        trunk = {i: g for g, m in enumerate(groups) for i in m}
        out = []
        for i, r in enumerate(rows.itertuples(index=False)):
            points, g = [(r.x1, r.y1)], trunk.get(i)
            if g is not None:
                height, x = r.y2, x_of(slot[g])
                if g in splits:
                    other, height = splits[g]
                    points += [(x, r.y1), (x, height), (x_of(slot[other]), height), (x_of(slot[other]), r.y2)]
                else:
                    points += [(x, r.y1), (x, r.y2)]
            points.append((r.x2, r.y2))
            out.append((r.graph_id, r.edge_id, r.segment, r.layer, slots, -1 if g is None else slot[g], [{"x": float(x), "y": float(y)} for x, y in points]))
        return pd.DataFrame(out, columns=["graph_id", "edge_id", "segment", "layer", "slots", "slot", "points"])

    return ends.groupBy("graph_id", "layer").applyInPandas(kernel, schema)


def _corners(points: Column) -> Column:
    """First, last, and the points where the direction changes."""
    turned = lambda a, b, c: ~(((a["x"] == b["x"]) & (b["x"] == c["x"])) | ((a["y"] == b["y"]) & (b["y"] == c["y"])))
    distinct = F.filter(points, lambda p, i: (i == 0) | (F.get(points, i - 1) != p))
    last = F.size(distinct) - 1
    return F.filter(distinct, lambda p, i: (i == 0) | (i == last) | turned(F.get(distinct, i - 1), p, F.get(distinct, i + 1)))


def edge_routes(ways: DataFrame) -> DataFrame:
    """(graph_id, edge_id, points): an edge's ways put together, without points on a straight line."""
    whole = ways.groupBy("graph_id", "edge_id").agg(F.array_sort(F.collect_list(F.struct("segment", "points"))).alias("w"))
    return whole.select("graph_id", "edge_id", _corners(F.flatten(F.col("w.points"))).alias("points"))


def hyper_routes(nodes: DataFrame, edges: DataFrame, layers: DataFrame, layer_gap: float = 20.0) -> DataFrame:
    """Routes of all edges (in flow direction, from an earlier layer to a later one) of a layered drawing."""
    every, order, segments = expanded(nodes, edges, layers)
    return edge_routes(gap_routes(gap_ends(G.place_simple(every, order, layer_gap), order, segments)))

"""Compaction of drawings along x: boxes move together as far as those that see each other let them.

A sweep along y keeps the boxes it is in, in order of x; two that become neighbours in it see each other, and the right
one has to stay behind the left one's end.  All other pairs follow from these, so a graph has at most three times as many
constraints as boxes.  Places are longest paths over the constraints; with edge lengths as the aim, the network simplex of the layers with
spans of their own.  A graph is one group of a task.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import network_simplex

KINDS = ("NONE", "LEFT", "RIGHT", "LEFT_RIGHT_CONSTRAINT_LOCKING", "LEFT_RIGHT_CONNECTION_LOCKING", "EDGE_LENGTH")
Box = tuple[float, float, float, float]  # x, y, width, height
_GRAIN = 1000  # parts of a unit that edge lengths are counted in


def visible(boxes: list[Box], side_gap: float = 0.0) -> list[tuple[int, int]]:
    """Pairs (left, right) of boxes that are neighbours at some height, where boxes nearer than ``side_gap`` along y share
    one.  Left is the one with the lesser x, then width, then number."""
    events = sorted([(b[1] - side_gap / 2, 1, i) for i, b in enumerate(boxes)] + [(b[1] + b[3] + side_gap / 2, 0, i) for i, b in enumerate(boxes)])
    key = lambda i: (boxes[i][0], boxes[i][2], i)
    active: list[tuple[float, float, int]] = []
    pairs: set[tuple[int, int]] = set()
    for _, begins, i in events:
        if begins:
            if boxes[i][3] + side_gap <= 0:
                continue
            insort(active, key(i))
            at = bisect_left(active, key(i))
            pairs |= {(active[k - 1][2], active[k][2]) for k in (at, at + 1) if 0 < k < len(active)}
        elif (at := bisect_left(active, key(i))) < len(active) and active[at] == key(i):
            del active[at]
            if 0 < at < len(active):
                pairs.add((active[at - 1][2], active[at][2]))
    return sorted(pairs)


def pushed(boxes: list[Box], gap: float, side_gap: float, to_right: bool, locked: set[int] = frozenset()) -> list[float]:
    """x of every box after all move to the left (or right) end of the drawing; ``locked`` ones don't pass their own place."""
    turned = [(-x - w, y, w, h) if to_right else (x, y, w, h) for x, y, w, h in boxes]
    end = min((b[0] for b in turned), default=0.0)
    at = [b[0] if i in locked else end for i, b in enumerate(turned)]
    behind: list[list[int]] = [[] for _ in turned]
    for a, b in visible(turned, side_gap):
        behind[a].append(b)
    for a in sorted(range(len(turned)), key=lambda i: (turned[i][0], turned[i][2], i)):
        for b in behind[a]:
            at[b] = max(at[b], at[a] + turned[a][2] + gap)
    return [-x - b[2] if to_right else x for x, b in zip(at, turned, strict=True)]


def shortest_edges(boxes: list[Box], edges: list[tuple[int, int, int]], gap: float, side_gap: float) -> list[float]:
    """x of every box so that weight times length along x, summed over edges, is least; edges keep their direction."""
    order = lambda i: (boxes[i][0], boxes[i][2], i)
    rows = [(a, b, 0) for a, b in visible(boxes, side_gap)] + [(*sorted((s, t), key=order), w) for s, t, w in edges if s != t]
    spans = [-int(-(boxes[a][2] + gap) * _GRAIN // 1) for a, _, _ in rows]
    end = min((b[0] for b in boxes), default=0.0)
    return [end + x / _GRAIN for x in network_simplex(len(boxes), rows, spans)] if rows else [end] * len(boxes)


def compacted(nodes: DataFrame, edges: DataFrame, kind: str = "LEFT", gap: float = 20.0, side_gap: float = 20.0) -> DataFrame:
    """(graph_id, node_id, x, y, width, height) of placed ``nodes`` after compaction along x.

    ``gap`` lies between boxes side by side, ``side_gap`` between those one above the other, who needn't keep it.  The two
    kinds with locks push to the left, then to the right, where locked boxes stay if nothing is in their way: those without edges, or those that
    more edges enter than leave.
    """
    if kind not in KINDS:
        raise ValueError(f"no compaction {kind!r}; there are {', '.join(KINDS)}")
    out, into = (edges.where("source_id <> target_id").groupBy("graph_id", F.col(c).alias("node_id")).agg(F.count("*").alias(n)) for c, n in (("source_id", "n_out"), ("target_id", "n_in")))
    rows = nodes.select("graph_id", "node_id", "x", "y", "width", "height").join(out, ["graph_id", "node_id"], "left").join(into, ["graph_id", "node_id"], "left").na.fill(0, ["n_out", "n_in"])
    if kind == "NONE":
        return rows.drop("n_out", "n_in")

    def kernel(box: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        box = box.sort_values("node_id").reset_index(drop=True)
        boxes = list(zip(*[box[c].astype(float) for c in ("x", "y", "width", "height")], strict=True))
        if kind == "EDGE_LENGTH":
            number = {n: i for i, n in enumerate(box["node_id"])}
            box["x"] = shortest_edges(boxes, [(number[s], number[t], int(w)) for s, t, w in zip(edge["source_id"], edge["target_id"], edge["weight"], strict=True) if s in number and t in number], gap, side_gap)
        else:
            box["x"] = pushed(boxes, gap, side_gap, kind == "RIGHT")
            if kind.startswith("LEFT_RIGHT"):
                lock = box["n_in"] + box["n_out"] == 0 if kind == "LEFT_RIGHT_CONSTRAINT_LOCKING" else box["n_in"] > box["n_out"]
                boxes = [(x, *b[1:]) for x, b in zip(box["x"], boxes, strict=True)]
                box["x"] = pushed(boxes, gap, side_gap, True, set(box.index[lock]))
        return box[["graph_id", "node_id", "x", "y", "width", "height"]]

    of_graph = edges.select("graph_id", "source_id", "target_id", "weight").groupBy("graph_id")
    return rows.groupBy("graph_id").cogroup(of_graph).applyInPandas(kernel, "graph_id string, node_id string, x double, y double, width double, height double")

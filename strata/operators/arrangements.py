"""Tree and radial arrangements as set operations over the closure, force arrangement and obstacle-avoiding routes as kernels."""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import closure
from .kernels import SMALL, Edges


def tree_slots(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_id, depth, low, high, leaves): the first and last leaf, in path order, below each node."""
    up = closure(nodes)
    paths = up.groupBy("graph_id", "node_id").agg(F.max("depth").alias("depth"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "ancestor_id")), asc=False), lambda s: s["ancestor_id"]), "/").alias("above"))
    n = nodes.select("graph_id", "node_id").join(paths, ["graph_id", "node_id"], "left")
    n = n.select("graph_id", "node_id", F.coalesce("depth", F.lit(0)).alias("depth"), F.concat_ws("/", "above", "node_id").alias("path"))
    parents = nodes.where("parent_id is not null").select("graph_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = n.join(parents, ["graph_id", "node_id"], "left_anti")
    leaves = leaves.select("graph_id", F.col("node_id").alias("leaf"), (F.row_number().over(Window.partitionBy("graph_id").orderBy("path")) - 1).alias("slot"))
    below = up.select("graph_id", F.col("node_id").alias("leaf"), F.col("ancestor_id").alias("node_id")).unionByName(leaves.select("graph_id", "leaf", F.col("leaf").alias("node_id")))
    spans = below.join(leaves, ["graph_id", "leaf"]).groupBy("graph_id", "node_id").agg(F.min("slot").alias("low"), F.max("slot").alias("high"))
    counts = leaves.groupBy("graph_id").agg(F.count("*").alias("leaves"))
    return n.drop("path").join(spans, ["graph_id", "node_id"]).join(counts, "graph_id")


def tree_arrangement(nodes: DataFrame, across: float = 60.0, down: float = 100.0) -> DataFrame:
    """Leaves side by side, a parent over the middle of its leaves, levels below each other."""
    return tree_slots(nodes).select("graph_id", "node_id", ((F.col("low") + F.col("high")) / 2 * across).alias("x"), (F.col("depth") * down).alias("y"))


def radial_arrangement(nodes: DataFrame, ring: float = 100.0) -> DataFrame:
    """Levels on rings, leaves spread evenly over the circle."""
    angle = 2 * math.pi * ((F.col("low") + F.col("high")) / 2 + 0.5) / F.col("leaves")
    at = lambda f: F.round(F.col("depth") * ring * f(angle), 6) + 0.0
    return tree_slots(nodes).select("graph_id", "node_id", at(F.cos).alias("x"), at(F.sin).alias("y"))


def force_arrangement(n: int, edges: Edges, length: float = 100.0, rounds: int = 300, least: float = 1e-3) -> np.ndarray:
    """Springs along edges, repulsion between all nodes, steps bounded by a falling temperature; starts on a circle.

    Names and weights don't count, so small graphs are often the same one: these are arranged once a worker.
    """
    ends = np.array([(s, t) for s, t, _ in edges if s != t], np.int64).reshape(-1, 2)
    if n <= SMALL and len(ends) <= SMALL * SMALL:
        return _same_force(n, ends.tobytes(), length, rounds, least).copy()
    return _force(n, ends, length, rounds, least)


@functools.lru_cache(maxsize=1 << 15)
def _same_force(n: int, ends: bytes, length: float, rounds: int, least: float) -> np.ndarray:
    return _force(n, np.frombuffer(ends, np.int64).reshape(-1, 2), length, rounds, least)


def _force(n: int, ends: np.ndarray, length: float, rounds: int, least: float) -> np.ndarray:
    turn = 2 * np.pi * np.arange(n) / max(1, n)
    p = np.stack((np.cos(turn), np.sin(turn)), axis=1) * length
    apart = (np.arange(n)[:, None] - np.arange(n)[None])[..., None] * np.array([1e-3, 2e-3])
    for k in range(rounds):
        gap = p[:, None] - p[None]
        gap = np.where((gap == 0).all(axis=2, keepdims=True), apart, gap)  # nodes that meet part again, by their order
        dist = np.maximum(np.sqrt((gap**2).sum(axis=2)), 1e-6)
        push = (gap * (length**2 / dist**2)[..., None]).sum(axis=1)
        pull = p[ends[:, 0]] - p[ends[:, 1]]
        pull *= (np.sqrt((pull**2).sum(axis=1)) / length)[:, None]
        np.subtract.at(push, ends[:, 0], pull)
        np.add.at(push, ends[:, 1], pull)
        far = np.sqrt((push**2).sum(axis=1, keepdims=True))
        step = push * np.minimum(1.0, max(1.0, length * (1 - k / rounds)) / np.maximum(far, 1e-9))
        p = p + step
        if np.abs(step).max(initial=0.0) < least:
            break
    return p


Box = tuple[float, float, float, float]


def orthogonal_route(source: Box, target: Box, others: list[Box], clearance: float = 8.0, bend: float = 10.0) -> list[tuple[float, float]]:
    """Shortest axis-parallel path between the middles of two boxes' sides, around the other boxes.

    Search over (grid point, direction) on the lines through ends and inflated box sides, cost: length plus ``bend``
    each bend.  Where nothing gets through, an elbow from centre to centre is the fallback; a route always comes out.
    """
    def ends(b: Box) -> list[tuple[float, float]]:
        x, y, w, h = b
        return [(x + w / 2, y), (x + w, y + h / 2), (x + w / 2, y + h), (x, y + h / 2)]

    c = clearance
    fat = [(x - c, y - c, x + w + c, y + h + c) for x, y, w, h in others]
    own = [(x, y, x + w, y + h) for x, y, w, h in (source, target)]
    starts, goals = ends(source), set(ends(target))
    edge = [(x - c, y - c, x + w + c, y + h + c) for x, y, w, h in (source, target)]
    xs = sorted({v for b in fat + edge for v in (b[0], b[2])} | {p[0] for p in [*starts, *goals]})
    ys = sorted({v for b in fat + edge for v in (b[1], b[3])} | {p[1] for p in [*starts, *goals]})

    def free(a: tuple[float, float], b: tuple[float, float]) -> bool:
        lo, hi = (min(a[0], b[0]), min(a[1], b[1])), (max(a[0], b[0]), max(a[1], b[1]))
        return not any(lo[0] < r[2] and hi[0] > r[0] and lo[1] < r[3] and hi[1] > r[1] for r in fat + own)

    at_x, at_y = {v: i for i, v in enumerate(xs)}, {v: i for i, v in enumerate(ys)}
    heap = [(0.0, k, p, -1, None) for k, p in enumerate(starts)]
    seen, count = {}, len(heap)
    while heap:
        cost, _, p, way, came = heapq.heappop(heap)
        if (p, way) in seen:
            continue
        seen[p, way] = came
        if p in goals:
            path, key = [], (p, way)
            while key:
                path.append(key[0])
                key = seen[key]
            path.reverse()
            keep = [q for i, q in enumerate(path) if not 0 < i < len(path) - 1 or not (path[i - 1][0] == q[0] == path[i + 1][0] or path[i - 1][1] == q[1] == path[i + 1][1])]
            return keep if len(keep) > 1 else [p, p]
        i, j = at_x[p[0]], at_y[p[1]]
        for turn, (a, b) in enumerate(((i + 1, j), (i, j + 1), (i - 1, j), (i, j - 1))):
            if 0 <= a < len(xs) and 0 <= b < len(ys) and (way < 0 or (turn - way) % 4 != 2) and free(p, q := (xs[a], ys[b])):
                count += 1
                heapq.heappush(heap, (cost + abs(q[0] - p[0]) + abs(q[1] - p[1]) + bend * (way >= 0 and turn != way), count, q, turn, (p, way)))
    (sx, sy), (tx, ty) = ((b[0] + b[2] / 2, b[1] + b[3] / 2) for b in (source, target))
    return [(sx, sy), ((sx + tx) / 2, sy), ((sx + tx) / 2, ty), (tx, ty)]

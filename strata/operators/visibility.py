"""Shortest ways around boxes in any direction, and curves fitted to them.

Boxes are barriers, ``clearance`` wider on each side.  A way leaves its box at right angles in the middle of a side, runs between
corners of barriers that see each other, and enters the other box likewise; it is the shortest of all.  A curve of one cubic a
stretch follows it: it keeps the way's tangent at corners, and its handles are halved until it is clear of all boxes.  What a point sees is
worked out when the search settles it, so pairs of points that no way needs are never looked at.  A graph is one group of a task.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]  # x, y, width, height
Point = tuple[float, float]
Cubic = tuple[Point, Point, Point, Point]
#: Barriers are open, and this much smaller: a line along a side is clear of it.
EPS = 1e-6
#: Outward from the middles of the sides, in the order in which points are numbered.
_OUT = ((0, -1), (1, 0), (0, 1), (-1, 0))


class Field:
    """Barriers of a graph and their points: of each box four corners (0 to 3), then the middles of its sides (4 to 7)."""

    def __init__(self, boxes: list[Box], clearance: float = 8.0):
        self.boxes, self.clearance = boxes, clearance
        b = np.array(boxes, float).reshape(-1, 4)
        self.low, self.high = b[:, :2] - clearance, b[:, :2] + b[:, 2:] + clearance
        (x1, y1), (x2, y2) = self.low.T, self.high.T
        mx, my = (x1 + x2) / 2, (y1 + y2) / 2
        xs, ys = (x1, x2, x2, x1, mx, x2, mx, x1), (y1, y1, y2, y2, y1, my, y2, my)
        self.points = np.stack([np.stack(xs, 1), np.stack(ys, 1)], 2).reshape(-1, 2)
        self._seen: dict[int, np.ndarray] = {}

    def sees(self, i: int, at_once: int = 256) -> np.ndarray:
        """Numbers of the points that point ``i`` sees."""
        if i not in self._seen:
            p, q = self.points[i], self.points
            clear = np.ones(len(q), bool)
            for k in range(0, len(self.boxes), at_once):
                enter, leave = np.zeros((len(q), min(at_once, len(self.boxes) - k))), None
                leave = np.ones_like(enter)
                for a in (0, 1):
                    low, high = self.low[k : k + at_once, a] + EPS, self.high[k : k + at_once, a] - EPS
                    step = (q[:, a] - p[a])[:, None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        one, two = (low - p[a]) / step, (high - p[a]) / step
                    flat = np.abs(step) < 1e-9
                    inside = (p[a] > low) & (p[a] < high)
                    enter = np.maximum(enter, np.where(flat, np.where(inside, -math.inf, math.inf), np.minimum(one, two)))
                    leave = np.minimum(leave, np.where(flat, math.inf, np.maximum(one, two)))
                clear &= ~(enter < leave).any(axis=1)
            clear[i] = False
            self._seen[i] = np.flatnonzero(clear)
        return self._seen[i]

    def ways(self, s: int, targets: set[int]) -> dict[int, tuple[float, list[int]]]:
        """The shortest way from box ``s`` to each of ``targets``: its length, without what lies inside the barriers, and its points."""
        best = {s * 8 + k: 0.0 for k in range(4, 8)}
        came, heap, done, found = {}, [(0.0, i) for i in best], set(), {}
        while heap and len(found) < len(targets):
            far, i = heapq.heappop(heap)
            if i in done:
                continue
            done.add(i)
            box, k = divmod(i, 8)
            if k >= 4 and box in targets and box not in found:
                way = [i]
                while way[-1] in came:
                    way.append(came[way[-1]])
                found[box] = (far, way[::-1])
            if k >= 4 and box != s:
                continue  # sides are ends of ways only
            seen = self.sees(i)
            steps = np.hypot(*(self.points[seen] - self.points[i]).T)
            for j, d in zip(seen.tolist(), steps.tolist(), strict=True):
                if far + d < best.get(j, math.inf):
                    best[j], came[j] = far + d, i
                    heapq.heappush(heap, (far + d, j))
        return found

    def drawn(self, way: list[int]) -> list[Point]:
        """A way's points from border to border."""
        ends = []
        for i in (way[0], way[-1]):
            (x, y), (dx, dy) = self.points[i], _OUT[i % 8 - 4]
            ends.append((x - dx * self.clearance, y - dy * self.clearance))
        return [ends[0], *[tuple(map(float, self.points[i])) for i in way], ends[1]]

    def curves(self, way: list[int], most_halvings: int = 6) -> tuple[list[Cubic], int]:
        """Cubics along a way, clear of other boxes by half the clearance and of its own boxes; and how many are straight."""
        at = _without_middles(self.drawn(way))
        own, half = {way[0] // 8, way[-1] // 8}, self.clearance / 2
        barred = [(x, y, w, h) if k in own else (x - half, y - half, w + 2 * half, h + 2 * half) for k, (x, y, w, h) in enumerate(self.boxes)]
        start, end = _OUT[way[0] % 8 - 4], _OUT[way[-1] % 8 - 4]
        inner = [_unit(_sum(_unit(_less(b, a)), _unit(_less(c, b)))) for a, b, c in zip(at, at[1:], at[2:])]
        way_at = [(float(start[0]), float(start[1])), *inner, (-float(end[0]), -float(end[1]))]
        out, straight = [], 0
        for k, (a, b) in enumerate(zip(at, at[1:])):
            far = math.dist(a, b)
            for n in range(most_halvings + 1):
                h = far / 3 / 2**n
                curve = (a, _sum(a, way_at[k], h), _sum(b, way_at[k + 1], -h), b)
                if all(avoids(curve, box) for box in barred):
                    break
            else:
                curve, straight = (a, _mix(a, b, 1 / 3), _mix(a, b, 2 / 3), b), straight + 1
            out.append(curve)
        return out, straight


def _less(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1]


def _sum(a: Point, b: Point, times: float = 1.0) -> Point:
    return a[0] + b[0] * times, a[1] + b[1] * times


def _mix(a: Point, b: Point, t: float = 0.5) -> Point:
    return a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t


def _unit(a: Point) -> Point:
    n = math.hypot(*a)
    return (a[0] / n, a[1] / n) if n else (0.0, 0.0)


def _without_middles(at: list[Point]) -> list[Point]:
    """Points at which the way turns, and its ends."""
    out = at[:1]
    for b, c in zip(at[1:], at[2:] + [None]):
        if c is None:
            out.append(b)
        elif b != out[-1]:
            u, v = _less(b, out[-1]), _less(c, b)
            if abs(u[0] * v[1] - u[1] * v[0]) > EPS or u[0] * v[0] + u[1] * v[1] < 0:
                out.append(b)
    return out


def avoids(curve: Cubic, box: Box, depth: int = 14) -> bool:
    """Whether a cubic stays out of a box's inside.  Never wrongly true: the hull of the control points bounds the curve, and what
    is still undecided after ``depth`` halvings counts as a hit."""
    x, y, w, h = box
    xs, ys = [p[0] for p in curve], [p[1] for p in curve]
    if max(xs) <= x + EPS or min(xs) >= x + w - EPS or max(ys) <= y + EPS or min(ys) >= y + h - EPS:
        return True
    if not depth or any(x + EPS < p[0] < x + w - EPS and y + EPS < p[1] < y + h - EPS for p in (curve[0], curve[3])):
        return False
    left, right = halves(curve)
    return avoids(left, box, depth - 1) and avoids(right, box, depth - 1)


def halves(curve: Cubic) -> tuple[Cubic, Cubic]:
    a, b, c, d = curve
    ab, bc, cd = _mix(a, b), _mix(b, c), _mix(c, d)
    abc, bcd = _mix(ab, bc), _mix(bc, cd)
    m = _mix(abc, bcd)
    return (a, ab, abc, m), (m, bcd, cd, d)


_POINT = "struct<x:double,y:double>"


def visible_ways(nodes: DataFrame, edges: DataFrame, clearance: float = 8.0) -> DataFrame:
    """(graph_id, edge_id, length, points, curves, straight) of every edge between two placed nodes.

    ``length`` is that of the way, border to border; ``curves`` has four control points a stretch; ``straight`` counts the stretches
    where no bent curve was clear.  Where boxes leave no way, all of them are null.  Self-loops and edges with an end that is
    no node are left out; of repeated edges each has its row.  Ties go to the point first reached.
    """
    schema = f"graph_id string, edge_id string, length double, points array<{_POINT}>, curves array<array<{_POINT}>>, straight int"

    def said(points) -> list[dict]:
        return [{"x": float(x), "y": float(y)} for x, y in points]

    def kernel(box: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(box) and len(edge):
            box = box.sort_values("node_id")
            number = {n: i for i, n in enumerate(box["node_id"])}
            field = Field(list(zip(*[box[c].astype(float) for c in ("x", "y", "width", "height")], strict=True)), clearance)
            links: dict[int, list[tuple[str, str, int]]] = {}
            for g, e, s, t in zip(edge["graph_id"], edge["edge_id"], edge["source_id"], edge["target_id"], strict=True):
                if s != t and s in number and t in number:
                    links.setdefault(number[s], []).append((g, e, number[t]))
            for s, own in links.items():
                ways = field.ways(s, {t for _, _, t in own})
                drawn = {t: (length + 2 * clearance, said(field.drawn(way)), *(lambda c: ([said(x) for x in c[0]], c[1]))(field.curves(way))) for t, (length, way) in ways.items()}
                out += [(g, e, *drawn.get(t, (None, None, None, None))) for g, e, t in own]
        return pd.DataFrame(out, columns=["graph_id", "edge_id", "length", "points", "curves", "straight"]).astype({"length": float, "straight": "Int32"})

    boxes = nodes.select("graph_id", "node_id", "x", "y", "width", "height")
    return boxes.groupBy("graph_id").cogroup(edges.select("graph_id", "edge_id", "source_id", "target_id").groupBy("graph_id")).applyInPandas(kernel, schema)


def corner_views(nodes: DataFrame, clearance: float = 8.0) -> DataFrame:
    """(graph_id, node_id, k, seen): how many points of barriers each one sees; k 0 to 3 corners, 4 to 7 middles of sides."""

    def kernel(box: pd.DataFrame) -> pd.DataFrame:
        field = Field(list(zip(*[box[c].astype(float) for c in ("x", "y", "width", "height")], strict=True)), clearance)
        rows = [(box["graph_id"].iloc[0], n, k, len(field.sees(i * 8 + k))) for i, n in enumerate(box["node_id"]) for k in range(8)]
        return pd.DataFrame(rows, columns=["graph_id", "node_id", "k", "seen"])

    return nodes.select("graph_id", "node_id", "x", "y", "width", "height").groupBy("graph_id").applyInPandas(kernel, "graph_id string, node_id string, k int, seen long")

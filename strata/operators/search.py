"""Routes found one after another on one grid of a graph, around its boxes and mindful of each other.

The grid's lines run along the boxes' sides, a clearance away, and through their middles.  A state of the search is a grid point with the
direction of arrival.  A step costs its length; a turn, a route crossed at the point passed, and each unit of length shared with a
route drawn before cost extra.  Earlier routes are kept as counts on the grid's edges and points, so a step asks for no
list of them.  A graph is one group of a task; edges go by weight, then by order.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]
Point = tuple[float, float]
_STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


@dataclass(frozen=True)
class Costs:
    bend: float = 10.0
    crossing: float = 15.0
    shared: float = 4.0
    clearance: float = 8.0


class Grid:
    """Lines, what bars their pieces, and what routes drawn so far lie on them."""

    def __init__(self, boxes: list[Box], costs: Costs = Costs()):
        self.boxes, self.costs, c = boxes, costs, costs.clearance
        self.xs = sorted({v for x, _, w, _ in boxes for v in (x - c, x, x + w / 2, x + w, x + w + c)})
        self.ys = sorted({v for _, y, _, h in boxes for v in (y - c, y, y + h / 2, y + h, y + h + c)})
        nx, ny = len(self.xs), len(self.ys)
        self.barred = [np.zeros((nx - 1, ny), int), np.zeros((nx, ny - 1), int)]  # pieces along x, along y
        self.used = [np.zeros((nx - 1, ny), int), np.zeros((nx, ny - 1), int)]
        self.passed = [np.zeros((nx, ny), int), np.zeros((nx, ny), int)]  # routes that go straight through a point
        for b in boxes:
            self._bar(b, c, 1)

    def _bar(self, box: Box, more: float, by: int) -> None:
        """Pieces that run through the inside of a box, ``more`` wider on each side."""
        x, y, w, h = box
        xs, ys = np.array(self.xs), np.array(self.ys)
        low, high = (x - more, y - more), (x + w + more, y + h + more)
        self.barred[0][np.ix_((xs[:-1] < high[0]) & (xs[1:] > low[0]), (ys > low[1]) & (ys < high[1]))] += by
        self.barred[1][np.ix_((xs > low[0]) & (xs < high[0]), (ys[:-1] < high[1]) & (ys[1:] > low[1]))] += by

    def _sides(self, box: Box) -> list[tuple[int, int]]:
        x, y, w, h = box
        at = [(x + w / 2, y), (x + w, y + h / 2), (x + w / 2, y + h), (x, y + h / 2)]
        return [(self.xs.index(a), self.ys.index(b)) for a, b in at]

    def step(self, state: tuple[int, int, int], way: int) -> tuple[tuple[int, int, int], float] | None:
        """The state after a step and its cost; None where it is barred."""
        i, j, came = state
        if came >= 0 and (way - came) % 4 == 2:
            return None
        axis, (dx, dy) = way % 2, _STEPS[way]
        a, b = i + dx, j + dy
        if not (0 <= a < len(self.xs) and 0 <= b < len(self.ys)):
            return None
        piece = (min(i, a), min(j, b))
        if self.barred[axis][piece]:
            return None
        c, length = self.costs, abs(self.xs[a] - self.xs[i]) + abs(self.ys[b] - self.ys[j])
        turn = c.bend if came >= 0 and way != came else 0.0
        crossed = c.crossing * self.passed[1 - axis][i, j] if way == came else 0.0
        return (a, b, way), length + turn + crossed + c.shared * length * self.used[axis][piece]

    def find(self, s: int, t: int) -> tuple[list[Point], float, int] | None:
        """(points, cost, states looked at) of the cheapest route between the middles of the sides of two boxes."""
        for k in {s, t}:  # a route may come near its own boxes, not into them
            self._bar(self.boxes[k], self.costs.clearance, -1)
            self._bar(self.boxes[k], 0.0, 1)
        try:
            return self._search(self._sides(self.boxes[s]), set(self._sides(self.boxes[t])))
        finally:
            for k in {s, t}:
                self._bar(self.boxes[k], 0.0, -1)
                self._bar(self.boxes[k], self.costs.clearance, 1)

    def _search(self, starts: list[tuple[int, int]], goals: set[tuple[int, int]]) -> tuple[list[Point], float, int] | None:
        ends = [(self.xs[i], self.ys[j]) for i, j in goals]
        rest = lambda i, j: min(abs(self.xs[i] - x) + abs(self.ys[j] - y) for x, y in ends)
        best = {(i, j, -1): 0.0 for i, j in starts}
        heap = [(rest(i, j), k, (i, j, -1)) for k, (i, j) in enumerate(starts)]
        came: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        done, count = set(), len(heap)
        while heap:
            _, _, state = heapq.heappop(heap)
            if state in done:
                continue
            done.add(state)
            if state[:2] in goals:
                way = [state]
                while way[-1] in came:
                    way.append(came[way[-1]])
                self._keep(way[::-1])
                return self._corners(way[::-1]), best[state], len(done)
            for w in range(4):
                if (found := self.step(state, w)) and best[state] + found[1] < best.get(found[0], float("inf")):
                    best[found[0]] = best[state] + found[1]
                    came[found[0]] = state
                    count += 1
                    heapq.heappush(heap, (best[found[0]] + rest(*found[0][:2]), count, found[0]))
        return None

    def _keep(self, way: list[tuple[int, int, int]]) -> None:
        for k in range(1, len(way)):
            a, b = way[k - 1], way[k]
            self.used[b[2] % 2][min(a[0], b[0]), min(a[1], b[1])] += 1
            if a[2] == b[2]:
                self.passed[b[2] % 2][a[0], a[1]] += 1

    def _corners(self, way: list[tuple[int, int, int]]) -> list[Point]:
        keep = [a for k, a in enumerate(way) if k in (0, len(way) - 1) or way[k + 1][2] != a[2]]
        return [(self.xs[i], self.ys[j]) for i, j, _ in keep]


def searched_routes(nodes: DataFrame, edges: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(graph_id, edge_id, turn, cost, states, points) of all edges between two placed nodes; ``turn`` counts a graph's edges in
    the order they were drawn, ``states`` what the search looked at.  Where nothing gets through, points are null."""
    schema = "graph_id string, edge_id string, turn int, cost double, states int, points array<struct<x:double,y:double>>"

    def kernel(box: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(box) and len(edge):
            box, edge = box.sort_values("node_id"), edge.sort_values(["weight", "ord"], ascending=[False, True])
            number = {n: i for i, n in enumerate(box["node_id"])}
            grid = Grid(list(zip(*[box[c].astype(float) for c in ("x", "y", "width", "height")], strict=True)), costs)
            pairs = [(g, e, number[s], number[t]) for g, e, s, t in zip(edge["graph_id"], edge["edge_id"], edge["source_id"], edge["target_id"], strict=True) if s != t and s in number and t in number]
            for turn, (g, e, s, t) in enumerate(pairs):
                found = grid.find(s, t)
                out.append((g, e, turn, *((None, 0, None) if found is None else (found[1], found[2], [{"x": float(x), "y": float(y)} for x, y in found[0]]))))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ", 5)]).astype({"cost": float})

    boxes = nodes.select("graph_id", "node_id", "x", "y", "width", "height")
    links = edges.select("graph_id", "edge_id", "source_id", "target_id", F.coalesce("weight", F.lit(0)).alias("weight"), "ord")
    return boxes.groupBy("graph_id").cogroup(links.groupBy("graph_id")).applyInPandas(kernel, schema)

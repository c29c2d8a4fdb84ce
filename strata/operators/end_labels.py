"""Labels at the ends of edges, moved along their routes to where nothing is under them.

A label that covers a node, another label or a route looks for a free spot: near its edge first and then in lanes further out, from the
end that it belongs to along the route.  Covering a box counts twice, a route through it once; where no spot is free the
one with least of it is taken.  Labels of a graph move one after another, in order of edges; a graph is one group of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Point = tuple[float, float]
_LANES = 8  # lanes tried on each side of a route
_LANE = 8.0


def spots(points: list[Point], width: float, height: float, spacing: float) -> Iterator[Point]:
    """Corners of a label's places beside a route: lanes outwards; in a lane along the route, below or right of it first."""
    for lane in range(_LANES + 1):
        off = spacing + _LANE * lane
        for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
            flat = abs(bx - ax) >= abs(by - ay)
            length, size = (abs(bx - ax), width) if flat else (abs(by - ay), height)
            if not length:
                continue
            free = length - size - 2 * spacing
            for at in np.arange(0.0, max(free, 0.0) + 1e-9, max(4.0, (free + 2 * spacing) / 16)) + spacing:
                if flat:
                    x = ax + at if bx > ax else ax - at - width
                    yield from ((float(x), ay + off), (float(x), ay - off - height))
                else:
                    y = ay + at if by > ay else ay - at - height
                    yield from ((ax + off, float(y)), (ax - off - width, float(y)))


def covered(x: float, y: float, width: float, height: float, boxes: np.ndarray, lines: np.ndarray) -> int:
    """Twice the boxes (x, y, width, height) that a label overlaps, and the axis-parallel lines (x1, y1, x2, y2) through it."""
    b = (x < boxes[:, 0] + boxes[:, 2]) & (boxes[:, 0] < x + width) & (y < boxes[:, 1] + boxes[:, 3]) & (boxes[:, 1] < y + height)
    s = (lines[:, 0] < x + width) & (x < lines[:, 2]) & (lines[:, 1] < y + height) & (y < lines[:, 3])
    return int(2 * b.sum() + s.sum())


def placed_end_labels(labels: DataFrame, routes: DataFrame, nodes: DataFrame, spacing: float = 4.0) -> DataFrame:
    """(graph_id, edge_id, end, x, y, width, height, covers) of ``labels`` (without covers, ``end`` HEAD or TAIL) after those
    that cover something have moved.  Labels of no size, and those without a route, stay."""
    schema = "graph_id string, edge_id string, end string, x double, y double, width double, height double, covers int"

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        (row,) = rows.itertuples(index=False)
        way = {r["edge_id"]: [(p["x"], p["y"]) for p in r["points"]] for r in row.routes if r["points"] is not None}
        own = sorted(row.labels, key=lambda r: (r["edge_id"], r["end"]))
        at = np.array([[r[c] for c in ("x", "y", "width", "height")] for r in own], float)
        fixed = np.array([[r[c] for c in ("x", "y", "width", "height")] for r in row.nodes], float).reshape(-1, 4)
        lines = np.array([(min(a[0], b[0]), min(a[1], b[1]), max(a[0], b[0]), max(a[1], b[1])) for p in way.values() for a, b in zip(p, p[1:], strict=False)], float).reshape(-1, 4)
        covers = []
        for i, r in enumerate(own):
            boxes = np.vstack([fixed, np.delete(at, i, 0)])
            x, y, w, h = (float(v) for v in at[i])
            best = (covered(x, y, w, h, boxes, lines) if w > 0 and h > 0 else 0, x, y)
            if best[0] and r["edge_id"] in way:
                points = way[r["edge_id"]]
                for sx, sy in spots(points[::-1] if r["end"] == "HEAD" else points, w, h, spacing):
                    if (n := covered(sx, sy, w, h, boxes, lines)) < best[0]:
                        best = (n, sx, sy)
                    if not n:
                        break
            at[i, :2] = best[1:]
            covers.append(best[0])
        return pd.DataFrame([(row.graph_id, r["edge_id"], r["end"], *map(float, at[i]), covers[i]) for i, r in enumerate(own)], columns=[c.split()[0] for c in schema.split(", ")])

    packed = labels.groupBy("graph_id").agg(F.collect_list(F.struct("edge_id", "end", "x", "y", "width", "height")).alias("labels"))
    packed = packed.join(routes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("edge_id", "points"))).alias("routes")), "graph_id").join(nodes.groupBy("graph_id").agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("nodes")), "graph_id")
    return packed.groupBy("graph_id").applyInPandas(kernel, schema)

"""Routes kept by a stream of graph changes: per graph its boxes, edges and routes are state, and a change redraws what it affects.

Changes come in revisions; a revision is applied as a whole, in order, and one that isn't newer than the state is stale: it comes
out marked and changes nothing.  Edges of changed nodes, and edges whose route comes near an old or new place of
one, are routed again by priority, then by id: each sees the routes that stay and those drawn before it, and takes the way that
runs into fewest boxes, shares least length and crosses fewest with them, then bends least and is shortest.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: op: ``node`` and ``edge`` add or change one, ``drop_node`` and ``drop_edge`` take one away.
DIFFS = "graph_id string, revision long, op string, id string, source_id string, target_id string, priority int, x double, y double, width double, height double"
CHANGES = "graph_id string, revision long, op string, edge_id string, points array<struct<x:double,y:double>>"
Point = tuple[float, float]
Box = tuple[float, float, float, float]


def ways(a: Box, b: Box) -> list[list[Point]]:
    """Orthogonal ways between the middles of two boxes: with two bends at quarters between them, or past either box."""
    (ax, ay), (bx, by) = ((x + w / 2, y + h / 2) for x, y, w, h in (a, b))
    found = []
    across = [(ax + (bx - ax) * q / 4) for q in (2, 1, 3)] + [min(a[0], b[0]) - 10, max(a[0] + a[2], b[0] + b[2]) + 10]
    along = [(ay + (by - ay) * q / 4) for q in (2, 1, 3)] + [min(a[1], b[1]) - 10, max(a[1] + a[3], b[1] + b[3]) + 10]
    for m in across:
        found.append([(ax, ay), (m, ay), (m, by), (bx, by)])
    for m in along:
        found.append([(ax, ay), (ax, m), (bx, m), (bx, by)])
    return [[p for i, p in enumerate(w) if i == 0 or p != w[i - 1]] for w in found]


def _segments(points: list[Point]) -> list[tuple[float, float, float, float]]:
    return [(min(p[0], q[0]), min(p[1], q[1]), max(p[0], q[0]), max(p[1], q[1])) for p, q in zip(points, points[1:], strict=False)]


def cost(points: list[Point], boxes: list[Box], reserved: list[tuple[float, float, float, float]]) -> tuple[int, float, int, int, float]:
    """(boxes run into, length shared, crossings, bends, length): ``reserved`` are segments of other routes."""
    own = _segments(points)
    hits = sum(any(x1 < b[0] + b[2] and b[0] < x2 and y1 < b[1] + b[3] and b[1] < y2 for x1, y1, x2, y2 in own) for b in boxes)
    shared, crossed = 0.0, 0
    for x1, y1, x2, y2 in own:
        for u1, v1, u2, v2 in reserved:
            if x1 == x2 == u1 == u2:
                shared += max(0.0, min(y2, v2) - max(y1, v1))
            elif y1 == y2 == v1 == v2:
                shared += max(0.0, min(x2, u2) - max(x1, u1))
            elif x1 < u2 and u1 < x2 and v1 < y2 and y1 < v2:  # strictly inside each other, so one is upright
                crossed += 1
    return hits, shared, crossed, len(points) - 2, sum(x2 - x1 + y2 - y1 for x1, y1, x2, y2 in own)


def route(edge: str, graph: dict) -> list[Point] | None:
    """The best way for an edge among the graph's boxes and other routes; None without both ends."""
    s, t, _ = graph["edges"][edge]
    if s not in graph["nodes"] or t not in graph["nodes"] or s == t:
        return None
    boxes = [tuple(b) for n, b in graph["nodes"].items() if n not in (s, t)]
    reserved = [x for e, p in graph["routes"].items() if e != edge for x in _segments([tuple(q) for q in p])]
    return min(ways(graph["nodes"][s], graph["nodes"][t]), key=lambda w: cost(w, boxes, reserved))


def applied(graph: dict, diffs: list[dict], clearance: float = 8.0) -> list[tuple[str, str, list[Point] | None]]:
    """One revision's changes, done to ``graph``: (op, edge, points) for each route that is new, other or gone."""
    places: list[Box] = []
    changed, redrawn = set(), set()
    for d in sorted(diffs, key=lambda d: (d["op"].endswith("edge"), d["op"], d["id"])):
        if d["op"] in ("node", "drop_node"):
            old = graph["nodes"].pop(d["id"], None)
            new = None if d["op"] == "drop_node" else [d["x"], d["y"], d["width"], d["height"]]
            if new is not None:
                graph["nodes"][d["id"]] = new
            if old != new:
                changed.add(d["id"])
                places += [tuple(b) for b in (old, new) if b is not None]
        elif d["op"] == "edge":
            graph["edges"][d["id"]] = [d["source_id"], d["target_id"], int(d["priority"] or 0)]
            redrawn.add(d["id"])
        else:
            graph["edges"].pop(d["id"], None)
            redrawn.add(d["id"])
    near = [(x - clearance, y - clearance, x + w + clearance, y + h + clearance) for x, y, w, h in places]
    for e, (s, t, _) in graph["edges"].items():
        if s in changed or t in changed:
            redrawn.add(e)
        elif e in graph["routes"] and any(x1 <= c and a <= x2 and y1 <= d and b <= y2 for x1, y1, x2, y2 in _segments([tuple(p) for p in graph["routes"][e]]) for a, b, c, d in near):
            redrawn.add(e)
    before = {e: graph["routes"].pop(e, None) for e in redrawn}
    out = []
    for e in sorted(redrawn, key=lambda e: (-graph["edges"].get(e, ("", "", 0))[2], e)):
        points = route(e, graph) if e in graph["edges"] else None
        if points is not None:
            graph["routes"][e] = [list(p) for p in points]
        was = before[e]
        if (was is None) != (points is None) or (was is not None and [tuple(p) for p in was] != points):
            out.append(("remove" if points is None else "add" if was is None else "update", e, points))
    return out


def route_changes(diffs: DataFrame, idle: timedelta | None = None) -> DataFrame:
    """Streaming ``DIFFS`` -> ``CHANGES``, append mode.  ``idle``: a graph without changes for so long is forgotten."""
    names = [c.split()[0] for c in CHANGES.split(", ", 4)]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        revision, text = state.get if state.exists else (-1, None)
        graph = json.loads(text) if text else {"nodes": {}, "edges": {}, "routes": {}}
        rows, out = pd.concat(list(batches)), []
        for number, part in rows.groupby("revision", sort=True):
            number = int(number)
            if number <= revision:
                out.append((key[0], number, "stale", None, None))
                continue
            revision = number
            out += [(key[0], number, op, e, None if p is None else [{"x": float(x), "y": float(y)} for x, y in p]) for op, e, p in applied(graph, part.astype(object).where(part.notna(), None).to_dict("records"))]
        state.update((revision, json.dumps(graph)))
        if idle:
            state.setTimeoutDuration(idle // timedelta(milliseconds=1))
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return diffs.groupBy("graph_id").applyInPandasWithState(step, CHANGES, "revision long, graph string", "append", timeout)


def latest_routes(changes: DataFrame) -> DataFrame:
    """(graph_id, edge_id, revision, points) as of the last revision."""
    last = changes.where("op <> 'stale'").groupBy("graph_id", "edge_id").agg(F.max_by(F.struct("op", "revision", "points"), "revision").alias("c"))
    return last.where("c.op <> 'remove'").select("graph_id", "edge_id", F.col("c.revision").alias("revision"), F.col("c.points").alias("points"))

"""Places across the layers of least total weighted height between the ends of all edges.

Every edge becomes a helper that lies above both its ends, every two neighbours of a layer an arc of no weight as long as they need;
least total weight times length of that graph is the drawing wanted (Gansner and others, 1993).  Pieces of long edges weigh more, so
they come out straight.  The graph is solved by a network simplex of its own, for its spans are lengths and may be negative: a
tree arc's cut value is the sum, over the subtree below it, of what nodes send less what they get.  A graph is one group of a task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Arc = tuple[int, int, float, float]  # from, to, weight, least span
EPS = 1e-9
#: Weight of an edge piece by how many of its ends are dummies.
STRAIGHTER = (1, 2, 8)


def least_lengths(n: int, arcs: list[Arc]) -> list[float]:
    """Places, from 0 in each component, of least total weight times length; ``arcs`` form no cycle."""
    at, outs, missing = [0.0] * n, [[] for _ in range(n)], [0] * n
    beside: list[list[int]] = [[] for _ in range(n)]
    for k, (s, t, _, _) in enumerate(arcs):
        outs[s].append(k)
        missing[t] += 1
        beside[s].append(k)
        beside[t].append(k)
    ready, walked = [a for a in range(n) if not missing[a]], 0
    while ready:
        a = ready.pop()
        walked += 1
        for k in outs[a]:
            t = arcs[k][1]
            at[t] = max(at[t], at[a] + arcs[k][3])
            missing[t] -= 1
            if not missing[t]:
                ready.append(t)
    if walked < n:
        raise ValueError("arcs form a cycle")
    balance = [0.0] * n
    for s, t, w, _ in arcs:
        balance[s] += w
        balance[t] -= w
    slack = lambda k: at[arcs[k][1]] - at[arcs[k][0]] - arcs[k][3]
    left = set(range(n))
    while left:
        root = min(left)
        tree, inside = [], {root}
        todo = [root]
        while True:  # tight arcs first, then the part inside moves up to the nearest node outside
            while todo:
                a = todo.pop()
                for k in beside[a]:
                    b = arcs[k][1] if arcs[k][0] == a else arcs[k][0]
                    if b not in inside and slack(k) <= EPS:
                        tree.append(k)
                        inside.add(b)
                        todo.append(b)
            across = [(slack(k), k) for a in inside for k in beside[a] if (arcs[k][0] in inside) != (arcs[k][1] in inside)]
            if not across:
                break
            by, k = min(across)
            for a in inside:
                at[a] += by if arcs[k][0] in inside else -by
            todo = list(inside)
        own = sorted({k for a in inside for k in beside[a]})
        _pivot(root, len(inside), tree, own, arcs, at, balance)
        low = min(at[a] for a in inside)
        for a in inside:
            at[a] -= low
        left -= inside
    return at


def _pivot(root: int, size: int, tree: list[int], own: list[int], arcs: list[Arc], at: list[float], balance: list[float]) -> None:
    """Swap tree arcs until no cut value is negative.  The most negative goes first; after many swaps the first of the negative ones, by
    Bland's rule, which can't go round in circles."""
    swaps = 0
    while True:
        near: dict[int, list[int]] = {}
        for k in tree:
            near.setdefault(arcs[k][0], []).append(k)
            near.setdefault(arcs[k][1], []).append(k)
        order, up, todo = [], {root: -1}, [root]
        while todo:
            a = todo.pop()
            order.append(a)
            for k in near.get(a, ()):
                b = arcs[k][1] if arcs[k][0] == a else arcs[k][0]
                if b not in up:
                    up[b] = k
                    todo.append(b)
        total, count = {a: balance[a] for a in order}, dict.fromkeys(order, 1)
        for a in reversed(order[1:]):
            s, t = arcs[up[a]][:2]
            above = t if s == a else s
            total[above] += total[a]
            count[above] += count[a]
        cuts = [(total[a] if arcs[up[a]][0] == a else -total[a], up[a], a) for a in order[1:]]
        cuts = [c for c in cuts if c[0] < -EPS]
        if not cuts:
            return
        _, leave, child = min(cuts) if swaps < 20 * size else min(cuts, key=lambda c: c[1])
        first = order.index(child)
        below = set(order[first : first + count[child]])  # a subtree is a run of the walk
        tail = (lambda a: a in below) if arcs[leave][0] == child else (lambda a: a not in below)
        by, enter = min((at[arcs[k][1]] - at[arcs[k][0]] - arcs[k][3], k) for k in own if not tail(arcs[k][0]) and tail(arcs[k][1]))
        for a in order:
            if tail(a):
                at[a] -= by
        tree[tree.index(leave)] = enter
        swaps += 1


def placed_rows(rows: list[list[int]], edges: list[tuple[int, int, float]], size: list[float], gap: float, dummies: frozenset[int] = frozenset()) -> list[float]:
    """Upper ends of the members of all layers, from 0 in what is connected; ``edges`` join the middles of members of neighbouring layers."""
    n, arcs = len(size), []
    for row in rows:
        arcs += [(a, b, 0.0, size[a] + gap) for a, b in zip(row, row[1:])]
    for i, (s, t, w) in enumerate(edges):
        weight = w * STRAIGHTER[(s in dummies) + (t in dummies)]
        arcs += [(n + i, s, weight, -size[s] / 2), (n + i, t, weight, -size[t] / 2)]
    return least_lengths(n + len(edges), arcs)[:n]


def simplex_places(nodes: DataFrame, order: DataFrame, segments: DataFrame, node_gap: float = 20.0, padding: float = 12.0) -> DataFrame:
    """(graph_id, node_id, y) of nodes and dummies of ordered layers; a dummy is a node of a segment's inner end.

    ``segments`` may have a ``weight`` (1 where it is missing or null, or below 1).  The highest member of a graph stands at ``padding``.
    """
    weight = F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)) if "weight" in segments.columns else F.lit(1)
    members = order.join(nodes.select("graph_id", "node_id", "height"), ["graph_id", "node_id"])
    links = segments.select("graph_id", "from_id", "to_id", weight.cast("double").alias("weight"))

    def kernel(member: pd.DataFrame, link: pd.DataFrame) -> pd.DataFrame:
        if not len(member):
            return pd.DataFrame([], columns=["graph_id", "node_id", "y"])
        member = member.sort_values(["layer", "pos"]).reset_index(drop=True)
        number = {n: i for i, n in enumerate(member["node_id"])}
        rows = [list(g.index) for _, g in member.groupby("layer")]
        pieces = sorted((number[s], number[t], w) for s, t, w in zip(link["from_id"], link["to_id"], link["weight"], strict=True) if s in number and t in number)
        dummies = frozenset(i for n, i in number.items() if n.startswith("__dummy:"))
        y = placed_rows(rows, pieces, [float(h) for h in member["height"]], node_gap, dummies)
        low = min(y)
        return pd.DataFrame({"graph_id": member["graph_id"], "node_id": member["node_id"], "y": [v - low + padding for v in y]})

    return members.groupBy("graph_id").cogroup(links.groupBy("graph_id")).applyInPandas(kernel, "graph_id string, node_id string, y double")

"""More per-graph kernels: cycle breaking by breadth and by components, width-bound layers, promotion, aligned placement.

Same conventions as ``kernels``: nodes are numbers in authored order, edges (source, target, weight).
"""

from __future__ import annotations

from .kernels import Edges


def reach(n: int, edges: Edges) -> list[int]:
    """Per node a bit set of the nodes that a path leads to (by repeated union until nothing changes)."""
    out = [0] * n
    for s, t, _ in edges:
        out[s] |= 1 << t
    changed = True
    while changed:
        changed = False
        for s, t, _ in edges:
            if (more := out[s] | out[t]) != out[s]:
                out[s], changed = more, True
    return out


def bfs_orientation(n: int, edges: Edges) -> list[bool]:
    """Edges against the order in which a breadth-first search meets the nodes are reversed."""
    near = [[] for _ in range(n)]
    for s, t, _ in edges:
        near[s].append(t)
    met: dict[int, int] = {}
    for root in range(n):
        todo = [] if root in met else [root]
        for a in todo:
            if a not in met:
                met[a] = len(met)
                todo += sorted(b for b in near[a] if b not in met)
    return [met[s] > met[t] for s, t, _ in edges]


def scc_orientation(n: int, edges: Edges) -> list[bool]:
    """While a strongly connected component has two nodes, the edges into its first node are reversed."""
    back = [False] * len(edges)
    while True:
        flow = [(t, s, w) if r else (s, t, w) for (s, t, w), r in zip(edges, back, strict=True)]
        far = reach(n, [e for e in flow if e[0] != e[1]])
        own = [{a} | {b for b in range(n) if far[a] >> b & 1 and far[b] >> a & 1} for a in range(n)]
        heads = {min(c) for c in own if len(c) > 1}
        if not heads:
            return back
        for k, (s, t, _) in enumerate(flow):
            if t in heads and s != t and s in own[t]:
                back[k] = not back[k]


def _bottom_up(n: int, edges: Edges, width: list[float], most: float, slack: float) -> list[int]:
    """Layers from the sinks; a layer is closed at ``most`` width, unless what stays open above it is within slack."""
    outs, layer, k, held, done = [set() for _ in range(n)], [-1] * n, 0, 0.0, set()
    for s, t, _ in edges:
        outs[s].add(t)
    while len(done) < n:
        ready = [a for a in range(n) if layer[a] < 0 and all(-1 < layer[b] < k for b in outs[a])]
        fit = [a for a in ready if not held or held + width[a] <= most * slack]
        if not fit:
            k, held = k + 1, 0.0
            continue
        a = max(fit, key=lambda a: (len(outs[a]), -a))
        layer[a], held = k, held + width[a]
        done.add(a)
    last = max(layer, default=0)
    return [last - x for x in layer]


def min_width(n: int, edges: Edges, width: list[float]) -> list[int]:
    """The narrowest of several greedy layerings; of equals the one with fewest layers."""
    mean = sum(width) / max(1, n)
    tried = [_bottom_up(n, edges, width, mean * upper, slack) for upper in (1, 2, 3, 4) for slack in (1, 2)]
    widest = lambda l: max((sum(w for w, x in zip(width, l, strict=True) if x == k) for k in set(l)), default=0)
    return min(tried, key=lambda l: (widest(l), max(l, default=0)))


def stretch_width(n: int, edges: Edges, width: list[float]) -> list[int]:
    """Greedy layers of a bound that grows from the widest node until there are no more layers than a path needs."""
    from .kernels import longest_path

    need, bound = max(longest_path(n, edges), default=0), max(width, default=1.0)
    while True:
        got = _bottom_up(n, edges, width, bound, 1.0)
        if max(got, default=0) <= 2 * need or bound >= sum(width):
            return got
        bound *= 1.25


def promote(layer: list[int], edges: Edges) -> list[int]:
    """Nodes (with what stands in their way) move a layer up while the summed span of the edges falls."""
    layer = layer[:]
    ins = {}
    for s, t, w in edges:
        ins.setdefault(t, []).append(s)
    cost = lambda l: sum(w * (l[t] - l[s]) for s, t, w in edges)
    better = True
    while better:
        better = False
        for a in range(len(layer)):
            tried, todo = layer[:], [a]
            while todo:
                b = todo.pop()
                tried[b] -= 1
                todo += [s for s in ins.get(b, ()) if tried[s] >= tried[b]]
            if min(tried) >= 0 and cost(tried) < cost(layer):
                layer, better = tried, True
    return layer


def aligned_placement(rows: list[list[int]], edges: Edges, size: list[float], gap: float, inner: frozenset[int] = frozenset()) -> list[float]:
    """Centres across the layers by aligning nodes with their median neighbours (Brandes and Köpf, 2001): four
    alignments (down or up, left or right), each compacted by longest paths between blocks, then the mean of the two
    middle ones.  Edges between two nodes of ``inner`` (stand-ins of long edges) win conflicts with others."""
    total, drawn = sum(map(len, rows)), []
    for up in (False, True):
        for right in (False, True):
            order = [r[::-1] if right else r for r in (rows[::-1] if up else rows)]
            place = {a: (k, i) for k, r in enumerate(order) for i, a in enumerate(r)}
            links = [(a, b) if place[a][0] < place[b][0] else (b, a) for a, b, _ in edges if abs(place[a][0] - place[b][0]) == 1]
            strong = [(a, b) for a, b in links if a in inner and b in inner]
            cross = lambda e, f: (place[e[0]][1] - place[f[0]][1]) * (place[e[1]][1] - place[f[1]][1]) < 0 and place[e[0]][0] == place[f[0]][0]
            before = {}
            for e in links:
                if e in strong or not any(cross(e, f) for f in strong):
                    before.setdefault(e[1], []).append(e[0])
            root = {a: a for a in place}
            for k in range(1, len(order)):
                last = -1
                for b in order[k]:
                    near = sorted(before.get(b, ()), key=lambda a: place[a][1])
                    for m in dict.fromkeys(((len(near) - 1) // 2, len(near) // 2)) if near else ():
                        if place[near[m]][1] > last:
                            root[b], last = root[near[m]], place[near[m]][1]
                            break
            steps = [(root[a], root[b], (size[a] + size[b]) / 2 + gap) for r in order for a, b in zip(r, r[1:])]
            x = dict.fromkeys(root.values(), 0.0)
            for _ in range(len(x)):
                moved = False
                for a, b, far in steps:
                    if x[a] + far > x[b]:
                        x[b], moved = x[a] + far, True
                if not moved:
                    break
            drawn.append([(-1 if right else 1) * x[root[a]] for a in range(total)])
    if not total:
        return []
    narrow = min(drawn, key=lambda l: max(l) - min(l))
    shifted = []
    for k, l in enumerate(drawn):
        by = max(narrow) - max(l) if k % 2 else min(narrow) - min(l)
        shifted.append([v + by for v in l])
    return [sum(sorted(v)[1:3]) / 2 for v in zip(*shifted, strict=True)]

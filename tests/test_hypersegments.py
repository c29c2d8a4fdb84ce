"""Routes through gaps: trunks apart, branches apart, few crossings, every edge from its source to its target."""

import itertools
import random
from collections import defaultdict

import pytest
from strata.operators import graph as G
from strata.operators import hypersegments as H

import __spark_entry__  # noqa: F401  (registers the queries)
from strata.plans import catalog

SF = "/root/testdata/sf0.01"


def some_trunks(rng, n, heights):
    found = []
    while len(found) < n:
        ins, outs = (sorted(rng.sample(range(heights), rng.randrange(1, 4))) for _ in range(2))
        if len(set(ins + outs)) > 1:
            found.append(([float(y) for y in ins], [float(y) for y in outs]))
    # ports belong to one trunk: a left height and a right height occur once
    seen, out = (set(), set()), []
    for t in found:
        t = tuple([y for y in side if y not in s] for side, s in zip(t, seen, strict=True))
        for side, s in zip(t, seen, strict=True):
            s.update(side)
        if t[0] and t[1] and len(set(t[0] + t[1])) > 1:
            out.append(t)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_slots_keep_lines_apart(seed):
    rng = random.Random(seed)
    given = some_trunks(rng, rng.randrange(1, 8), rng.choice([6, 12, 40]))
    slot, splits = H.arranged(given)
    lines = list(given)
    for a, (b, y) in splits.items():
        assert b == len(lines)
        lines.append(([y], given[a][1]))
        lines[a] = (given[a][0], [y])
    assert len(slot) == len(lines)
    for a, b in itertools.permutations(range(len(lines)), 2):
        ea, eb = H._extent(lines[a]), H._extent(lines[b])
        if slot[a] == slot[b]:
            assert ea[1] < eb[0] or eb[1] < ea[0]
        if splits.get(a, (None,))[0] != b and set(lines[a][1]) & set(lines[b][0]):
            assert slot[b] < slot[a]  # the branch that comes in ends before the other begins
    assert all(slot[a] < slot[b] for a, (b, _) in splits.items())


@pytest.mark.parametrize("seed", range(40))
def test_crossings_against_all_orders(seed):
    rng = random.Random(seed)
    given = [([y * 2 for y in ins], [y * 2 + 1 for y in outs]) for ins, outs in some_trunks(rng, rng.randrange(2, 7), 1000)]
    slot, splits = H.arranged(given)
    assert not splits
    got = H.crossings(sorted(range(len(given)), key=slot.__getitem__), given)
    best = min(H.crossings(list(o), given) for o in itertools.permutations(range(len(given))))
    tracks = G.tracks([tuple(H._extent(t)) for t in given])
    assert best <= got <= H.crossings(sorted(range(len(given)), key=tracks.__getitem__), given) and got <= best + 1


def test_ring_is_opened_by_a_split():
    given = [([0.0], [10.0]), ([10.0], [0.0])]
    slot, splits = H.arranged(given)
    assert len(slot) == 3 and len(splits) == 1


def test_every_edge_of_the_trade_graphs(spark):
    rows = catalog.QUERIES["trade_routes"](spark, SF).collect()
    routes = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.k):
        routes[r.graph_id, r.edge_id].append((r.x, r.y))
    ends = defaultdict(list)
    for r in catalog.QUERIES["trade_gap_ends"](spark, SF).collect():
        ends[r.graph_id, r.edge_id].append(r)
    assert routes.keys() == ends.keys()
    for key, p in routes.items():
        e = sorted(ends[key], key=lambda r: r.segment)
        assert p[0] == (e[0].x1, e[0].y1) and p[-1] == (e[-1].x2, e[-1].y2)
        for a, b in itertools.pairwise(p):
            assert (a[0] == b[0]) != (a[1] == b[1]) and a[0] <= b[0]
    trunks = defaultdict(list)  # vertical lines by graph and x: those of different sources never touch
    for (g, e), p in routes.items():
        first = {round(r.y1, 6): r.from_id for r in ends[g, e]}
        for a, b in itertools.pairwise(p):
            if a[0] == b[0]:
                trunks[g, a[0]].append((min(a[1], b[1]), max(a[1], b[1]), first[a[1]]))
    for spans in trunks.values():
        for a, b in itertools.combinations(spans, 2):
            assert a[2] == b[2] or a[1] < b[0] or b[1] < a[0]

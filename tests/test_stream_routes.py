"""Routes in a stream's state: revisions in order, stale ones refused, only affected routes drawn anew, later ones see earlier ones."""

import itertools
import os
import random

import pytest
from strata.streaming import routes as R
from strata.streaming.edges import run_available


def node(revision, name, x, y, op="node"):
    return ("g", revision, op, name, None, None, None, float(x), float(y), 10.0, 10.0)


def edge(revision, name, s, t, priority=0, op="edge"):
    return ("g", revision, op, name, s, t, priority, None, None, None, None)


def streamed(spark, tmp_path, parts):
    for n, part in enumerate(parts):
        spark.createDataFrame(part, R.DIFFS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        (f,) = (tmp_path / "in" / str(n)).glob("*.parquet")
        os.makedirs(tmp_path / "flat", exist_ok=True)
        f.rename(tmp_path / "flat" / f"{n}.parquet")
        os.utime(tmp_path / "flat" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    source = spark.readStream.schema(R.DIFFS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")
    changes = run_available(spark, R.route_changes(source), f"file://{tmp_path}")
    return {r.edge_id: [(p.x, p.y) for p in r.points] for r in R.latest_routes(changes).collect()}, changes


FIRST = [node(1, f"n{k}", 40 * (k % 4), 40 * (k // 4)) for k in range(8)]
SECOND = [edge(2, f"e{a}{b}", f"n{a}", f"n{b}", a) for a, b in itertools.combinations(range(8), 2) if (a + b) % 3 == 0]
THIRD = [node(3, "n3", 300, 300), edge(3, "e03", None, None, op="drop_edge")]


@pytest.mark.parametrize("cut", [[FIRST + SECOND + THIRD], [FIRST, SECOND, THIRD]])
def test_batches_do_not_matter(spark, tmp_path, cut):
    graph = {"nodes": {}, "edges": {}, "routes": {}}
    names = [c.split()[0] for c in R.DIFFS.split(", ")]
    for part in (FIRST, SECOND, THIRD):
        R.applied(graph, [dict(zip(names, d, strict=True)) for d in part])
    got, _ = streamed(spark, tmp_path, cut)
    assert got == {e: [tuple(p) for p in w] for e, w in graph["routes"].items()}
    assert "e03" not in got and len(got) == len(SECOND) - 1


def test_stale_revisions_change_nothing(spark, tmp_path):
    got, changes = streamed(spark, tmp_path, [FIRST, SECOND, [node(2, "n0", 500, 500)], [node(1, "n9", 1, 1)]])
    assert [(r.revision, r.op) for r in changes.where("op = 'stale'").orderBy("revision").collect()] == [(1, "stale"), (2, "stale")]
    assert got["e03"][0] == (5.0, 5.0)


def test_later_edges_see_earlier_ones():
    graph = {"nodes": {n: [x, y, 10, 10] for n, x, y in (("a", 0, 0), ("b", 100, 100))}, "edges": {"low": ["a", "b", 0], "high": ["a", "b", 5]}, "routes": {}}
    out = R.applied(graph, [{"op": "node", "id": "c", "x": 500, "y": 0, "width": 1, "height": 1}, {"op": "edge", "id": "low", "source_id": "a", "target_id": "b", "priority": 0}, {"op": "edge", "id": "high", "source_id": "a", "target_id": "b", "priority": 5}])
    assert [e for _, e, _ in out] == ["high", "low"]
    alone = min(R.ways((0, 0, 10, 10), (100, 100, 10, 10)), key=lambda w: R.cost(w, [], []))
    assert out[0][2] == alone and out[1][2] != alone
    assert R.cost(out[1][2], [], R._segments(alone))[1] < R.cost(alone, [], R._segments(alone))[1]


def test_routes_far_from_a_change_stay():
    graph = {"nodes": {}, "edges": {}, "routes": {}}
    names = [c.split()[0] for c in R.DIFFS.split(", ")]
    for part in (FIRST, SECOND):
        R.applied(graph, [dict(zip(names, d, strict=True)) for d in part])
    before = {e: w[:] for e, w in graph["routes"].items()}
    out = R.applied(graph, [dict(zip(names, node(3, "n9", 900, 900), strict=True))])
    assert out == [] and graph["routes"] == before


@pytest.mark.parametrize("seed", range(20))
def test_costs_against_unit_cells(seed):
    """On whole coordinates lengths shared and crossings can be counted cell by cell."""
    rng = random.Random(seed)
    way = [(rng.randrange(9), rng.randrange(9))]
    for k in range(3):
        way.append((rng.randrange(9), way[-1][1]) if k % 2 else (way[-1][0], rng.randrange(9)))
    others = [(x, y, x + 4 * flat, y + 4 * (not flat)) for x, y, flat in ((rng.randrange(9), rng.randrange(9), rng.random() < 0.5) for _ in range(5))]
    _, shared, crossed, _, _ = R.cost(way, [], others)
    cells = lambda s: {(x, y, s[0] != s[2]) for x in range(s[0], max(s[0] + 1, s[2])) for y in range(s[1], max(s[1] + 1, s[3]))} if s[:2] != s[2:] else set()
    assert shared == sum(len(cells(a) & cells(b)) for a in R._segments(way) for b in others)
    inner = lambda s: {(x, y) for x in range(s[0] + (s[0] != s[2]), s[2] + (s[0] == s[2])) for y in range(s[1] + (s[1] != s[3]), s[3] + (s[1] == s[3]))} if s[:2] != s[2:] else set()
    assert crossed == sum(len(inner(a) & inner(b)) for a in R._segments(way) for b in others if (a[0] == a[2]) != (b[0] == b[2]))

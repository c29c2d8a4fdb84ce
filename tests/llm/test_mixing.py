"""Targets and taken words against a plain recount."""

import random

import pytest
from strata.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """source -> target, by resharing the excess until none is above its bound."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return target | share
        target |= {s: most * sizes[s] for s in above}


def by_source(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix_to_targets(d).collect()}
    assert len(got) == len(rows)
    per = {}
    for i, text, source in rows:
        r = got[i]
        assert r.size == len((text or "").split()) and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        n, taken, _, _ = per.get(source, (0, 0, 0, 0))
        per[source] = (n + r.size, taken + r.taken, r.target, r.source_size)
    return per


@pytest.mark.parametrize("seed", [1, 2])
def test_few_long_documents_come_near_their_targets(spark, seed):
    rnd = random.Random(seed)
    names = [f"s{i:02}" for i in range(14)] + [None, "", "é", "Z"]
    rows = [(i, rnd.choice([None, "", "w " * rnd.choice([1, 5, 30, 400, 3000])]) if rnd.random() < 0.1 else "w " * int(rnd.lognormvariate(4, 1.5)), rnd.choice(names) if i % 3 else "s05") for i in range(700)]
    per = by_source(spark, rows)
    want = brute_targets({s: v[0] for s, v in per.items()})
    for s, (n, taken, target, source_size) in per.items():
        assert source_size == n and target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        smallest = min(len((t or "").split()) for _, t, x in rows if x == s and (t or "").split())
        assert abs(taken - target) <= max(0.05 * target, smallest, 3), (s, n, taken, target)


def test_ties_and_whole_repeated_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "a b c", "y"), (3, None, "y"), (4, "", None)]
    got = mixing.mix_to_targets(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.count() == 5 and all(r.taken == 0 for r in got.where("size = 0").collect())
    assert {(r.source_size, r.target) for r in got.collect()} == {(6, 3.0), (3, 6.0), (0, 0.0)}
    assert mixing.mix_to_targets(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0

"""A stream whose files come in any order ends where the batch does."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from strata.streaming import edges as stream

SCHEMA = "user_id long, ts timestamp, event_id long, event_type string"
BEGIN = datetime(2024, 1, 1)


def rows(user, kinds):
    return [(user, BEGIN + timedelta(minutes=k), k, kind) for k, kind in enumerate(kinds)]


def streamed(spark, tmp_path, parts, **how):
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")
    for n in range(len(parts)):  # one folder a trigger, in this order
        for f in (tmp_path / "in" / f"part={n}").glob("*.parquet"):
            target = tmp_path / "flat" / f"{n}.parquet"
            target.parent.mkdir(exist_ok=True)
            f.rename(target)
            import os

            os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")
    changes = stream.run_available(spark, stream.edge_changes(source, **how), f"file://{tmp_path}")
    return {(r.graph_id, r.edge_id): r.weight for r in stream.latest(changes).collect()}, changes


def batch(*users):
    found = Counter()
    for user, kinds in users:
        found.update((str(user), f"{a}>{b}") for a, b in zip(kinds, kinds[1:], strict=False))
    return dict(found)


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_two_files(spark, tmp_path, order):
    all_rows = rows(1, "abcabc")
    halves = [all_rows[:3], all_rows[3:]]
    got, changes = streamed(spark, tmp_path, [halves[k] for k in order])
    assert got == batch((1, "abcabc")) == {("1", "a>b"): 2, ("1", "b>c"): 2, ("1", "c>a"): 1}
    assert changes.where("late").count() == 0


def test_events_between_and_repeated_ones(spark, tmp_path):
    kinds, others = "abbacabbcc", "xyx"
    every = rows(7, kinds) + rows(8, others)
    got, changes = streamed(spark, tmp_path, [every[::2], every[1::2], every[:1]])
    assert got == batch((7, kinds), (8, others))
    assert [r.source_id for r in changes.where("late").collect()] == ["a"]


def test_too_late_is_marked(spark, tmp_path):
    every = rows(1, "abcdef")
    got, changes = streamed(spark, tmp_path, [every[:1] + every[2:], every[1:2]], delay=timedelta(minutes=2))
    assert got == {("1", e): 1 for e in ("a>c", "c>d", "d>e", "e>f")}
    assert [r.source_id for r in changes.where("late").collect()] == ["b"]

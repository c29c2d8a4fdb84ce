"""Incremental graph state: a stream of events keeps, per graph, its recent events and the edges' weights.

State is keyed by graph, so an update touches one graph; what changed comes out as rows with a revision, and the
latest revision of an edge is its weight (``latest``).  An event that comes late is put in its place among the recent ones: the
edge it parts loses one, the two it makes gain one.  Events are recent for ``delay`` before the newest of their graph;
older ones, and repeated ones, come out marked and change nothing.  So a stream that is late by no more than that ends where
the batch does, in whatever order its files come.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "graph_id string, edge_id string, source_id string, target_id string, weight long, revision long, late boolean"
STATE = "base_ts long, base_id long, base string, ts array<long>, ids array<long>, kinds array<string>, revision long, names array<string>, weights array<long>"


def edge_changes(events: DataFrame, delay: timedelta = timedelta(days=7), idle: timedelta | None = None) -> DataFrame:
    """Streaming (user_id, ts, event_id, event_type) -> rows of ``CHANGES``, append mode.

    ``idle``: a graph without events for so long (of processing time) is forgotten; its next event begins a new one.
    """
    span = delay // timedelta(microseconds=1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, number, before, ts, ids, kinds, revision, names, weights = state.get if state.exists else (None, -1, None, [], [], [], 0, [], [])
        recent, kinds = [(int(t), int(i)) for t, i in zip(ts, ids, strict=True)], list(kinds)
        now, changed, late = dict(zip(names, weights, strict=True)), {}, []

        def count(s: str | None, t: str | None, by: int) -> None:
            if s is not None and t is not None:
                now[f"{s}>{t}"] = now.get(f"{s}>{t}", 0) + by
                changed[f"{s}>{t}"] = (s, t)

        rows = pd.concat(list(batches)).sort_values(["micros", "event_id"])
        for at, event, kind in zip(rows["micros"], rows["event_id"], rows["event_type"], strict=True):
            k = bisect_left(recent, (at, event))
            if (first is not None and (at, event) <= (first, number)) or (k < len(recent) and recent[k] == (at, event)):
                late.append(kind)
                continue
            left, right = kinds[k - 1] if k else before, kinds[k] if k < len(kinds) else None
            count(left, right, -1)
            count(left, kind, 1)
            count(kind, right, 1)
            recent.insert(k, (int(at), int(event)))
            kinds.insert(k, kind)
        if recent and (gone := bisect_left(recent, (recent[-1][0] - span, -1))):
            (first, number), before = recent[gone - 1], kinds[gone - 1]
            recent, kinds = recent[gone:], kinds[gone:]
        now = {e: w for e, w in now.items() if w or e in changed}
        revision += 1
        state.update((first, number, before, [t for t, _ in recent], [i for _, i in recent], kinds, revision, [e for e, w in now.items() if w], [w for w in now.values() if w]))
        if idle:
            state.setTimeoutDuration(idle // timedelta(milliseconds=1))
        out = [(str(key[0]), e, s, t, now[e], revision, False) for e, (s, t) in changed.items()]
        out += [(str(key[0]), None, kind, None, None, revision, True) for kind in late]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({"weight": "Int64"})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    rows = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, CHANGES, STATE, "append", timeout)


def latest(changes: DataFrame) -> DataFrame:
    """The edges as of the last revision; those that late events parted for good are gone."""
    return changes.where("not late").groupBy("graph_id", "edge_id").agg(F.max_by("weight", "revision").alias("weight")).where("weight > 0")


def run_available(spark: SparkSession, changes: DataFrame, folder: str) -> DataFrame:
    """Drain what the source has into Parquet under ``folder``, with its own checkpoint, and read it back."""
    base = f"{folder.rstrip('/')}/strata-stream-{uuid.uuid4().hex[:12]}"
    done = changes.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{base}/rows")

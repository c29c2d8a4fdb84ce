"""Conversation repair against a plain search over audits, and its pieces against the whole."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from strata.llm import conversations as C

NAMES = {"u": "user", "a": "assistant"}
EMPTY = hashlib.sha256(b"").hexdigest()


def least_repair(rows):
    """(cost, audit, lines) by a search that takes the cheapest, then least audit first; rows: (fault, role, text)."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        following = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, following, (*lines, NAMES[following] + ":")))
        if i < len(rows):
            fault, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                if state in {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}.get(role[:1], ()):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, following, (*lines, f"{NAMES[following]}:{text}")))


def plain(rows, damage=True):
    spaced = lambda v: " " if v is None else str(v)
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        talks[c]
        fault, role, text = zlib.crc32(f"{spaced(c)}:{spaced(turn)}".encode()) % 20 if damage else 9, spaced(role), spaced(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        talks[c] += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = {}
    for c, talk in talks.items():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in talk:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((fault, role, text))
        turns = {t for t, _, _ in talk if t is not None}
        faults = [f for f, _, _ in marked]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, lines = least_repair(marked)
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(rows):
    audits, lines = C.repair(rows)
    digests = {r.c: r.repaired_sha256 for r in C.digests_of(lines).collect()}
    return {r.conv_id: (*tuple(r)[1:], digests.get(None if r.conv_id is None else str(r.conv_id), EMPTY)) for r in audits.collect()}


def some_rows(seed, n, ids):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "and so", " \t\n", "", "end. ", "x", "été", None, "tail.\x85"]
    rows = [(rng.choice(ids), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "Ünder", "ua"]), rng.choice(texts)) for _ in range(n)]
    return rows + rows[: n // 5]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in C.op11_repair_conversations(spark, sf).collect()} == plain(rows)


@pytest.mark.parametrize(("shift", "fan"), [(13, 1024), (1, 2)])
def test_pieces_nulls_ties_and_repeated_rows(spark, monkeypatch, shift, fan):
    monkeypatch.setattr(C, "_SHIFT", shift)
    monkeypatch.setattr(C, "_FAN", fan)
    rows = some_rows(shift, 150, [None, 1, 2, 3, (1 << 60) + 1, (1 << 60) + 2])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("k", F.lit("clash")).repartition(5)
    assert repaired(df) == plain(rows, damage=False)


def test_empty_table_and_conversations_that_vanish(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    assert repaired(spark.createDataFrame([], schema)) == {}
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:7".encode()) % 20 == 0)
    rows = [(gone, 7, "user", "Hello."), (None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in C.op11_repair_conversations(spark, str(tmp_path)).collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert got == plain(rows)


def test_one_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 3 == 1], f"line {t % 4000}" + ".!x"[t % 3]) for t in range(20_000)] + [(1, 20_001, "user", "word " * 200_000)]
    got = repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    assert got.keys() == {1} and len(got[1][6]) >= 20_001


@pytest.mark.parametrize("seed", range(30))
def test_distances_and_walk(seed):
    rng = random.Random(seed)
    rows = [rng.randrange(4) + 4 * rng.randrange(2) for _ in range(rng.randrange(9))]
    gone = [rng.randrange(3) for _ in range(len(rows) + 1)]
    marked = [("blank", "", "")] * gone[0]
    for row, more in zip(rows, gone[1:], strict=True):
        marked += [("truncated" if row & 4 else "", ("", "system", "user", "assistant")[row & 3], "x")] + [("blank", "", "")] * more
    cost, audit, _ = least_repair(marked)
    dist = C.distances(rows, C._END)
    assert dist[C.START] + 3 * sum(gone) == cost
    assert C.walk(rows, gone, dist, C.START, True)[0] == audit

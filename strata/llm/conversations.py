"""Conversation structure repair by shortest paths with small integer costs.

A conversation's rows, in order of turn, are repaired to ``(s?(ua)+)?``: an optional system line, then user and
assistant lines in turn.  A node of the graph is (rows read, last line written); keep, rerole, delete and insert are
its arcs, of cost 0 to 3.  Dial's bucket queue gives every node its distance to the end; the audit is the walk over
tight arcs that takes the least letter wherever two are tight.

Rows that must go (blank ones and repeats) leave the state as it is, and their letter D is the least, so they are
taken out of the graph and their letters put back first at their place.

A conversation may hold a third of all rows, so none is gathered whole.  Rows are put into one global order and cut
into pieces of at most 8192; a piece is a 4 x 4 matrix of distances (last line before, last line after), and matrices
are folded in groups of ``_FAN``, level by level, to the distances that remain behind each piece.  The walks of a piece
from each of the four states are a function of four values, folded likewise from the front.  Only the digest of the
repaired text reads a conversation in sequence, as SHA-256 does: its lines stream through, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, scratch, table

#: Last line written: none yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_NAMES = ("", "system", "user", "assistant")
_NEXT = (USER, USER, ASSISTANT, USER)  # what an inserted or reroled line can be
_BEFORE = ((), (START,), (START, SYSTEM, ASSISTANT), (USER,))  # states from which a line of that kind may follow
_END = (0, 4, 2, 0)  # distances behind the last row
_SHIFT = 13  # a piece has at most 2**13 rows
_FAN = 1024
_ROWS = 50_000  # rows that a task hands on at once
_BLANK = r"^[\x20\x09-\x0D]*$"
_OPEN_END = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$"


def distances(rows: list[int], after: Iterable[int | None]) -> list[int | None]:
    """Distance of every node ``4 * rows read + state`` to the end, by Dial's bucket queue.

    ``rows``: role (0 other, 1 system, 2 user, 3 assistant) + 4 if truncated.  ``after``: what remains behind the last
    row in each state, None where the end can't be reached.
    """
    n, after = len(rows), list(after)
    low = min(a for a in after if a is not None)
    buckets: list[list[int]] = [[] for _ in range(max(a for a in after if a is not None) - low + 3 * n + 5)]
    for s, a in enumerate(after):
        if a is not None:
            buckets[a - low].append(4 * n + s)
    dist: list[int | None] = [None] * (4 * n + 4)
    for d, bucket in enumerate(buckets):
        for node in bucket:  # grows while it is read: some arcs cost nothing
            if dist[node] is not None:
                continue
            dist[node] = d + low
            i, s = divmod(node, 4)
            if s >= USER:
                for p in _BEFORE[s]:
                    if dist[4 * i + p] is None:
                        buckets[d + 2].append(4 * i + p)
            if not i:
                continue
            if dist[node - 4] is None:
                buckets[d + 3].append(node - 4)
            role, open_end = rows[i - 1] & 3, rows[i - 1] >> 2
            if s != START and (role == s or s != SYSTEM):
                for p in _BEFORE[s]:
                    if dist[4 * i - 4 + p] is None:
                        buckets[d + open_end + 2 * (role != s)].append(4 * i - 4 + p)
    return dist


def walk(rows: list[int], gone: list[int], dist: list[int | None], state: int, last: bool) -> tuple[str, int]:
    """The least audit from ``state`` before the first row, and the state it ends in; ``gone[i]`` rows that must go lie
    before row ``i``.  Lines are inserted behind the last row only in a conversation's ``last`` piece."""
    n, i, out = len(rows), 0, ["D" * gone[0]]
    while i < n or (last and state in (SYSTEM, USER)):
        here = dist[4 * i + state]
        if i < n and dist[4 * i + 4 + state] is not None and here == dist[4 * i + 4 + state] + 3:
            letter, i = "D", i + 1
        elif dist[4 * i + _NEXT[state]] is not None and here == dist[4 * i + _NEXT[state]] + 2:
            out.append("I")
            state = _NEXT[state]
            continue
        else:
            role, open_end = rows[i] & 3, rows[i] >> 2
            kept = role != START and state in _BEFORE[role] and dist[4 * i + 4 + role] is not None and here == dist[4 * i + 4 + role] + open_end
            letter, i, state = ("K", i + 1, role) if kept else ("R", i + 1, _NEXT[state])
        out.append(letter)
        out.append("D" * gone[i])
    return "".join(out), state


def _graph(codes, copies) -> tuple[list[int], list[int]]:
    """Rows that may stay, and how many that must go lie before each of them and behind the last."""
    rows, gone = [], [0]
    for code, m in zip(codes, copies, strict=True):
        if code & 8:
            rows.append(int(code) & 7)
            gone.append(int(m) - 1)
        else:
            gone[-1] += int(m)
    return rows, gone


def _combined(a: list, b: list) -> list:
    """Product of two matrices of distances; None: no way."""
    out = []
    for i in range(4):
        for j in range(4):
            ways = [a[4 * i + k] + b[4 * k + j] for k in range(4) if a[4 * i + k] is not None and b[4 * k + j] is not None]
            out.append(min(ways) if ways else None)
    return out


def _remaining(m: list, after: list) -> list:
    return [min(m[4 * i + k] + after[k] for k in range(4) if m[4 * i + k] is not None) for i in range(4)]


def _listed(values) -> list:
    return [None if v is None or v != v else int(v) for v in values]


def _scan(elements: DataFrame, combine: Callable, act: Callable, seed: list[int], backward: bool) -> DataFrame:
    """``state`` (array<long>) at each of a conversation's ``elements`` (c, k from 0, e array<long>): what ``act`` makes
    of ``seed`` over all elements behind it (``backward``) or before it.

    Elements are folded in groups of ``_FAN`` until each conversation has one, then states are handed down again.
    """
    levels = [elements.select("c", "k", "e")]

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        e = _listed(group["e"].iloc[0])
        for other in group["e"].iloc[1:]:
            e = combine(e, _listed(other))
        return pd.DataFrame({"c": group["c"].iloc[:1], "k": [group["up"].iloc[0]], "e": [e]})

    def hand_down(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k", ascending=not backward)
        state, states = [int(x) for x in group["above"].iloc[0]], []
        for e in group["e"]:
            states.append(state)
            state = act(_listed(e), state)
        return pd.DataFrame({"c": group["c"], "k": group["k"], "e": group["e"], "state": states})

    while not levels[-1].where("k > 0").isEmpty():
        up = levels[-1].withColumn("up", F.floor(F.col("k") / _FAN)).groupBy("c", "up").applyInPandas(fold, "c string, k long, e array<long>")
        levels.append(cut(up, "level"))
    states = levels.pop().select("c", "k", F.array(*[F.lit(s).cast("long") for s in seed]).alias("state"))
    while levels:
        below = levels.pop().withColumn("up", F.floor(F.col("k") / _FAN))
        joined = _joined(below, states.select("c", F.col("k").alias("up"), F.col("state").alias("above")), "c", "up")
        states = cut(joined.groupBy("c", "up").applyInPandas(hand_down, "c string, k long, e array<long>, state array<long>").select("c", "k", "state"), "states")
    return states


def _mapped(frame: DataFrame, each: Callable, schema: str) -> DataFrame:
    """``each(row)`` gives rows of ``schema``; a piece's rows at a time, and no more than ``_ROWS`` beside them."""
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                found += each(row)
                if len(found) >= _ROWS:
                    yield pd.DataFrame(found, columns=names)
                    found = []
            yield pd.DataFrame(found, columns=names)

    return frame.mapInPandas(run, schema)


def _joined(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """A join on ``names`` that takes nulls as equal; the right side's other columns follow."""
    right = right.withColumnsRenamed({name: f"__{name}" for name in names})
    on = [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in names]
    return left.join(right, on, how).drop(*[f"__{name}" for name in names])


def _marked(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with text and digest, one narrow row for equal ones with how many they are)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    rows = rows.select(F.col(id_col).cast("string").alias("c"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    rows = rows.select("c", "turn", "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    role = F.substring("role", 1, 1)
    code = F.when(role == "s", SYSTEM).when(role == "u", USER).when(role == "a", ASSISTANT).otherwise(0) + F.when(F.col("text").rlike(_OPEN_END), 4).otherwise(0)
    narrow = rows.select("c", "turn", "role", "digest", F.col("text").rlike(_BLANK).alias("blank"), code.alias("code"))
    return rows, narrow.groupBy("c", "turn", "role", "digest", "blank", "code").agg(F.count("*").alias("m"))


def repair(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, lines): one row a conversation, and the repaired conversations' lines.

    audits: id, gaps, blank, duplicate, truncated, illegal, cost, audit.  lines: c (the id as a string), k and seq (their order), role,
    text.  Rows of a conversation are taken by turn, nulls first; rows of one turn by role, then by the digest of their
    text, so that equal ones lie side by side.  A null role or text counts as one space (such a row is blank or
    has to be reroled); a null id is a conversation like any other.  Very long texts are read once and move as digests
    until the lines are joined.  An empty table gives empty ones; further columns are not read.
    """
    texts, marks = _marked(rows, id_col, turn_col, role_col, text_col)
    marks = cut(marks, "marks")
    # The first of equal lines stays; all others are repeats.  A key has one row here, however often it is there.
    first = marks.where("not blank").groupBy("c", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("n"), "turn")).alias("f"))
    first = first.select("c", F.col("f.turn").alias("turn"), "role", "digest", F.lit(True).alias("kept"))
    marks = _joined(marks, first, "c", "turn", "role", "digest", how="left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    ordered = marks.repartitionByRange("c", "turn", "role", "digest").sortWithinPartitions("c", "turn", "role", "digest")
    ordered = cut(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")

    kept, m = F.col("kept").cast("long"), F.col("m")
    turns = ordered.groupBy("c", "turn").agg(F.sum(F.when(F.col("blank"), m).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(m - kept)).alias("duplicate"), F.sum(kept * F.when(F.col("code") >= 4, 1).otherwise(0)).alias("truncated"))
    counts = turns.groupBy("c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")])

    code = F.col("code") + 8 * kept
    pieces = ordered.groupBy("c", F.shiftright("at", _SHIFT).alias("b")).agg(F.array_sort(F.collect_list(F.struct("at", code.alias("code"), "m"))).alias("rows"))
    pieces = cut(pieces.select("c", "b", F.col("rows.at").alias("at"), F.col("rows.code").alias("code"), F.col("rows.m").alias("m")), "pieces")
    many = pieces.groupBy("c").agg(F.count("*").alias("n"), F.max("b").alias("last"))
    many = cut(many.where("n > 1").select("c", "last"), "many")
    single = _joined(pieces, many, "c", how="left").where("last is null")

    def alone(row):
        graph, gone = _graph(row.code, row.m)
        dist = distances(graph, _END)
        yield row.c, 0, walk(graph, gone, dist, START, True)[0], START, dist[START], row.at, row.code, row.m

    def matrix(row):
        graph, _ = _graph(row.code, row.m)
        columns = [distances(graph, [0 if s == j else None for s in range(4)])[:4] for j in range(4)]
        yield row.c, row.k, [columns[j][i] for i in range(4) for j in range(4)]

    def walks(row):
        graph, gone = _graph(row.code, row.m)
        dist = distances(graph, [int(x) for x in row.state])
        found = [walk(graph, gone, dist, s, row.last) for s in range(4)]
        yield row.c, row.k, [a for a, _ in found], [s for _, s in found], dist[START], row.at, row.code, row.m

    rest = "at array<long>, code array<int>, m array<long>"
    whole = _mapped(single.select("c", "at", "code", "m"), alone, f"c string, k long, audit string, state long, cost long, {rest}")
    if not many.isEmpty():
        parted = _joined(pieces, many, "c")
        parted = parted.withColumn("k", (F.row_number().over(Window.partitionBy("c").orderBy("b")) - 1).cast("long"))
        parted = cut(parted.select("c", "k", (F.col("b") == F.col("last")).alias("last"), "at", "code", "m"), "parted")
        matrices = cut(_mapped(parted.select("c", "k", "code", "m"), matrix, "c string, k long, e array<long>"), "matrices")
        behind = _scan(matrices, _combined, _remaining, list(_END), True)
        behind = _joined(parted, behind, "c", "k")
        four = cut(_mapped(behind, walks, f"c string, k long, audits array<string>, e array<long>, cost long, {rest}"), "walks")
        states = _scan(four, lambda a, b: [b[s] for s in a], lambda e, s: [e[s[0]]], [START], False)
        pieced = _joined(four, states, "c", "k").select("c", "k", F.get("audits", F.get("state", F.lit(0)).cast("int")).alias("audit"), F.get("state", F.lit(0)).alias("state"), "cost", "at", "code", "m")
        whole = whole.unionByName(pieced)
    solved = cut(whole, "solved")

    def pairs(row):
        inside = sum(int(m) - 1 for m in row.m)
        inside += sum((a & 3, b & 3) not in ((1, 2), (2, 3), (3, 2)) for a, b in zip(row.code[:-1], row.code[1:], strict=True))
        yield row.c, row.k, int(row.code[0]) & 3, int(row.code[-1]) & 3, inside

    ends = _mapped(solved.select("c", "k", "code", "m"), pairs, "c string, k long, head int, tail int, inside long")
    by_place = Window.partitionBy("c").orderBy("k")
    ends = ends.withColumn("before", F.lag("tail").over(by_place))
    between = F.when(F.col("before").isNull() | (F.concat_ws("", "before", "head").isin("12", "23", "32")), 0).otherwise(1)
    illegal = ends.groupBy("c").agg((F.sum("inside") + F.sum(between)).alias("illegal"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "audit"))), lambda x: x["audit"]), "")
    paths = solved.groupBy("c").agg(F.max(F.when(F.col("k") == 0, F.col("cost"))).alias("cost"), joined.alias("audit"))
    audits = _joined(_joined(counts, illegal, "c"), paths, "c")
    audits = cut(audits.select(F.col("c").cast(rows.schema[id_col].dataType).alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", (F.col("cost") + 3 * (F.col("blank") + F.col("duplicate"))).alias("cost"), "audit"), "audits")

    def replayed(row):
        """The lines that the audit writes: (order, place of the row or -1, role if it isn't the row's own)."""
        state, letters, at = int(row.state), iter(row.audit), 0
        places = ((int(a), int(c), i) for a, c, m in zip(row.at, row.code, row.m, strict=True) for i in range(int(m)))
        for letter in letters:
            if letter == "I":
                state = _NEXT[state]
                yield row.c, row.k, at, -1, _NAMES[state]
            else:
                place, code, _ = next(places)
                if letter != "D":
                    state = code & 3 if letter == "K" else _NEXT[state]
                    yield row.c, row.k, at, place, None if letter == "K" else _NAMES[state]
            at += 1

    written = cut(_mapped(solved.select("c", "k", "audit", "state", "at", "code", "m"), replayed, "c string, k long, seq long, at long, new_role string"), "lines")
    own = written.where("at >= 0").join(ordered.where("kept").select("at", "turn", "role", "digest"), "at").select("c", "turn", "role", "digest", "k", "seq", "new_role")
    texts = texts.groupBy("c", "turn", "role", "digest").agg(F.any_value("text").alias("text"))
    own = _joined(own, texts, "c", "turn", "role", "digest").select("c", "k", "seq", F.coalesce("new_role", "role").alias("role"), "text")
    added = written.where("at < 0").select("c", "k", "seq", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return audits, own.unionByName(added)


def digests_of(lines: DataFrame) -> DataFrame:
    """(c, repaired_sha256): of a conversation's ``role:text`` lines, newline-joined.  Lines stream in order, so a task
    holds a batch of them and one running digest, whatever a conversation's size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, running = None, None
        for batch in batches:
            done = []
            for c, line in zip(batch["c"], batch["line"], strict=True):
                if running is None or c != now:
                    if running is not None:
                        done.append((now, running.hexdigest()))
                    now, running = c, hashlib.sha256(line.encode())
                else:
                    running.update(b"\n" + line.encode())
            yield pd.DataFrame(done, columns=["c", "repaired_sha256"])
        if running is not None:
            yield pd.DataFrame([(now, running.hexdigest())], columns=["c", "repaired_sha256"])

    lines = lines.select("c", "k", "seq", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("c").sortWithinPartitions("c", "k", "seq").mapInPandas(run, "c string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by crc32 of ``conv_id:turn``; nulls count as one space (in the crc too)."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault, text = F.crc32(name.cast("binary")) % 20, F.coalesce("text", space)
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(F.coalesce("role", space))
    times = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).when(fault == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults, the least repair and its digest; one row for each conversation."""
    rows = table(spark, sf_dir, "conversations")
    with scratch(spark) as keep, bounded_batches(spark):
        audits, lines = repair(damaged(rows))
        every = rows.select("conv_id").distinct()
        digests = digests_of(lines)
        out = _joined(_joined(every, audits, "conv_id", how="left"), digests.select(F.col("c").cast(rows.schema["conv_id"].dataType).alias("conv_id"), "repaired_sha256"), "conv_id", how="left")
        numbers = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        out = cut(out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")), "repaired")
        keep.append(out)
    return out

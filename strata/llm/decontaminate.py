"""Benchmark decontamination by a distributed positional inverted index.

The index is document-sharded: each shard (a bounded batch of documents) stores the terms that occur in it and, for
each term, its postings, the sorted places of all its occurrences.  Places count through a shard, with a gap after
each document.  The index covers all tokens of all documents, is built by one pass over the texts, written as Parquet,
and serves any number of test blocks.

A phrase query orders a window's terms by how often the whole corpus has them, takes the postings of the rarest one as
candidates, and intersects them with the other lists, next rarest first, each list adjusted by its term's offset.  A
proximity query asks for most of a window's distinct terms, in any order, among a few more places than the window has.
If all but m of them are needed, one of the m + 1 rarest is always there, so candidates are the postings of these: a
match is found whichever terms it lacks, also terms that no document has.

The test set is read in blocks of bounded size (``block_bytes``); a larger one takes more blocks, never a larger
broadcast.  Texts are read where they lie and never shuffled.  Terms are known by 64-bit hashes (of a million test
terms and a billion corpus terms, two differing ones share a hash with probability 6e-5).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_cut, table, text_check, without, word_hashes

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space, so that split() gives the
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_GAP = 64  # places between two documents of a shard; more than any window and its slack
_PAIRS = 1 << 15  # candidates that are looked at together


def split_words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _pack(numbers: np.ndarray) -> bytes:
    """uint32 numbers, byte plane by byte plane: the high planes of differences are nearly constant and compress."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def build_index(docs: DataFrame) -> DataFrame:
    """(id, check, t) -> one row a shard: number, ids, checks, lengths, terms (sorted hashes), counts, places."""
    id_type = docs.schema["id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            token, lengths = word_hashes(batch.column(2), WORD_BYTES)
            place = np.arange(len(token)) + np.repeat(np.arange(len(lengths)) * _GAP, lengths)
            order = np.argsort(token, kind="stable")
            token, place = token[order], place[order]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
            steps = np.diff(place, prepend=0)
            steps[first] = place[first]
            counts = np.diff(np.append(first, len(token)))
            one = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int.from_bytes(os.urandom(7), "big")], pa.int64()),
                    pa.ListArray.from_arrays(one, batch.column(0)),
                    pa.ListArray.from_arrays(one, batch.column(1)),
                    pa.array([_pack(lengths)], pa.binary()),
                    pa.array([token[first].tobytes()], pa.binary()),
                    pa.array([_pack(counts)], pa.binary()),
                    pa.array([_pack(steps)], pa.binary()),
                ],
                ["shard", "ids", "checks", "lengths", "terms", "counts", "places"],
            )

    with bounded_batches(docs.sparkSession, 250):
        return cut(docs.select("id", "check", "t").mapInArrow(kernel, f"shard long, ids array<{id_type}>, checks array<long>, lengths binary, terms binary, counts binary, places binary"), "index")


@dataclass
class TestBlock:
    """Test items in numbers: windows are stretches of ``flat``, the items' terms one after the other."""

    ids: list[str]
    terms: np.ndarray  # sorted hashes
    flat: np.ndarray  # numbers into terms
    item: np.ndarray  # of each window
    start: np.ndarray  # of each window, in flat
    place: np.ndarray  # of each window, in its item
    size: np.ndarray
    order: np.ndarray | None = None  # (window, window size): its places, rarest term first; repeats and padding last
    distinct: np.ndarray | None = None  # number of distinct terms
    need: np.ndarray | None = None  # how many of them make a proximity match

    @classmethod
    def of(cls, items: list[tuple[str, list[bytes]]], window: int) -> TestBlock:
        tokens, lengths = word_hashes(pa.array([b" ".join(ws) for _, ws in items], pa.binary()), WORD_BYTES)
        terms, flat = np.unique(tokens, return_inverse=True)
        windows = np.maximum(1, lengths - window + 1)
        item = np.repeat(np.arange(len(items)), windows)
        inside = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(np.cumsum(lengths) - lengths, windows) + inside
        return cls([i for i, _ in items], terms, flat.astype(np.int32), item, start, inside, np.minimum(window, lengths)[item])

    def choose(self, counts: np.ndarray, window: int, share: float) -> None:
        """Order of each window's terms by ``counts`` in the corpus, and how many a proximity match needs."""
        n, far = len(self.item), np.iinfo(np.int64).max
        self.order, self.distinct = np.zeros((n, window), np.int8), np.zeros(n, np.int64)
        for i in range(0, n, 4096):
            at = slice(i, min(n, i + 4096))
            real = np.arange(window) < self.size[at, None]
            term = np.where(real, self.flat[np.minimum(self.start[at, None] + np.arange(window), len(self.flat) - 1)], -1)
            again = ((term[:, :, None] == term[:, None, :]) & np.tri(window, k=-1, dtype=bool)).any(axis=2)
            fresh = real & ~again
            key = np.where(fresh, counts[term], np.where(real, far - 1, far))
            self.order[at] = np.argsort(key, axis=1, kind="stable")
            self.distinct[at] = fresh.sum(axis=1)
        self.need = np.ceil(share * self.distinct - 1e-9).astype(np.int64)


class Shard:
    """One row of the index, read for the terms of a test block."""

    def __init__(self, row: dict, test_terms: np.ndarray):
        self.ids, self.checks = row["ids"], row["checks"]
        self.lengths = _unpack(row["lengths"])
        self.starts = np.cumsum(self.lengths + _GAP) - self.lengths - _GAP
        self.end = int(self.lengths.sum()) + _GAP * len(self.lengths) + 1
        terms, counts = np.frombuffer(row["terms"], np.uint64), _unpack(row["counts"])
        upto = np.cumsum(counts)
        at = np.minimum(np.searchsorted(terms, test_terms), max(0, len(terms) - 1))
        has = terms[at] == test_terms if len(terms) else np.zeros(len(test_terms), bool)
        self.first = np.where(has, upto[at] - counts[at], 0) if len(terms) else np.zeros(len(test_terms), np.int64)
        self.count = np.where(has, counts[at], 0) if len(terms) else np.zeros(len(test_terms), np.int64)
        steps = _unpack(row["places"])
        run = np.cumsum(steps)
        before = np.append(0, run)[upto - counts] if len(counts) else run[:0]
        self.places = run - np.repeat(before, counts)
        # All lists as one sorted list of (list, place): an intersection is a search in it.
        self.number = np.where(has, at, -1)
        self.keys = np.repeat(np.arange(len(terms)), counts) * self.end + self.places

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every place of every one of the terms: (index into ``term``, place)."""
        n = self.count[term]
        which = np.repeat(np.arange(len(term)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.places[self.first[term][which] + inside]

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place is in the list of its term."""
        number = self.number[term]
        key = number * self.end + place
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (number >= 0) & (place >= 0) & (place < self.end) & (self.keys[at] == key)

    def documents(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1


def phrases(b: TestBlock, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence of a window: intersections of lists, the rarest first."""
    lead = b.order[:, 0]
    window, place = shard.postings(b.flat[b.start + lead])
    start = place - lead[window]
    for k in range(1, b.order.shape[1]):
        offset = b.order[window, k]
        real = offset < b.size[window]
        term = b.flat[np.where(real, b.start[window] + offset, 0)]
        kept = ~real | shard.has(term, start + offset)
        window, start = window[kept], start[kept]
    return window, start


def neighbours(b: TestBlock, shard: Shard, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, candidate, start): stretches of window size + ``slack`` places with as many distinct terms as needed.

    ``start`` is the first place of the earliest such stretch that holds the candidate; a gap between documents has no
    terms, so a stretch never joins two.
    """
    wide = b.order.shape[1]
    own = wide + slack - 1
    span = np.arange(-own, own + 1)
    term_at = np.full(shard.end + 2 * _GAP, -1, np.int32)  # the lists of the test terms, laid out by place
    which, place = shard.postings(np.arange(len(b.terms)))
    term_at[place] = which
    found = [(np.zeros(0, np.int64),) * 3]
    missing = b.distinct - b.need
    for k in range(int(missing.max(initial=-1)) + 1):
        asked = np.flatnonzero((missing >= k) & (b.distinct > 1))
        at, place = shard.postings(b.flat[b.start[asked] + b.order[asked, k]])
        for i in range(0, len(at), _PAIRS):
            w, p = asked[at[i : i + _PAIRS]], place[i : i + _PAIRS]
            near = term_at[p[:, None] + span]  # places before the first one read the empty end
            slots = np.zeros((len(w), wide, len(span)), bool)
            for j in range(wide):
                used = j < b.distinct[w]
                term = np.where(used, b.flat[np.where(used, b.start[w] + b.order[w, j], 0)], -2)
                slots[:, j] = near == term[:, None]
            some = slots.any(axis=2).sum(axis=1) >= b.need[w]
            w, p, slots = w[some], p[some], slots[some]
            run = np.concatenate((np.zeros((len(w), wide, 1), np.int16), np.cumsum(slots, axis=2, dtype=np.int16)), axis=2)
            reach, least = b.size[w] + slack, np.full(len(w), -1, np.int64)
            for r in np.unique(reach):
                mine = np.flatnonzero(reach == r)
                for s in range(own, own - r, -1):
                    enough = ((run[mine, :, s + r] - run[mine, :, s]) > 0).sum(axis=1) >= b.need[w[mine]]
                    least[mine[enough]] = s
            ok = least >= 0
            found.append((w[ok], p[ok], p[ok] + span[least[ok]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _lists(doc: np.ndarray, n_docs: int, values: pa.Array) -> pa.ListArray:
    """Values, sorted by document, as one list a document."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), values)


def _matches(b: TestBlock, shard: Shard, slack: int | None) -> list[pa.Array]:
    """Columns spans, items, near, with a row for each document of the shard."""
    n, names = len(shard.lengths), sorted(set(b.ids))
    rank = {x: i for i, x in enumerate(names)}
    rank = np.array([rank[x] for x in b.ids], np.int64)
    window, start = phrases(b, shard)
    order = np.argsort(start, kind="stable")
    window, start = window[order], start[order]
    doc, stop = shard.documents(start), np.maximum.accumulate(start + b.size[window])
    first = np.flatnonzero(np.append(True, start[1:] > stop[:-1])[: len(start)])
    last = np.append(first[1:], len(start))[: len(first)] - 1
    base = shard.starts[doc[first]]
    spans = pa.StructArray.from_arrays([pa.array(start[first] - base, pa.int32()), pa.array(stop[last] - base, pa.int32())], ["start", "stop"])
    item = np.unique(doc * max(1, len(names)) + rank[b.item[window]])
    item_doc, item = item // max(1, len(names)), item % max(1, len(names))
    items = pa.array(names, pa.string()).take(pa.array(item, pa.int64()))
    w = at = near_doc = np.zeros(0, np.int64)
    if slack is not None:
        w, candidate, at = neighbours(b, shard, slack)
        near_doc = shard.documents(candidate)
        order = np.lexsort((at, w, near_doc))
        key = (near_doc * max(1, len(b.item)) + w)[order]
        order = order[np.append(True, key[1:] != key[:-1])[: len(key)]]
        order = order[~np.isin((near_doc * max(1, len(b.item)) + w)[order], doc * max(1, len(b.item)) + window)]
        w, near_doc, at = w[order], near_doc[order], np.maximum(0, at[order] - shard.starts[near_doc[order]])
    near = pa.StructArray.from_arrays([pa.array(b.ids, pa.string()).take(pa.array(b.item[w], pa.int64())), pa.array(b.place[w], pa.int32()), pa.array(at, pa.int32())], ["item", "place", "start"])
    return [_lists(doc[first], n, spans), _lists(item_doc, n, items), _lists(near_doc, n, near)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)) == k)
        rows = part.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col).distinct().toLocalIterator()
        items = [(i, split_words((t or "").encode())) for i, t in rows]
        yield sorted(x for x in items if x[1])


def _count_terms(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each test term occurs in all documents; reads two columns of the index."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for have, counts in zip(batch.column(0), batch.column(1), strict=True):
                have = np.frombuffer(have.as_py(), np.uint64)
                at = np.searchsorted(shared.value, have)
                ok = shared.value[np.minimum(at, max(0, len(seen) - 1))] == have if len(seen) else np.zeros(len(have), bool)
                seen[at[ok]] += _unpack(counts.as_py())[ok]
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["term", "n"])

    total = np.zeros(len(terms), np.int64)
    with bounded_batches(index.sparkSession):
        found = index.select("terms", "counts").mapInArrow(kernel, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        for r in found.toLocalIterator():  # no more rows than the block has terms
            total[r.term] = r.n
    shared.destroy()
    return total


def _search(index: DataFrame, block: TestBlock, slack: int | None) -> DataFrame:
    """(shard, n, id, check, n_words, spans, items, near) of every document, written."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("lengths", "terms", "counts", "places")}
                row = {name: v.as_py() for name, v in row.items()} | {"ids": batch.column("ids")[i].values, "checks": batch.column("checks")[i].values}
                shard = Shard(row, shared.value.terms)
                n = len(shard.lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("shard")[i].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), shard.ids, shard.checks, pa.array(shard.lengths, pa.int64()), *_matches(shared.value, shard, slack)],
                    ["shard", "n", "id", "check", "n_words", "spans", "items", "near"],
                )

    id_type = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"shard long, n int, id {id_type}, check long, n_words long, spans array<struct<start:int,stop:int>>, items array<string>, near array<struct<item:string,place:int,start:int>>"
    with bounded_batches(index.sparkSession, 4):
        out = cut(index.mapInArrow(kernel, schema), "matches")
    shared.destroy()
    return out


def _decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share_of: int = 20, near_share: float | None = 0.8, near_slack: int = 3, block_bytes: int = 4 << 20) -> DataFrame:
    if not 0 < window + near_slack < _GAP:
        raise ValueError(f"window and near_slack must be fewer than {_GAP} places")
    index = build_index(docs.select(F.col(id_col).alias("id"), text_check(text_col).alias("check"), F.col(text_col).alias("t")))
    parts = []
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        block = TestBlock.of(items, window)
        block.choose(_count_terms(index, block.terms), window, 1.0 if near_share is None else near_share)
        parts.append(_search(index, block, None if near_share is None else near_slack))
    found = parts[0]
    if len(parts) > 1:  # one row a document and block
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        every = lambda c: F.flatten(F.collect_list(c))
        found = whole.groupBy("shard", "n").agg(F.first("id").alias("id"), F.first("check").alias("check"), F.first("n_words").alias("n_words"), F.array_sort(every("spans")).alias("spans"), F.array_sort(F.array_distinct(every("items"))).alias("items"), F.array_sort(every("near")).alias("near"))
        found = cut(found, "matches")
    drop_cut(index, *[p for p in parts if p is not found])
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["stop"]).alias("upto")),
        lambda a: a["n"],
    )
    found = found.withColumn("n_hit", covered.cast("long"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share_of >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, items, spans, near.

    A word is hit inside any occurrence of a window of ``window`` (13) consecutive item words (a shorter item is one
    window); contaminated: some hit, and hits are at least one in ``share_of`` (20) words.  spans are the hit words'
    stretches, items the items with such windows.  near lists the proximity matches (item, place of the window in it,
    place of the stretch in the document): windows of two or more distinct terms that don't occur in the document but
    ``near_share`` (0.8) of whose distinct terms do, in any order, within the window's size and ``near_slack`` (3)
    places more; the earliest stretch of each.  They decide nothing; ``near_share`` None leaves them out.

    Nulls and texts without words have no words and match nothing; a null item id is the empty text; repeated rows
    come out repeated with equal results; an empty table of either kind gives an empty, or all-clean, result.
    """
    found = _decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, **how)
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        F.size("near").cast("long").alias("n_near"),
        "items",
        "spans",
        "near",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns; rows are known by id and text."""
    found = _decontaminate(docs, benchmark, id_col=id_col, text_col=text_col, **{"near_share": None} | how)
    return without(docs, found.where("contaminated"), id_col, text_col)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then the proximity matches: their number, and ``item:place:start`` of each."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    near = F.array_join(F.transform(F.array_sort("near"), lambda x: F.concat_ws(":", x["item"], x["place"].cast("string"), x["start"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", F.array_join("items", ",").alias("items"), near.alias("near"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id),
-- proximity: windows that don't occur, four fifths of whose distinct terms stand in 3 places more than they have
places AS (SELECT CAST(item_id AS VARCHAR) AS item, k, i - 1 AS place, array_to_string(w[i:i + k - 1], ' ') AS win, list_distinct(w[i:i + k - 1]) AS terms FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
need AS (SELECT *, CAST(ceil(0.8 * len(terms) - 1e-9) AS BIGINT) AS need FROM places WHERE len(terms) > 1),
term AS (SELECT item, place, k, need, win, unnest(terms) AS t FROM need),
posting AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
pair AS (SELECT doc_id, item, place, k, need, win FROM (SELECT DISTINCT doc_id, t FROM posting) JOIN term USING (t) GROUP BY ALL HAVING count(*) >= need),
open AS (SELECT * FROM pair WHERE NOT EXISTS (SELECT 1 FROM dw WHERE dw.doc_id = pair.doc_id AND dw.k = pair.k AND dw.win = pair.win)),
occurs AS (SELECT o.doc_id, o.item, o.place, o.k, o.need, p, t FROM open o JOIN term USING (item, place) JOIN posting USING (doc_id, t)),
stretch AS (SELECT e.doc_id, e.item, e.place, greatest(0, e.p - e.k - 2) AS start FROM occurs e JOIN occurs f ON f.doc_id = e.doc_id AND f.item = e.item AND f.place = e.place AND f.p BETWEEN greatest(0, e.p - e.k - 2) AND e.p
            GROUP BY e.doc_id, e.item, e.place, e.k, e.need, e.p HAVING count(DISTINCT f.t) >= e.need),
near AS (SELECT doc_id, count(*) AS n_near, string_agg(item || ':' || place || ':' || start, ',' ORDER BY item, place) AS near FROM (SELECT doc_id, item, place, min(start) AS start FROM stretch GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0) AS n_near, coalesce(items, '') AS items, coalesce(near, '') AS near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN near USING (doc_id)
"""

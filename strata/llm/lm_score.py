"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are gathered from all training texts, merged by hash block, and quantised: a count c
has level 1 + floor(log2 c).  The filter of a block holds (pair, j) for every j up to the level, so a worker reads
a count q back by probing j = 1, 2, ... until a probe fails, and takes the mean of that level's counts.

The model is a distribution over the next token: with absolute discount D (from how many pairs occur once and twice),

    P(w | h) = (max(q(h, w) - D, 0) + D (n(h) + f) P(w)) / (z(h) + f)

z(h) is the sum of all q(h, w) and n(h) their number, exact and stored by history; f is the number of new words that
the filter is expected to answer by mistake (the chance that its bits, as filled, let a pair pass, times the words that
don't follow h), so that the mistakes' mass is counted in as well.  P(w) is (c + 1) / (N + V + 1) for every word,
and for the unknown one with c = 0.  After a word that was seen once or never P(w | h) is P(w).

A block belongs to a range of histories and a part of the pairs, so the pairs of one hot history are many blocks.
Blocks have about 8 MB of text each, however many they are.  Workers get filters and histories in passes of at most
``max_filter_bytes``; a pass scores the tokens whose block it has, and its broadcast goes before the next one comes.

Words are told apart by a 64-bit hash.  Counts of the commonest words (at most ``hot_words`` and ``model_words``) are
broadcast.  For a token of another word a pass hands on the numbers a and b of P(w | h) = a + b P(w); a shuffle joins
the word's count, for the score and for the base score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, cut, drop_cut, mix64, table, text_check, word_hashes

END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text
_GOLD, _PAIR = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_RANGES = 8  # at most 2^8 ranges of histories
#: 4096 masks of 6 bits; a key and level sets one in each of two 64-bit words of its block.
_MASKS = np.bitwise_or.reduce(np.uint64(1) << np.random.default_rng(11).permuted(np.tile(np.arange(64, dtype=np.uint64), (4096, 1)), axis=1)[:, :6], axis=1)


def _batch_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of a batch (words, then an end each), and where each text starts."""
    words, n = word_hashes(column)
    starts = np.cumsum(n + 1) - n - 1
    now = np.full(len(words) + len(n), END)
    now[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
    return now, starts


def _before(now: np.ndarray) -> np.ndarray:
    """The token before each one: the last of a text is an end, and so is the one before a text's first."""
    return np.concatenate((now[-1:], now[:-1]))


def _pairs(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return mix64(before * _PAIR + now)


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 1 + floor(log2 c)


def _estimate(levels: np.ndarray) -> np.ndarray:
    """Mean of the counts of a level, taken as equally likely; 0 for level 0."""
    return np.where(levels > 0, 1.5 * np.exp2(levels - 1.0) - 0.5, 0.0)


class Blocks:
    """Numbers of blocks: the first bits of the history's hash, then the first bits of the pair's."""

    def __init__(self, text_bytes: int, block_bytes: int = 8 << 20):
        self.log = max(4, math.ceil(math.log2(text_bytes / block_bytes + 1)))
        self.range_bits = min(_RANGES, self.log // 2)
        self.part_bits = self.log - self.range_bits

    def of(self, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        return ((before >> np.uint64(64 - self.range_bits)) << np.uint64(self.part_bits) | pair >> np.uint64(64 - self.part_bits)).astype(np.int64)

    def of_words(self, words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(64 - self.log)).astype(np.int64)


def _probe(keys: np.ndarray, j: int, size: np.ndarray | np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The 64-bit words of a block of ``size`` words that (key, level j) looks at, with the bits to be set."""
    h = mix64(keys + np.uint64(j * _GOLD & (1 << 64) - 1))
    g = mix64(h)
    yield (h >> np.uint64(32)) * size >> np.uint64(32), _MASKS[g & np.uint64(4095)]
    yield (h & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32), _MASKS[g >> np.uint64(52)]


def build_filter(keys: np.ndarray, counts: np.ndarray, bits_each: float) -> np.ndarray:
    """Filter block of (key, 1..level), as 64-bit words."""
    levels = _levels(counts)
    data = np.zeros(max(1, math.ceil(levels.sum() * bits_each / 64)), np.uint64)
    for j in range(1, int(levels.max(initial=0)) + 1):
        for at, mask in _probe(keys[levels >= j], j, np.uint64(len(data))):
            np.bitwise_or.at(data, at.astype(np.int64), mask)
    return data


def filter_error(data: np.ndarray) -> float:
    """Chance that a key that isn't in a filter block passes its first level: both masks fall on bits that are set."""
    ways = np.array([math.comb(k, 6) for k in range(65)]) / math.comb(64, 6)
    return float(ways[np.bitwise_count(data)].mean() ** 2)


class Filter:
    """The blocks [first, stop) that have pairs."""

    def __init__(self, blocks: dict[int, np.ndarray], first: int, stop: int):
        self.first, self.stop = first, stop
        self.size = np.zeros(stop - first, np.uint64)
        for k, data in blocks.items():
            self.size[k - first] = len(data)
        self.base = (np.cumsum(self.size) - self.size).astype(np.int64)
        self.data = np.concatenate([np.zeros(0, np.uint64), *[data for _, data in sorted(blocks.items())]])

    def levels(self, keys: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Levels of keys whose blocks are in [first, stop)."""
        out, at = np.zeros(len(keys), np.int64), blocks - self.first
        live, j = np.flatnonzero(self.size[at]), 0
        while len(live):
            j += 1
            base, ok = self.base[at[live]], slice(None)
            for word, mask in _probe(keys[live], j, self.size[at[live]]):
                hit = self.data[base[ok] + word[ok].astype(np.int64)] & mask[ok] == mask[ok]
                ok = np.flatnonzero(hit) if isinstance(ok, slice) else ok[hit]
            live = live[ok]
            out[live] = j
        return out


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are nearly constant and compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(planes).view(np.uint64).reshape(-1), dtype=np.uint64)


def _gather(docs: DataFrame, blocks: Blocks, flush: int) -> DataFrame:
    """(kind, block, keys, words, counts): runs of counts; kind 1: words (keys), kind 2: histories (keys) and words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows(kind: int, block: np.ndarray, keys: np.ndarray, words: np.ndarray | None, counts: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
            part = lambda x, f: [f(p) for p in np.split(x, cuts[1:])] if len(x) else []
            own = part(words, np.ndarray.tobytes) if words is not None else [None] * len(cuts)
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(cuts), pa.int32()), pa.array(block[cuts], pa.int64()), pa.array(part(keys, _pack), pa.binary()), pa.array(own, pa.binary()), pa.array(part(counts.astype(np.uint32), np.ndarray.tobytes), pa.binary())], ["kind", "block", "keys", "words", "counts"])

        def runs() -> Iterator[pa.RecordBatch]:
            now = np.concatenate(held)
            held.clear()
            keys, counts = np.unique(now, return_counts=True)
            yield rows(1, blocks.of_words(keys), keys, None, counts)
            before = _before(now)
            pair, first, counts = np.unique(_pairs(before, now), return_index=True, return_counts=True)
            before, now = before[first], now[first]
            block = blocks.of(before, pair)
            order = np.lexsort((before, block))
            yield rows(2, block[order], before[order], now[order], counts[order])

        for batch in batches:
            if batch.num_rows:
                held.append(_batch_tokens(batch.column(0))[0])
                n += len(held[-1])
                if n >= flush:
                    yield from runs()
                    n = 0
        if held:
            yield from runs()

    return docs.mapInArrow(kernel, "kind int, block long, keys binary, words binary, counts binary")


def _merge(runs: DataFrame, bits_each: float) -> DataFrame:
    """One row per kind and block, from sums of counts.  Words: keys and counts.  Pairs: the filter (data), and for the
    block's histories (keys) the sum z and the number n of its quantised pairs (counts: z, then n)."""

    def kernel(t: pa.Table) -> pa.Table:
        kind, block = t["kind"][0].as_py(), t["block"][0].as_py()
        keys = np.concatenate([_unpack(x.as_py()) for x in t["keys"]])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t["counts"]]).astype(np.int64)
        own, history = keys, keys
        if kind == 2:
            own = _pairs(keys, np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t["words"]]))
        order = np.argsort(own, kind="stable")
        own, history, counts = own[order], history[order], counts[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        own, history, counts = own[first], history[first], np.add.reduceat(counts, first)
        levels, data, error = _levels(counts), None, 0.0
        by_level = np.bincount(levels, minlength=64).astype(np.int64)
        total, once, twice = int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum())
        if kind == 2:
            data = build_filter(own, counts, bits_each)
            data, error = data.tobytes(), filter_error(data)
            own, back = np.unique(history, return_inverse=True)
            counts = np.concatenate((np.bincount(back, _estimate(levels)), np.bincount(back).astype(np.float64)))
        return pa.table({"kind": pa.array([kind], pa.int32()), "block": pa.array([block], pa.int64()), "keys": pa.array([own.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "data": pa.array([data], pa.binary()), "error": pa.array([error], pa.float64()), "total": pa.array([total], pa.int64()), "once": pa.array([once], pa.int64()), "twice": pa.array([twice], pa.int64()), "by_level": pa.array([by_level.tolist()], pa.list_(pa.int64()))})

    return runs.groupBy("kind", "block").applyInArrow(kernel, "kind int, block long, keys binary, counts binary, data binary, error double, total long, once long, twice long, by_level array<long>")


def _word_counts(merged: DataFrame, least: int, below: int) -> DataFrame:
    """(h, c) of the words whose level is in [least, below)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1), strict=True):
                keys, counts = np.frombuffer(k.as_py(), np.int64), np.frombuffer(c.as_py(), np.int64)
                take = (_levels(counts) >= least) & (_levels(counts) < below)
                yield pa.RecordBatch.from_arrays([pa.array(keys[take]), pa.array(counts[take])], ["h", "c"])

    return merged.where("kind = 1").select("keys", "counts").mapInArrow(kernel, "h long, c long")


def _histories(merged: DataFrame, blocks: Blocks) -> DataFrame:
    """(range, h, z, n): sums over all blocks of a history, of those that something follows twice."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, k, c in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                keys, both = np.frombuffer(k.as_py(), np.int64), np.frombuffer(c.as_py(), np.float64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py() >> blocks.part_bits] * len(keys), pa.int32()), pa.array(keys), pa.array(both[0]), pa.array(both[1])], ["range", "h", "z", "n"])

    rows = merged.where("kind = 2").select("block", "keys", "counts").mapInArrow(kernel, "range int, h long, z double, n double")
    return rows.groupBy("range", "h").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).where("z > 1")


class Model:
    """What a pass needs to score its tokens: P(w), the discount, a filter and the histories of its ranges."""

    def __init__(self, blocks: Blocks, words: tuple[np.ndarray, np.ndarray], n_train: int, n_distinct: int, discount: float, errors: np.ndarray):
        self.blocks, (self.words, self.counts), self.errors = blocks, words, errors
        self.n_train, self.n_distinct, self.discount = n_train, n_distinct, discount
        rare = n_distinct - len(self.words)
        mass = n_train + n_distinct + 1.0
        self.p_words = (self.counts + 1.0) / mass
        self.p_other = (n_train - float(self.counts.sum()) + rare + 1.0) / (rare + 1) / mass
        self.filter, self.histories = Filter({}, 0, 1 << blocks.log), np.zeros(0, np.uint64)
        self.z = self.n = np.zeros(0)

    def with_pass(self, filter: Filter, histories: np.ndarray, z: np.ndarray, n: np.ndarray) -> Model:
        out = object.__new__(Model)
        out.__dict__ = self.__dict__ | {"filter": filter, "histories": histories, "z": z, "n": n}
        return out

    @staticmethod
    def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``keys``, and whether they are there."""
        at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
        return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)

    def word_probabilities(self, words: np.ndarray) -> np.ndarray:
        """P(w) by the model's own words alone: the others share the rest evenly.  (Scores join their counts instead.)"""
        at, there = self.find(self.words, words)
        return np.where(there, self.p_words[at], self.p_other) if len(self.words) else np.full(len(words), self.p_other)

    def terms(self, before: np.ndarray, now: np.ndarray, z: np.ndarray, n: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and b of P(now | before) = a + b P(now) for tokens of this pass; z and n of ``before``, 0 where it was never seen."""
        q = _estimate(self.filter.levels(_pairs(before, now), blocks))
        wrong = np.maximum(0.0, self.n_distinct + 1 - n) * self.errors[blocks >> self.blocks.part_bits]
        seen = z > 0
        mass = np.where(seen, z + wrong, 1.0)
        return np.where(seen, np.maximum(q - self.discount, 0.0) / mass, 0.0), np.where(seen, self.discount * (n + wrong) / mass, 1.0)

    def probabilities(self, before: np.ndarray, now: np.ndarray, p: np.ndarray, z: np.ndarray, n: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """P(now | before) of tokens of this pass; ``p``: P(now)."""
        a, b = self.terms(before, now, z, n, blocks)
        return a + b * p

    def history(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """z and n of histories."""
        at, there = self.find(self.histories, words)
        return (np.where(there, self.z[at], 0.0), np.where(there, self.n[at], 0.0)) if len(self.histories) else (np.zeros(len(words)), np.zeros(len(words)))


def _common(merged: DataFrame, by_level: list[int], most: int) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """The lowest level from which on no more than ``most`` words are left, and these words and their counts."""
    level = next(i for i in range(1, 65) if sum(by_level[i:]) <= most)
    found = _word_counts(merged, level, 99).toArrow()
    keys, counts = (np.asarray(found[c].combine_chunks()) for c in ("h", "c"))
    order = np.argsort(keys.view(np.uint64))
    return level, (keys.view(np.uint64)[order], counts[order])


def train_model(train: DataFrame, *, bits_each: float, model_words: int, flush: int, max_filter_bytes: int) -> tuple[Model, DataFrame, DataFrame, list[tuple[int, int]], list[int]]:
    """From texts (t): the model without a pass, merged counts, histories, the passes' blocks, and the number of words
    of each level."""
    blocks = Blocks(train.agg(F.sum(F.octet_length("t"))).first()[0] or 0)
    with bounded_batches(train.sparkSession, 256):
        merged = cut(_merge(_gather(train, blocks, flush), bits_each), "counts")
        histories = cut(_histories(merged, blocks), "histories")
    facts = merged.groupBy("kind").agg(F.sum("total").alias("n"), F.sum("once").alias("once"), F.sum("twice").alias("twice"), F.sum(F.octet_length("data")).alias("bytes"), *[F.sum(F.get("by_level", F.lit(i))).alias(f"l{i}") for i in range(64)]).collect()
    facts = {r["kind"]: r for r in facts}
    by_level = [facts[1][f"l{i}"] if 1 in facts else 0 for i in range(64)]
    once, twice = (facts[2]["once"], facts[2]["twice"]) if 2 in facts else (0, 0)
    errors = np.zeros(1 << blocks.range_bits)
    for r in merged.where("kind = 2").groupBy(F.shiftright("block", blocks.part_bits).alias("range")).agg(F.sum("error").alias("error")).collect():
        errors[r["range"]] = r.error / (1 << blocks.part_bits)
    words = _common(merged, by_level, model_words)[1]
    model = Model(blocks, words, facts[1]["n"] if 1 in facts else 0, sum(by_level), (once + 0.5) / (once + 2 * twice + 1.0), errors)

    # Passes are made of units of blocks; there are some 16 units a pass, so few numbers come to the driver.
    n_bytes = (facts[2]["bytes"] if 2 in facts else 0) + 16 * histories.count()
    unit = min(blocks.log, max(0, int(math.log2((1 << blocks.log) * max_filter_bytes / 16 / max(1, n_bytes)) if n_bytes else blocks.log)))
    of_unit = lambda c: F.shiftright(c, unit).alias("unit")
    sizes = {r.unit: r.n for r in merged.where("kind = 2").groupBy(of_unit(F.col("block"))).agg(F.sum(F.octet_length("data")).alias("n")).collect()}
    of_range = {r["range"]: 16 * r["count"] for r in histories.groupBy("range").count().collect()}
    passes, room, ranges = [[0, 0]], 0, set()
    for k in range(1 << (blocks.log - unit)):
        touched = set(range((k << unit) >> blocks.part_bits, (((k + 1 << unit) - 1) >> blocks.part_bits) + 1))
        more = sizes.get(k, 0) + sum(of_range.get(r, 0) for r in touched - ranges)
        if room + more > max_filter_bytes and room:
            passes.append([k << unit, k << unit])
            room, ranges = 0, set()
            more = sizes.get(k, 0) + sum(of_range.get(r, 0) for r in touched)
        room += more
        ranges |= touched
        passes[-1][1] = k + 1 << unit
    return model, merged, histories, [tuple(p) for p in passes], by_level


def load_pass(model: Model, merged: DataFrame, histories: DataFrame, first: int, stop: int) -> Model:
    """The model with the filter of blocks [first, stop) and their histories."""
    part = merged.where((F.col("kind") == 2) & (F.col("block") >= first) & (F.col("block") < stop)).select("block", "data")
    found = Filter({r.block: np.frombuffer(bytes(r.data), np.uint64) for r in part.toLocalIterator()}, first, stop)
    bits = model.blocks.part_bits
    known = histories.where(F.col("range").between(first >> bits, stop - 1 >> bits)).select("h", "z", "n").toArrow()
    keys = np.asarray(known["h"].combine_chunks()).view(np.uint64)
    order = np.argsort(keys)
    return model.with_pass(found, keys[order], np.asarray(known["z"].combine_chunks())[order].astype(np.float32), np.asarray(known["n"].combine_chunks())[order].astype(np.float32))


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_mod: int = 7, held_is: int = 2, bits_each: float = 24.0, max_filter_bytes: int = 112 << 20, model_words: int = 500_000, hot_words: int = 500_000, flush: int = 1_000_000) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Learns from the documents whose crc32 of the id, modulo ``held_mod``, isn't ``held_is``.  Null texts are empty and
    have one token, their end; a null id hashes as the empty text; repeated rows count as often as they occur; an
    empty table is empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_check(text_col).alias("check"), F.col(text_col).alias("t"), (crc_mod(id_col, held_mod) == held_is).alias("held_out"))
    model, merged, histories, passes, by_level = train_model(rows.where("not held_out").select("t"), bits_each=bits_each, model_words=model_words, flush=flush, max_filter_bytes=max_filter_bytes)
    hot_level, hot = _common(merged, by_level, min(hot_words, model_words))
    hot = (model.words, model.counts) if len(hot[0]) == len(model.words) else hot
    mass = float(model.n_train + model.n_distinct + 1)

    def scorer(box, first: bool):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, (hot_keys, hot_counts) = box.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                now, starts = _batch_tokens(batch.column(2))
                n, m = np.diff(np.append(starts, len(now))), len(starts)
                words, back = np.unique(now, return_inverse=True)
                at, there = model.find(hot_keys, words)
                logs = np.where(there, np.log10(hot_counts[at] + 1.0), 0.0) if len(hot_keys) else np.zeros(len(words))
                p = np.where(there, (hot_counts[at] + 1.0) / mass, 0.0) if len(hot_keys) else np.zeros(len(words))
                there = there[back]
                base, known = (np.add.reduceat(logs[back], starts), np.add.reduceat(there.astype(np.int64), starts)) if first else (np.zeros(m), np.zeros(m, np.int64))
                before, history = _before(now), _before(back)
                block = model.blocks.of(before, _pairs(before, now))
                mine = np.flatnonzero((block >= model.filter.first) & (block < model.filter.stop))
                z, k = model.history(words)
                a, b = model.terms(before[mine], now[mine], z[history[mine]], k[history[mine]], block[mine])
                rare, logs = ~there[mine], np.zeros(len(now))
                logs[mine[~rare]] = np.log10(a[~rare] + b[~rare] * p[back[mine[~rare]]])
                upto = np.append(np.searchsorted(mine[rare], starts), rare.sum()).astype(np.int32)
                tail = pa.StructArray.from_arrays([pa.array(now[mine[rare]].view(np.int64)), pa.array(a[rare]), pa.array(b[rare])], ["h", "a", "b"])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(n), pa.array(known), pa.array(base), pa.ListArray.from_arrays(pa.array(upto), tail), pa.array(np.add.reduceat(logs, starts))], ["id", "check", "held_out", "n_tokens", "known", "base", "tail", "score"])

        return kernel

    schema = f"id {rows.schema['id'].dataType.simpleString()}, check long, held_out boolean, n_tokens long, known long, base double, tail array<struct<h:long,a:double,b:double>>, score double"
    parts = []
    for k, (first, stop) in enumerate(passes):
        box = spark.sparkContext.broadcast((load_pass(model, merged, histories, first, stop), hot))
        with bounded_batches(spark, 256):
            parts.append(cut(rows.select("id", "check", "t", "held_out").mapInArrow(scorer(box, k == 0), schema), "scores"))
        box.destroy()  # the scores are written: driver, executors and Python workers can let the filter go
    done = parts[0].drop("tail")
    for part in parts[1:]:  # rows are met again by id and text; those that repeat have equal scores
        more = part.groupBy(F.col("id").alias("i"), F.col("check").alias("c")).agg(F.first("score").alias("more"))
        done = done.join(more, F.col("id").eqNullSafe(F.col("i")) & (F.col("check") == F.col("c")), "left").withColumn("score", F.col("score") + F.col("more")).drop("i", "c", "more")
    # Tokens of rarer words, of all passes.  A pass holds those of a row as often as the row repeats.
    tails = reduce(DataFrame.unionByName, [part.select("id", "check", F.inline("tail")) for part in parts])
    counts = _word_counts(merged, 1, hot_level).select("h", F.col("c").alias("seen"))
    c = F.coalesce("seen", F.lit(0)) + 1.0
    rare = tails.join(counts, "h", "left").groupBy(F.col("id").alias("i"), F.col("check").alias("c")).agg(F.count("seen").alias("rare_known"), F.sum(F.log10(c)).alias("rare_base"), F.sum(F.log10(F.col("a") + F.col("b") * (c / mass))).alias("rare_score"))
    times = parts[0].groupBy(F.col("id").alias("j"), F.col("check").alias("d")).agg(F.count("*").alias("times"))
    rare = rare.join(times, F.col("i").eqNullSafe(F.col("j")) & (F.col("c") == F.col("d"))).select("i", "c", *[(F.col(x) / F.col("times")).alias(x) for x in ("rare_known", "rare_base", "rare_score")])
    out = done.join(rare, F.col("id").eqNullSafe(F.col("i")) & (F.col("check") == F.col("c")), "left")
    drop_cut(histories)
    floor = math.log10(model.n_train + model.n_distinct + 1)
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))

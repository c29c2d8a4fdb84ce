"""Quality by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks (256 bytes, every 128) that cover all of it.  Learned filters over a few
neighbouring embedded bytes give, for every chunk, the largest response of each filter; a text's features are the
mean and the maximum of its chunks' responses and the logarithm of its length, and a logistic layer makes one
probability of them.  Besides the byte itself a filter sees whether the bytes before it, eight at a time, have
occurred earlier in the text's neighbourhood, so repetition is visible to filters a few bytes wide.

The network is trained by Adam with gradients through the maxima, on a bounded sample of labelled rows
(``fit_rows`` rows, at most ``fit_bytes`` bytes), and then applied to whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc_mod, cut, mix64, table, text_check, texts_of, without

SEGMENT, WIDTH, DIM, FILTERS = 128, 5, 6, 16
_REPEAT = 8  # bytes that must recur for a byte to count as repeated


def symbols(text: bytes, step: int = 1 << 18) -> np.ndarray:
    """Bytes 0-255, plus 256 where the last eight bytes occurred before in the text at the same 4096-byte window.

    Windows don't touch, so ``step`` (a multiple of 4096) bounds memory and changes nothing.
    """
    raw = np.frombuffer(text, np.uint8)
    b = raw.astype(np.int16)
    if len(b) <= _REPEAT:
        return b
    n = len(b) - _REPEAT + 1
    for i in range(0, n, step):
        v = np.lib.stride_tricks.sliding_window_view(raw[i : min(n, i + step) + _REPEAT - 1], _REPEAT)
        h = mix64(np.ascontiguousarray(v).view(np.uint64).reshape(-1)) >> np.uint64(44)
        h = (h.astype(np.int64) << 20) | np.arange(len(h)) >> 12
        _, first = np.unique(h, return_index=True)
        again = np.ones(len(h), bool)
        again[first] = False
        b[i + _REPEAT - 1 : i + _REPEAT - 1 + len(h)] += again * np.int16(256)
    return b


@dataclass
class Network:
    embed: np.ndarray  # (513, DIM); 512 is the padding
    filters: np.ndarray  # (WIDTH * DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (2 * FILTERS + 2,)

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        f = np.float32
        return cls(r.normal(0, 0.5, (513, DIM)).astype(f), r.normal(0, 0.4, (WIDTH * DIM, FILTERS)).astype(f), np.zeros(FILTERS, f), np.zeros(2 * FILTERS + 2, f))

    def tables(self) -> np.ndarray:
        """(WIDTH, 513, FILTERS): what each symbol adds at each place of a filter."""
        return np.einsum("sd,kdf->ksf", self.embed, self.filters.reshape(WIDTH, DIM, FILTERS)).astype(np.float32)

    def segments(self, s: np.ndarray, tables: np.ndarray, step: int = 1 << 18) -> Iterator[np.ndarray]:
        """Responses are taken ``step`` symbols at a time (a multiple of SEGMENT): yields (segment, place, filter) blocks."""
        n = max(1, -(-len(s) // SEGMENT)) * SEGMENT
        s = np.concatenate((s, np.full(n + WIDTH - 1 - len(s), 512, s.dtype)))
        for i in range(0, n, step):
            size = min(step, n - i)
            r = tables[0][s[i : i + size]]
            for k in range(1, WIDTH):
                r += tables[k][s[i + k : i + k + size]]
            yield r.reshape(-1, SEGMENT, FILTERS)

    def chunk_peaks(self, s: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each chunk (two neighbouring segments)."""
        peak = np.concatenate([r.max(axis=1) for r in self.segments(s, tables)])
        peak = np.maximum(peak[:-1], peak[1:]) if len(peak) > 1 else peak
        return np.maximum(peak + self.bias, 0)

    def chunk_places(self, s: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Peaks, the places of the largest responses, and the symbols with their padding."""
        seg = np.concatenate(list(self.segments(s, tables)))
        s = np.concatenate((s, np.full(seg.shape[0] * SEGMENT + WIDTH - 1 - len(s), 512, s.dtype)))
        at = seg.argmax(axis=1)
        peak = np.take_along_axis(seg, at[:, None, :], 1)[:, 0]
        at += np.arange(len(peak))[:, None] * SEGMENT
        if len(peak) > 1:
            right = peak[1:] > peak[:-1]
            peak, at = np.where(right, peak[1:], peak[:-1]), np.where(right, at[1:], at[:-1])
        return np.maximum(peak + self.bias, 0), at, s

    def features(self, peaks: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate((peaks.mean(axis=0), peaks.max(axis=0), [np.log1p(n) / 8, 1.0])).astype(np.float32)

    def score(self, text: bytes, tables: np.ndarray | None = None) -> float:
        tables = self.tables() if tables is None else tables
        s = symbols(text)
        x = self.features(self.chunk_peaks(s, tables), len(s))
        return float(1 / (1 + np.exp(-np.clip(x @ self.out, -30, 30))))


def train(texts: list[bytes], labels: np.ndarray, *, epochs: int = 8, rate: float = 0.02, batch: int = 16, seed: int = 7) -> Network:
    net, rng = Network.new(seed), np.random.default_rng(seed)
    share = min(max(float(np.mean(labels)), 0.01), 0.99) if len(labels) else 0.5
    net.out[-1] = np.log(share / (1 - share))
    coded = [symbols(t) for t in texts]
    params = [net.embed, net.filters, net.bias, net.out]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(coded))
        for i in range(0, len(order), batch):
            grads = [np.zeros_like(p) for p in params]
            tables = net.tables()
            for d in order[i : i + batch]:
                peaks, at, s = net.chunk_places(coded[d], tables)
                x = net.features(peaks, len(coded[d]))
                g = (1 / (1 + np.exp(-np.clip(x @ net.out, -30, 30))) - labels[d]) / batch
                grads[3] += g * x
                top = peaks.argmax(axis=0)
                up = np.broadcast_to(g * net.out[:FILTERS] / len(peaks), peaks.shape).copy()
                up[top, np.arange(FILTERS)] += g * net.out[FILTERS : 2 * FILTERS]
                up *= peaks > 0
                grads[2] += up.sum(axis=0)
                near = s[at[:, :, None] + np.arange(WIDTH)]  # (chunk, filter, place)
                seen = net.embed[near].reshape(*at.shape, WIDTH * DIM)
                grads[1] += np.einsum("cf,cfx->xf", up, seen)
                back = (up[:, :, None] * net.filters.T[None]).reshape(-1, DIM)
                flat = near.reshape(-1)
                for k in range(DIM):
                    grads[0][:, k] += np.bincount(flat, back[:, k], 513)
            step += 1
            lr = rate * (1 - epoch / (epochs + 1))
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str, text_col: str, held: tuple[int, int], rows: int, most_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """At most ``rows`` labelled texts and ``most_bytes`` bytes, lowest hash of the id first, none held out.

    Lengths are looked at first: only the chosen texts leave the tables.  Of rows that share an id, one text is taken.
    """
    known = labels.where(F.col(label).isNotNull() & (crc_mod(id_col, held[0]) != held[1])).select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("__y"))
    known = known.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(2 * rows)
    texts = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    sizes = texts.select("__doc", F.octet_length("t").alias("n"), F.xxhash64("t").alias("check"))
    sizes = sizes.join(F.broadcast(known), F.col("__doc") == F.col("__id")).groupBy("__id").agg(F.first("__y").alias("y"), F.min(F.struct("check", "n")).alias("least"))
    size, picked = 0, []
    for r in sizes.select("__id", "y", "least.check", "least.n").orderBy(F.xxhash64("__id"), "__id").collect():  # at most 2 * rows
        if len(picked) < rows and size + r.n <= most_bytes:
            size += r.n
            picked.append((r["__id"], r.check, r.y, len(picked)))
    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("check", T.LongType()), T.StructField("y", T.DoubleType()), T.StructField("n", T.LongType())])
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, schema))
    found = texts.join(chosen, (F.col("__doc") == F.col("__id")) & (F.xxhash64("t") == F.col("check"))).groupBy("n").agg(F.first("y").alias("y"), F.first("t").alias("t"))
    got = sorted(((r.n, r.y, r.t.encode()) for r in found.toLocalIterator()), key=lambda r: r[0])
    return [t for _, _, t in got], np.array([y for _, y, _ in got], dtype=np.float64)


def _scores(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, held_mod: int, held_is: int, threshold: float, fit_rows: int, fit_bytes: int) -> DataFrame:
    """(id, check, held_out, score, predicted) of every row, written."""
    texts, ys = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, held=(held_mod, held_is), rows=fit_rows, most_bytes=fit_bytes)
    net = train(texts, ys)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tables = shared.value, shared.value.tables()
        for batch in batches:
            scores = [net.score(t, tables) for t in texts_of(batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(scores, pa.float64())], ["id", "check", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), text_check(text_col).alias("check"), (crc_mod(id_col, held_mod) == held_is).alias("held_out"), F.col(text_col).alias("t"))
    with bounded_batches(docs.sparkSession):
        out = cut(rows.mapInArrow(kernel, f"id {rows.schema['id'].dataType.simpleString()}, check long, held_out boolean, score double"), "quality")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_mod: int = 4, held_is: int = 2, threshold: float = 0.7, fit_rows: int = 1200, fit_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: id, held_out, score, predicted (score >= threshold).

    ``fit_rows`` and ``fit_bytes`` bound the labelled sample that the network is fitted on; scores cover all rows and
    whole texts.  Null texts are scored as empty; without labels all texts score 0.5; repeated rows get equal scores;
    an empty table is empty.  Labels, languages, sources and ids are no input of a score.
    """
    found = _scores(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, held_mod=held_mod, held_is=held_is, threshold=threshold, fit_rows=fit_rows, fit_bytes=fit_bytes)
    return found.select(F.col("id").alias(id_col), "held_out", "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_mod: int = 4, held_is: int = 2, threshold: float = 0.7, fit_rows: int = 1200, fit_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    The decision is joined back by id and text: rows of one id with different texts are judged each by its own text.
    Without labels nothing is known to reject, and all rows stay.
    """
    if labels.where(F.col(label_col).isNotNull()).limit(1).count() == 0:
        return docs
    found = _scores(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, held_mod=held_mod, held_is=held_is, threshold=threshold, fit_rows=fit_rows, fit_bytes=fit_bytes)
    return without(docs, found.where("predicted = 0"), id_col, text_col)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

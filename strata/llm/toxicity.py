"""Toxicity scores behind a noisy channel.

A token that looks disguised (letters next to digits or signs that stand for letters, letters held down, letters set
apart by spaces or points) is a lattice: each sign may be itself or a letter it stands for, a repeated letter may be
dropped, a separator may be dropped.  A Viterbi search finds the most likely reading under a character trigram
model of all documents.  Words as written and words as restored are then looked up in weights of word stems learned
from labelled texts, and a logistic layer turns a text's strongest evidence into a probability.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bounded_batches, crc_mod, cut, table, texts_of
from .quality import labelled_sample

#: What a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = "._-*~'’ \t"
_SIGNS = re.escape("".join(STANDS_FOR))
_L = "a-zß-öø-ÿ"
DISGUISED = re.compile(rf"[{_L}][{_SIGNS}]|[{_SIGNS}][{_L}]|([{_L}])\1\1|[{_L}][._*~'’-]+[{_L}][._*~'’-]+[{_L}]")
EDGE = b".,;:!?\"'()[]{}<>|*#%&$~-_=/\\"
_EDGES = f"[{re.escape(EDGE.decode())}]*"
#: Group 1: letters or signs alone between blanks, without punctuation before the first and after the last.
SPACED = re.compile(rf"(?<!\S){_EDGES}(\S(?:[ \t]+\S){{2,}}){_EDGES}(?!\S)")
A = 60  # symbols: 0 edge or non-letter, 1-26 a-z, 27-58 U+00E0-U+00FF, 59 other letters


def _symbol_table() -> np.ndarray:
    t = np.zeros(1 << 16, np.int32)
    for c in range(1 << 16):
        ch = chr(c).lower() if not 0xD800 <= c < 0xE000 else " "
        o = ord(ch[0])
        t[c] = o - 96 if 97 <= o <= 122 else o - 0xE0 + 27 if 0xE0 <= o <= 0xFF and o != 0xF7 else 59 if ch.isalpha() else 0
    return t


def char_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(c | two before) over all documents, as an A x A x A array (smoothed by pairs)."""
    symbol = docs.sparkSession.sparkContext.broadcast(_symbol_table())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(A**3, np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                codes = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                s = np.concatenate(([0, 0], symbol.value[np.minimum(codes, 0xFFFF)], [0]))
                seen += np.bincount((s[:-2] * A + s[1:-1]) * A + s[2:], minlength=A**3)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    with bounded_batches(docs.sparkSession):
        found = docs.select(text_col).mapInArrow(kernel, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most A^3 rows
    n = np.zeros(A**3)
    n[found["at"].to_numpy()] = found["n"].to_numpy()
    n = n.reshape(A, A, A)
    two = n.sum(axis=0)
    low = (two + 0.1) / (two.sum(axis=1, keepdims=True) + 0.1 * A)
    return np.log((n + 5 * low[None]) / (n.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def decode(token: str, model: np.ndarray, symbol: np.ndarray, swap: float = -1.0, drop: float = -0.3) -> str:
    """Most likely plain reading of a disguised token.  ``swap``, ``drop``: log costs of a stand-in and a left-out sign.

    States are the last two letters; a sign has at most three readings, so the search is linear in the token.
    """
    states = {(0, 0): (0.0, None)}
    before = ""
    for ch in token.lower():
        o = symbol[min(ord(ch), 0xFFFF)]
        options = [(int(o), ch if o else " ", 0.0)]
        if not o:
            options = [(0, " ", -5.0)] + [(int(symbol[ord(x)]), x, swap) for x in STANDS_FOR.get(ch, "")]
        may_drop = ch == before and o or ch in SEPARATORS
        after: dict = {}
        for (p, q), (cost, path) in states.items():
            for code, out, price in options:
                c = cost + price + float(model[p, q, code])
                if (q, code) not in after or after[q, code][0] < c:
                    after[q, code] = (c, (path, out))
            if may_drop and ((p, q) not in after or after[p, q][0] < cost + drop):
                after[p, q] = (cost + drop, path)
        states, before = after, ch
    _, path = max(((cost + float(model[p, q, 0]), path) for (p, q), (cost, path) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        path, ch = path
        out.append(ch)
    return "".join(reversed(out))


def stems(word: bytes) -> list[bytes]:
    """Beginnings of 4 to 7 bytes, and the whole word with a mark."""
    return [word[:k] for k in range(4, min(8, len(word) + 1))] + [word + b"\x00"]


class WordEvidence(dict):
    """Word as written -> strongest weight of any stem of its readings; kept for up to ``limit`` words."""

    def __init__(self, weights: dict[bytes, float], model: np.ndarray, symbol: np.ndarray, limit: int = 300_000):
        super().__init__()
        self.weights, self.model, self.symbol, self.limit = weights, model, symbol, limit

    def readings(self, word: bytes) -> list[bytes]:
        plain = word.strip(EDGE)
        out = [plain]
        text = word.decode("utf-8", "replace")
        if DISGUISED.search(text):
            out += decode(text, self.model, self.symbol).encode().split()
        if shorter := re.sub(rb"([a-z])\1", rb"\1", plain):
            out.append(shorter)
        return out

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        get = self.weights.get
        value = self[word] = max((get(s, 0.0) for r in self.readings(word) for s in stems(r)), default=0.0)
        return value


def text_words(text: bytes, model: np.ndarray, symbol: np.ndarray) -> set[bytes]:
    """Distinct lower-cased words, and the readings of letters set apart by blanks."""
    text = text.translate(LOWER)
    words = set(text.split())
    for m in SPACED.finditer(text.decode("utf-8", "replace")):
        words.update(decode(m[1], model, symbol).encode().split())
        words.add("".join(m[1].split()).encode())
    return words


def evidence(values: list[float], n: int) -> np.ndarray:
    top = heapq.nlargest(3, values)
    top += [0.0] * (3 - len(top))
    return np.array([top[0], top[1], top[2], math.log1p(n) / 8, 1.0])


def fit(texts: list[bytes], ys: np.ndarray, model: np.ndarray, symbol: np.ndarray) -> tuple[dict[bytes, float], np.ndarray]:
    """Weights of stems, and of the logistic layer (fitted on evidence that leaves each text's own counts out)."""
    reader = WordEvidence({}, model, symbol)
    # Of texts that aren't toxic only stems that toxic ones have are kept: for most words that is one shared empty set.
    read: dict[bytes, frozenset] = {}
    may: set[bytes] | None = None

    def of(text: bytes) -> tuple[set[bytes], int]:
        words, out = text_words(text, model, symbol), set()
        for w in words:
            if w not in read:
                read[w] = frozenset(s for r in reader.readings(w) for s in stems(r) if may is None or s in may)
            out |= read[w]
        return out, len(words)

    bad, good, sizes = Counter(), Counter(), []
    per = {}
    for i in np.flatnonzero(ys > 0.5):
        per[i] = of(texts[i])
        bad.update(per[i][0])
    may = {s for s, n in bad.items() if n >= 3}
    read.clear()
    per = {i: (found & may, n) for i, (found, n) in per.items()}
    for i in np.flatnonzero(ys <= 0.5):
        per[i] = of(texts[i])
        good.update(per[i][0])
    n_bad, n_good = int((ys > 0.5).sum()), int((ys <= 0.5).sum())

    def weight(a: int, b: int) -> float:
        return max(0.0, math.log((a + 0.5) / (n_bad + 1)) - math.log((b + 0.5) / (n_good + 1))) if a >= 3 else 0.0

    rows = []
    for i in range(len(ys)):
        toxic = ys[i] > 0.5
        found, n = per[i]
        rows.append(evidence([weight(bad[s] - toxic, good[s] - (not toxic)) for s in found & may], n))
    x = np.array(rows).reshape(-1, 5)
    beta = np.zeros(5)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(5) * 0.1
        beta -= np.linalg.solve(hess, x.T @ (p - (ys > 0.5)) + 0.1 * beta)
    weights = {s: w for s in may if (w := weight(bad[s], good[s])) > 0.5}
    return weights, beta


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_mod: int = 5, held_is: int = 0, threshold: float = 0.5, fit_rows: int = 6000, fit_bytes: int = 24 << 20) -> DataFrame:
    """One row per document: id, held_out, score, predicted (score >= threshold).

    ``fit_rows`` and ``fit_bytes`` bound the labelled sample of the fit; the character model covers all documents and
    every whole text is scored.  Null texts are empty and have a score too; repeated rows get equal scores; an empty
    table is empty; without labels all texts get the same score.  Labels, languages, sources and ids are no input.
    """
    spark = docs.sparkSession
    model, symbol = char_model(docs, text_col), _symbol_table()
    texts, ys = labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, held=(held_mod, held_is), rows=fit_rows, most_bytes=fit_bytes)
    weights, beta = fit(texts, ys, model, symbol)
    shared = spark.sparkContext.broadcast((weights, beta, model, symbol))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, beta, model, symbol = shared.value
        known = WordEvidence(weights, model, symbol)
        for batch in batches:
            scores = []
            for text in texts_of(batch.column(1)):
                words = text_words(text, model, symbol)
                x = evidence([v for v in map(known.__getitem__, words) if v], len(words))
                scores.append(float(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], ["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), (crc_mod(id_col, held_mod) == held_is).alias("held_out"))
    with bounded_batches(spark):
        out = cut(rows.mapInArrow(kernel, f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double"), "toxicity")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

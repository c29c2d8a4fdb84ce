"""Counts and base scores against a recount; probabilities sum to one over the next token."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from strata.llm import lm_score
from strata.llm.common import word_hashes, words_of


def corpus(n=400, vocabulary=900, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    rows = [(i, " ".join(rnd.choices(words, weights, k=rnd.randrange(120)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "Never SEEN\tbefore\x0bW1"), (None, "w1 w2 w3"), (5, rows[5][1]), (n + 3, "w1 " * 30000)]


def brute(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score) per row."""
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    tokens = lambda t: [*"".join(c.lower() if c.isascii() else c for c in t or "").split(), None]
    seen = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    out = []
    for i, t in rows:
        ws = tokens(t)
        out.append((held(i), len(ws), sum(seen[w] > 0 for w in ws), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws)))
    return out


@pytest.mark.parametrize("how", [{}, {"hot_words": 20}, {"max_filter_bytes": 3000, "hot_words": 0, "flush": 1000}])
def test_base_columns_against_a_recount(spark, how):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lm_score.lm_scores(docs, **how).collect()
    key = lambda x: (str(x[0]), x[2], x[5])
    want = sorted(((i, *b) for (i, _), b in zip(rows, brute(rows), strict=True)), key=key)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert np.allclose([h[5] for h in have], [w[5] for w in want])
    assert all(r.score < 0 for r in got)


def _model(spark, rows, **how):
    train = spark.createDataFrame(rows, "doc_id long, t string").select("t").repartition(3)
    settings = {"bits_each": 24.0, "model_words": 500_000, "flush": 5000, "max_filter_bytes": 1 << 30} | how
    model, merged, histories, passes, _ = lm_score.train_model(train, **settings)
    return model, [lm_score.load_pass(model, merged, histories, *p) for p in passes]


@pytest.mark.parametrize("hot", [500_000, 50])
def test_probabilities_sum_to_one(spark, hot):
    rows = [(i, t) for i, t in corpus() if i is not None]
    model, (whole,) = _model(spark, rows, model_words=hot)
    names = sorted({w for _, t in rows for w in (t or "").lower().split()})
    hashes = lambda words: word_hashes(pa.array(words))[0]
    every = np.append(hashes([*names, "unknown-word"]), lm_score.END)
    assert whole.word_probabilities(every).sum() == pytest.approx(1)
    sums = []
    for h in [*names[:150], "no-such-history"]:
        before = np.full(len(every), hashes([h])[0], np.uint64)
        z, n = whole.history(before)
        p = whole.probabilities(before, every, whole.word_probabilities(every), z, n, model.blocks.of(before, lm_score._pairs(before, every)))
        assert p.min() > 0
        sums.append(p.sum())
    # A pair that the filter takes for seen by mistake adds what its expected number took away elsewhere.
    assert sums[-1] == pytest.approx(1) and sums == pytest.approx([1] * len(sums), abs=0.1) and np.mean(sums) == pytest.approx(1, abs=0.01)


def test_passes_agree_and_common_pairs_score_higher(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = lm_score.lm_scores(docs).orderBy("doc_id", "n_tokens").toPandas()
    many = lm_score.lm_scores(docs, max_filter_bytes=4000).orderBy("doc_id", "n_tokens").toPandas()
    assert np.allclose(one.score, many.score, rtol=1e-6)
    assert one.score.sum() > one.base_score.sum()


def test_counts_read_back(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 64, 50_000, np.uint64)
    counts = np.random.default_rng(2).integers(1, 5000, 50_000)
    data = lm_score.build_filter(keys, counts, 24.0)
    f = lm_score.Filter({3: data}, 3, 4)
    got = f.levels(keys, np.full(len(keys), 3))
    assert (got >= lm_score._levels(counts)).all() and (got == lm_score._levels(counts)).mean() > 0.999
    wrong = (f.levels(np.random.default_rng(3).integers(0, 1 << 64, 1_000_000, np.uint64), np.full(1_000_000, 3)) > 0).mean()
    assert wrong < 5e-4 and 0.7 < wrong / lm_score.filter_error(data) < 1.4


def test_word_hashes_stand_for_words():
    rnd = random.Random(4)
    texts = [None, "", " \t", "a", "A  b\x0bB\x85c\u00a0d é É", "x" * 3_000_000, *("".join(rnd.choices("abAB \n\x00é", k=rnd.randrange(60))) for _ in range(3000))]
    column = pa.array(["skipped", *texts])[1:]
    words = [words_of((t or "").encode()) for t in texts]
    for step in (1 << 20, 50):
        got, n = word_hashes(column, step=step)
        assert n.tolist() == [len(w) for w in words]
        flat = [w for ws in words for w in ws]
        seen = {}
        assert all(seen.setdefault(w, h) == h for w, h in zip(flat, got.tolist(), strict=True)) and len(set(seen.values())) == len(seen)

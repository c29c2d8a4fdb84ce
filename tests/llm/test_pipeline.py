"""Stages of the corpus pipeline against plain recounts, each on what the one before it kept."""

from collections import defaultdict

import corpus_pipeline
import pandas as pd
import pytest
from strata.llm.decontaminate import split_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, kept = corpus_pipeline.table(spark, SF, "documents"), []
    kept.append(docs.toPandas())
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), name)
        kept.append(docs.toPandas())
    return kept


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "mix"]
    for part in stages[1:-1]:
        assert list(part.columns) == list(stages[0].columns)
    for a, b in zip(stages, stages[1:], strict=False):
        assert set(b.doc_id) <= set(a.doc_id) and 0 < len(b) <= len(a)


def test_quality(stages):
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    kept = [i in set(stages[1].doc_id) for i in labels.index]
    assert (pd.Series(kept, labels.index) == (labels == 1)).mean() > 0.8  # some 90 labels


def test_exact(stages):
    least = stages[1].assign(text=stages[1].text.fillna("")).groupby("text").doc_id.min()
    assert set(stages[2].doc_id) == set(least)


def test_near(stages):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {int(i): shingles(t) for i, t in zip(stages[2].doc_id, stages[2].text, strict=True)}
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for pair in {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b}:
        a, b = (sets[i] for i in pair)
        if len(a & b) >= 0.8 * len(a | b):
            x, y = sorted(map(find, pair))
            root[y] = x
    assert set(stages[3].doc_id) == {i for i in sets if find(i) == i}


def test_benchmark(stages):
    windows = set()
    for t in pd.read_parquet(f"{SF}/benchmark.parquet").text:
        w = split_words((t or "").encode())
        k = min(13, len(w))
        windows |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k}
    clean = set()
    for i, t in zip(stages[3].doc_id, stages[3].text, strict=True):
        w, hit = split_words((t or "").encode()), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert set(stages[4].doc_id) == clean


def test_mix_and_run(spark, stages):
    last = stages[5]
    assert last.copies.between(1, 3).all()
    ran = corpus_pipeline.run(spark, SF).toPandas()
    assert dict(zip(ran.doc_id, ran.copies, strict=True)) == dict(zip(last.doc_id, last.copies, strict=True))


def test_empty_and_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, __id string, copies int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
    odd = spark.createDataFrame([(5, "text a is here", None), (4, "text a is here", "x"), (5, "another text b", "x"), (None, None, "x"), (6, "", "x"), (6, "", "x")], "doc_id long, text string, source string")
    assert sorted(str(r.doc_id) + str(r.text) for r in corpus_pipeline.near(spark, odd, SF).collect()) == sorted(["4text a is here", "5another text b", "NoneNone", "6", "6"])
    assert sorted(r.doc_id for r in corpus_pipeline.exact(spark, odd, SF).collect()) == [4, 5, 6]
    assert corpus_pipeline.benchmark(spark, odd, SF).count() == 6

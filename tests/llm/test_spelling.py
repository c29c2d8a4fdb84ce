"""Spelling variants against a comparison of all words with all."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from strata.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts):
    """word -> (form, root, n, n_near, form_n) by comparing the words that share a text with one letter less."""
    less, near, form = defaultdict(set), defaultdict(set), {}
    for w in counts:
        for k in range(len(w) + 1):
            less[w[:k] + w[k + 1 :]].add(w)
    for group in less.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * n:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def words_of(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    return {w: n for w, n in counts.items() if n >= 2}


def result(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(S.op13_spelling(spark, sf)) == plain(words_of(rows))


@pytest.mark.parametrize(("most", "alphabet"), [(16, "ab"), (512, "aß漢𐍈")])
def test_words_alike_in_groups_of_any_size(spark, most, alphabet):
    rng = random.Random(most)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.choice([6, 7, 7, 8, 9, 12]))) for _ in range(250)}
    words |= {w[: len(w) // 2] + rng.choice(alphabet) + w[len(w) // 2 :] for w in sorted(words)[:60]} | {"a" * 7, "a" * 8, "a" * 9, "a" * 30, "a" * 31, "a" * 15 + "b" + "a" * 14}
    counts = {w: rng.choice([2, 3, 20, 25, 200, 3000, 30_000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    want = plain({w: n for w, n in counts.items() if len(w) >= 7}) | {w: (None, w, n, 0, None) for w, n in counts.items() if len(w) < 7}
    assert result(S.spelling_forms(df, most=most)) == want


def test_chains_lead_to_their_roots(spark):
    chain = ["abcdefg" + "hijklmnopqrst"[:k] for k in range(8)]
    counts = {w: 2 * 10**k for k, w in enumerate(chain)}
    got = result(S.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert {r[1] for r in got.values()} == {chain[-1]} and got == plain(counts)


def test_nulls_repeats_clashing_names_and_empty_tables(spark, tmp_path):
    texts = ["", None, "Straßen straßen STRAßEN stra", "ÉCOLIÈRE écolière École", "x" * 1_000_000, "x" * 1_000_000, "ab " * 200_000, "wonderful wonderful wonderfull wonderfull " * 30]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)] * 2 + [(n, "beautiful beutiful") for n in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("c", F.lit(0))
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    assert result(S.op13_spelling(spark, str(tmp_path))) == plain(words_of(rows))
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    assert result(S.op13_spelling(spark, f"{tmp_path}/none")) == {}
    with pytest.raises(ValueError, match="halves"):
        S.near_words(df, least=3)

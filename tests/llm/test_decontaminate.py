"""Phrase and proximity matches of the positional index against brute force."""

import math
import random

import pytest
from strata.llm.decontaminate import decontaminate, keep_clean, split_words


def brute(texts, items, window=13, slack=3, share=0.8):
    """(n_words, n_hit, items, near) per text."""
    out = []
    for t in texts:
        ws = split_words((t or "").encode())
        hit, found, near = set(), set(), set()
        for i, text in items:
            it = split_words((text or "").encode())
            k = min(window, len(it))
            for j in range(len(it) - k + 1 if it else 0):
                w = it[j : j + k]
                at = [p for p in range(len(ws) - k + 1) if ws[p : p + k] == w]
                for p in at:
                    hit.update(range(p, p + k))
                    found.add("" if i is None else str(i))
                need = math.ceil(share * len(set(w)) - 1e-9)
                if not at and len(set(w)) > 1:
                    starts = [p for p in range(len(ws)) if len(set(ws[p : p + k + slack]) & set(w)) >= need]
                    # a stretch is the earliest that has enough, also one that its document's beginning cuts off
                    if starts:
                        near.add(("" if i is None else str(i), j, min(starts)))
        out.append((len(ws), len(hit), sorted(found), sorted(near)))
    return out


def both(spark, texts, items, **how):
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"]), sorted((x.item, x.place, x.start) for x in r.near)) for r in decontaminate(docs, bench, **how).collect()}
    return [got[n] for n in range(len(texts))], brute(texts, items)


@pytest.mark.parametrize("how", [{}, {"block_bytes": 300}])
def test_against_brute_force(spark, how):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefgh") * rnd.randrange(1, 5)
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 25, 13, 14, 5, 2, 1, 30])]
    items += [(None, "x y z"), (20, None), (21, " ,. "), (22, "qqq " * 6 + "not in any text at all of these documents")]
    texts = [None, "", "..", "A aa"]
    for _ in range(60):
        ws = [word() for _ in range(rnd.randrange(80))]
        src = rnd.choice(items[:8])[1].split()
        a = rnd.randrange(len(src))
        part = src[a : a + rnd.randrange(1, 30)]
        for _ in range(rnd.randrange(4)):  # words of the passage changed, to ones that no other text has, or left out
            at = rnd.randrange(len(part)) if part else 0
            part[at : at + 1] = rnd.choice([[f"new{rnd.random()}"], [], [word()]])
        at = rnd.randrange(len(ws) + 1)
        texts.append(" ".join(ws[:at] + part + ws[at:]))
    got, want = both(spark, texts, items, **how)
    assert got == want
    assert sum(len(w[3]) for w in want) > 50 and sum(w[1] > 0 for w in want) > 20


def test_a_word_that_no_document_has_hides_no_proximity(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    got, want = both(spark, [base + " thirteen"], [(1, base + " zebra")])
    assert got == want and len(got[0][3]) == 1


def test_repeated_rows_and_rows_that_share_an_id(spark):
    item = "a b c d e f g h i j k l m n"
    docs = spark.createDataFrame([(1, item), (1, item), (1, "clean text"), (None, item), (2, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = decontaminate(docs, bench).where("contaminated").collect()
    assert len(rows) == 3 and len({(r.n_hit, r.n_near, tuple(r["items"])) for r in rows}) == 1
    assert sorted(r.text for r in keep_clean(docs, bench).collect()) == ["clean text", "other"]
    assert keep_clean(docs, bench.where("false")).count() == 5

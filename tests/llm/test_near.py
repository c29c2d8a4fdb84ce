"""Near copies of the pipeline: five-word shingles at similarity 0.8, against brute force."""

import random

from strata.llm.near import keep_one_of_near, near_components


def _sets(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_stage_links_all_pairs_of_the_similarity(spark):
    import corpus_pipeline

    rnd = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([40, 150, 400]))]
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 5, 8):  # from close copies to texts below the similarity, and chains of edits
            for _ in range(changes):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(words))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [_sets(x) for x in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i: find(i) for i in range(len(texts))}
    assert 12 < len(set(want.values())) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_components(docs).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == set(want.values())


def test_near_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "One two"), (4, "one  two"), (5, "two one"), (None, "one two"), (3, "One two")]
    kept = keep_one_of_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id) for r in kept)) == ["1", "3", "3", "5", "None"]
    assert keep_one_of_near(spark.createDataFrame([], "doc_id long, text string")).count() == 0

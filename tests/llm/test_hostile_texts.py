"""Every operator on texts of a megabyte that try recursion, backtracking and wide windows."""

import pytest
from strata.llm import decontaminate, exact_dedup, lm_score, mixing, near, quality, secrets, simhash, surrogates, token_counts, toxicity

N = 1_000_000
TEXTS = ["x@a" + ".b" * (N // 2), "Mr " + "Aa " * (N // 3), "Mr " + "A. " * (N // 3) + "Smith", "a" * N, "s p a c e d " * (N // 12), "token=" * (N // 6), "1.2." * (N // 4), "\u0001\u0002\u0003" * 1000, "é" * (N // 2)]
#: For the rules of secrets alone: many matches, or many beginnings of one.
SECRETS = ["eyJ", "eyJaaaaaaaaa.", "-----BEGIN ", "ghp_", "xoxb-aaaaaaaaaaa ", "token=aaaaaa ", "AKIA" + "A" * 20 + " ", "0123456789abcdef"]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, i // 2 % 2) for i in range(9)], "doc_id long, quality int, toxic int")
    return docs, labels, spark.createDataFrame([(1, "aa aa aa aa aa aa aa aa aa aa aa aa aa aa"), (2, "p a c")], "item_id long, text string")


def test_whole_results(tables):
    import public_tokenizers

    docs, labels, bench = tables
    outs = {
        "simhash": simhash.simhash_components(docs),
        "near": near.near_components(docs),
        "lm": lm_score.lm_scores(docs),
        "mix": mixing.mix_to_targets(docs),
        "secrets": secrets.scan_versions(docs),
        "decontaminate": decontaminate.decontaminate(docs, bench),
        "surrogates": surrogates.replace_personal_data(docs),
        "tokens": token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")),
        "toxicity": toxicity.score_toxicity(docs, labels),
        "exact": exact_dedup.exact_dedup(docs),
        "quality": quality.score_quality(docs, labels),
    }
    got = {name: {r.doc_id: r for r in out.collect()} for name, out in outs.items()}
    assert {name: len(r) for name, r in got.items()} == dict.fromkeys(outs, len(TEXTS))
    assert got["lm"][1].n_tokens == N // 3 + 2 and got["mix"][1].size == N // 3 + 1
    assert got["decontaminate"][1].n_hit == N // 3 and got["decontaminate"][4].n_hit == 3 * (N // 12)
    assert "Smith" not in got["surrogates"][2].text and not got["surrogates"][0].text.startswith("x@a") and got["surrogates"][7].text == TEXTS[7]
    assert got["tokens"][3].n_bytes == N


def test_secret_rules_on_texts_made_for_them(spark):
    texts = [t * (N // len(t)) for t in SECRETS]
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in secrets.scan_versions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert [len(got[i]) for i in (0, 2, 3, 4, 5, 6, 7)] == [0, 0, 0, N // 17, N // 13, N // 25, 1]
    assert got[5][:2] == [(0, 0, 12), (13, 0, 25)] and got[5][-1][2] == 13 * (N // 13) - 1 and got[7] == [(0, 2, N)]

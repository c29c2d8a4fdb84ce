"""Corpus operators on small tables: nulls, empty texts, repeats, empty tables, extra columns; brute force where SQL
can't say it."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strata.llm import decontaminate, exact_dedup, lm_score, mixing, quality, secrets, simhash, surrogates, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, h long, digest string, row int"
TEXTS = ["the quick brown fox jumps over the lazy dog again and again", "the quick brown fox jumps over the lazy dog again and again", None, "", "one", "a b c d e " * 40, 'password = "abcdef123456" mail a.b@mail.example.com', "you st00pid clown " * 3, "été ñandú ß " * 5, "the quick brown fox jumps over the lazy dog again and more"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, x, "en", [None, "s0", "s1"][i % 3], 0, "i", "t", 1, "d", 2) for i, x in enumerate(TEXTS)]
    return spark.createDataFrame(rows + [rows[0], (None, "no id", None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 4), int(i == 7)) for i in range(10)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "Quick, brown FOX jumps over the lazy dog again and again and"), (2, "ONE"), (3, None), (4, "")], "item_id long, text string")


def everything(docs, labels, bench):
    import public_tokenizers

    yield simhash.simhash_components(docs)
    yield lm_score.lm_scores(docs)
    yield mixing.mix_to_targets(docs)
    yield secrets.scan_versions(docs)
    yield decontaminate.decontaminate(docs, bench)
    yield surrogates.replace_personal_data(docs)
    yield token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    yield toxicity.score_toxicity(docs, labels)
    yield exact_dedup.exact_dedup(docs)
    yield quality.score_quality(docs, labels)


def test_one_row_each(docs, labels, bench):
    for out in everything(docs, labels, bench):
        assert out.count() == 12, out.columns


def test_empty_tables(docs, labels, bench):
    for out in everything(docs.where("false"), labels.where("false"), bench.where("false")):
        assert out.count() == 0, out.columns


def test_stages_keep_columns(docs, labels, bench):
    for out in (quality.keep_good(docs, labels), exact_dedup.keep_first_copies(docs), simhash.keep_one_of_each(docs), decontaminate.keep_clean(docs, bench)):
        assert out.columns == docs.columns and out.count() <= 12
    mixed = mixing.mix_documents(docs.withColumns({c: F.lit(0) for c in ("copies", "__id", "__y")}))
    assert sorted(mixed.columns) == sorted([*docs.columns, "copies", "__id", "__y"])
    assert quality.score_quality(docs.withColumns({"__id": F.lit(0), "__y": F.lit(0)}), labels).count() == 12
    assert exact_dedup.keep_first_copies(docs).count() == 9  # the repeated pair and null with empty are one each
    assert mixing.mix_documents(docs).columns == [*docs.columns, "copies"]


def test_exact_dedup_keeps_one(docs):
    got = exact_dedup.exact_dedup(docs, keep="largest").collect()
    assert sum(r.kept for r in got) == 9
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (0, 1)} == {(1, 3)}


def test_fingerprint_bits():
    words = [f"w{i}" for i in range(700)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(698)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 698)
    assert simhash.fingerprint(" ".join(words).encode()) == want
    assert simhash.fingerprint(b" \t") == 0


def test_ball_links_find_all_pairs(spark):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 20)]
    fps += [f ^ (1 << int(a)) ^ (1 << int(b)) for f in fps for a, b in [rng.choice(63, 2, replace=False)]]
    fps = sorted(set(fps))
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)
    roots = dict(simhash.components(links).collect())
    for a in fps:
        for b in fps:
            near = ((a ^ b) & (2**64 - 1)).bit_count() <= 2
            assert not near or roots.get(a, a) == roots.get(b, b)


def test_mix_reaches_targets(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_to_targets(d).toPandas().merge(d.select("doc_id", "source").toPandas(), on="doc_id")
    per = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (abs(per.taken - per.target) <= 7).all() and abs(per.target.sum() - per["size"].sum()) < 1e-6
    assert (got.taken <= 3 * got["size"]).all() and (per.target <= 3 * per["size"]).all()


def test_ledger_scans_once(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = secrets.scan_versions(docs, ledger_path=path).orderBy("doc_id").collect()
    n = spark.read.parquet(path).count()
    assert secrets.scan_versions(docs, ledger_path=path).orderBy("doc_id").collect() == first
    assert spark.read.parquet(path).count() == n == 10
    spans = {r.doc_id: r.spans for r in first}
    assert [(s.kind, s.start, s.stop) for s in spans[6]] == [(0, 0, 24)]


def test_failing_match_uses_up_its_text(spark):
    d = spark.createDataFrame([(1, "token=token:abcdefgh"), (2, "tOkEn : 'abcdef' AKIA" + "Z9" * 8 + "\u0001" + "0af" * 8)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in secrets.scan_versions(d).collect()}
    assert got == {1: [], 2: [(0, 0, 15), (1, 17, 37), (2, 38, 62)]}


def test_token_cache_is_used(spark, docs, tmp_path):
    import public_tokenizers

    path, tok = f"file://{tmp_path}/cache", public_tokenizers.path("piece_bpe_32k.model")
    a = token_counts.token_counts(docs, tok, cache_path=path).orderBy("doc_id").collect()
    n = spark.read.parquet(path).count()
    assert token_counts.token_counts(docs, tok, cache_path=path).orderBy("doc_id").collect() == a
    assert spark.read.parquet(path).count() == n == 10


def test_lm_passes_agree(docs):
    one = lm_score.lm_scores(docs).orderBy("doc_id", "n_tokens").toPandas()
    many = lm_score.lm_scores(docs, max_filter_bytes=1, hot_words=0).orderBy("doc_id", "n_tokens").toPandas()
    assert np.allclose(one.score, many.score) and np.allclose(one.base_score, many.base_score) and (one.n_known == many.n_known).all()


def test_decontamination_blocks_agree(docs, bench):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    one = sorted(map(tuple, decontaminate.decontaminate(docs, bench).select(cols).collect()), key=str)
    many = sorted(map(tuple, decontaminate.decontaminate(docs, bench, block_bytes=8).select(cols).collect()), key=str)
    assert one == many
    assert {r[0]: r[2] for r in one}[4] == 1


def test_surrogates(spark):
    d = spark.createDataFrame([(1, "Mr John Smith, +1 (017) 555-7713 or +1-017-555-7713, a.lee@mail.example.com"), (2, "Mrs Smith A.Lee@mail.example.com 10.1.2.3")], "doc_id long, text string")
    a, b = (r.text for r in surrogates.replace_personal_data(d).orderBy("doc_id").collect())
    phones = re.findall(r"\+\d[\d ()-]+\d", a)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1 and "5557713" not in re.sub(r"\D", "", a)
    assert a.split(",")[0].split()[-1] == b.split()[1] != "Smith"
    assert a.split()[-1] == b.split()[2] and "lee" not in (a + b).lower() and "10.1.2.3" not in b


def test_viterbi_restores(spark):
    model = toxicity.char_model(spark.createDataFrame([("stupid clown idiot moron loser " * 20,)], "text string"))
    symbol = toxicity._symbol_table()
    for seen, meant in (("cl0wn", "clown"), ("s t u p i d", "stupid"), ("m0r0n", "moron"), ("loooser", "loser"), ("s.t.u.p.i.d", "stupid")):
        assert toxicity.decode(seen, model, symbol) == meant

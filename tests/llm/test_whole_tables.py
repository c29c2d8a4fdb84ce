"""Queries over whole tables of the smallest scales against plain recounts, and held-out rows of the classifiers."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from strata.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    d = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return {int(i): t or "" for i, t in zip(d.doc_id, d.text, strict=True)}


def rows(spark, name, sf=SF):
    return {r.doc_id: r for r in registry.QUERIES[name](spark, sf).collect()}


def test_op1_fingerprints_and_components(spark, texts):
    prints = {}
    for i, t in texts.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
        shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = rows(spark, "op1_simhash")
    assert {i: (int(r.fingerprint, 16), r.component_id) for i, r in got.items()} == {i: (prints[i], find(i)) for i in ids}


def test_op4_base_spans(spark, texts):
    rules = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password", "(?i:password").replace("key)", "key)", 1)), 1, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)]
    got = rows(spark, "op4_secret_scan")
    assert len(got) == len(texts)
    for i, t in texts.items():
        spans, counts = [], []
        for n, (pattern, group, least) in enumerate(rules):
            hits = [m for m in pattern.finditer(t) if len(m[group]) >= least]
            counts.append(len(hits))
            spans += [(m.start(), n, m.end()) for m in hits]
        base = ",".join(f"{('assign', 'access', 'hex')[n]}:{a}:{b}" for a, n, b in sorted(spans))
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_op7_counts_as_the_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(spark, "op7_token_counts")
    want = {i: (len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got.values())


def test_op6_leaves_no_address_and_maps_one_to_one(spark, texts):
    address = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
    got, seen = rows(spark, "op6_surrogates"), {}
    for i, t in texts.items():
        before, after = address.findall(t), address.findall(got[i].text or "")
        assert len(before) == len(after) and not set(before) & set(after)
        for a, b in zip(before, after, strict=True):
            assert seen.setdefault(a.lower(), b.lower()) == b.lower()
    assert len(set(seen.values())) == len(seen) > 3


def _held_out(spark, name, label):
    got = rows(spark, name, "/root/testdata/sf0.01")
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    held = [(got[int(r.doc_id)].score, got[int(r.doc_id)].predicted, getattr(r, label)) for r in labels.itertuples() if got[int(r.doc_id)].held_out]
    score, predicted, y = (np.array(x, float) for x in zip(*held, strict=True))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in score[y == 1] for b in score[y == 0]])
    return auc, (predicted == y).mean()


def test_op8_held_out(spark):
    auc, right = _held_out(spark, "op8_toxicity", "toxic")
    assert auc > 0.8 and right > 0.95


def test_op10_held_out(spark):
    auc, right = _held_out(spark, "op10_quality", "quality")
    assert auc > 0.97 and right > 0.95


def test_op10_score_does_not_depend_on_pieces():
    from strata.llm import quality

    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, 600_000, np.uint8)) + b"abcdefgh" * 20_000
    net = quality.train([b"good text here", b"zzzz zzzz zzzz"] * 8, np.array([1.0, 0.0] * 8), epochs=1)
    whole = quality.symbols(text, 1 << 30)
    assert (whole == quality.symbols(text)).all()
    parts = [np.concatenate(list(net.segments(whole, net.tables(), step))) for step in (1 << 30, 1 << 18, 4096)]
    assert (parts[0] == parts[1]).all() and (parts[0] == parts[2]).all()

"""The character lattice against all its readings, and the byte network against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from strata.llm import quality as Q
from strata.llm import toxicity as T

SYMBOL = T._symbol_table()


def readings(token, model, swap=-1.0, drop=-0.3):
    """text -> best log cost of any way to read ``token`` as it."""
    ways, before = [], ""
    for ch in token.lower():
        o = int(SYMBOL[ord(ch)])
        options = [(o, ch, 0.0)] if o else [(0, " ", -5.0)] + [(int(SYMBOL[ord(x)]), x, swap) for x in T.STANDS_FOR.get(ch, "")]
        if (ch == before and o) or ch in T.SEPARATORS:
            options.append(None)
        ways.append(options)
        before = ch
    best = {}
    for way in itertools.product(*ways):
        p = q = 0
        cost, text = 0.0, ""
        for step in way:
            if step is None:
                cost += drop
                continue
            code, out, price = step
            cost += price + float(model[p, q, code])
            p, q, text = q, code, text + out
        cost += float(model[p, q, 0])
        best[text] = max(best.get(text, -math.inf), cost)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_viterbi_finds_the_best_reading(seed):
    rng = random.Random(seed)
    model = np.log(np.random.default_rng(seed).dirichlet(np.full(T.A, 0.3), (T.A, T.A)) + 1e-6).astype(np.float32)
    signs = "".join(T.STANDS_FOR) + "".join(T.SEPARATORS)
    token = "".join(rng.choice("abeiost" * 2 + signs + "éß%") for _ in range(rng.randrange(1, 8)))
    token = token[:3] + token[2:3] * rng.randrange(3) + token[3:]
    best = readings(token, model)
    assert abs(best[T.decode(token, model, SYMBOL)] - max(best.values())) < 1e-4


@pytest.mark.parametrize("text", [b"", b"a", "né à l'école".encode(), b"word " * 120, bytes(range(256)) * 3])
def test_network_against_plain_loops(text):
    net = Q.Network.new(3)
    rng = np.random.default_rng(5)
    net.bias[:] = rng.normal(0, 0.3, net.bias.shape)
    net.out[:] = rng.normal(0, 0.3, net.out.shape)
    s = [int(x) for x in Q.symbols(text)]
    n = max(1, math.ceil(len(s) / Q.SEGMENT)) * Q.SEGMENT
    padded = s + [512] * (n + Q.WIDTH - 1 - len(s))
    respond = [[sum(float(net.embed[padded[i + k], d]) * float(net.filters[k * Q.DIM + d, f]) for k in range(Q.WIDTH) for d in range(Q.DIM)) for f in range(Q.FILTERS)] for i in range(n)]
    peaks = [[max(respond[i][f] for i in range(a, a + Q.SEGMENT)) for f in range(Q.FILTERS)] for a in range(0, n, Q.SEGMENT)]
    if len(peaks) > 1:
        peaks = [[max(x, y) for x, y in zip(a, b, strict=True)] for a, b in itertools.pairwise(peaks)]
    peaks = [[max(0.0, x + float(net.bias[f])) for f, x in enumerate(p)] for p in peaks]
    x = [sum(p[f] for p in peaks) / len(peaks) for f in range(Q.FILTERS)] + [max(p[f] for p in peaks) for f in range(Q.FILTERS)] + [math.log1p(len(s)) / 8, 1.0]
    z = max(-30.0, min(30.0, sum(a * float(b) for a, b in zip(x, net.out, strict=True))))
    assert abs(net.score(text) - 1 / (1 + math.exp(-z))) < 1e-4

"""Decoding against a plain loop, and draws that don't depend on partitions or batches."""

import math
import random

import numpy as np
import pytest

from basalt.operators import decoding as D

WIDTH, VOCABULARY, INPUTS, MARKER, END = 4, 9, 3, 8, 0


def model():
    r = np.random.default_rng(4)
    return D.Recurrent(r.normal(size=(VOCABULARY, WIDTH)), r.normal(size=(WIDTH, WIDTH)), r.normal(size=(VOCABULARY, WIDTH)) * 3, r.normal(size=(WIDTH, INPUTS)))


def plain(prompt, feature, key, sample, length, temperature, top_k, top_p, end=END):
    m, h, out = model(), np.zeros(WIDTH), []
    for t in prompt or []:
        x = m.features @ np.array(feature or [0.0] * INPUTS) if t == MARKER else m.embeddings[t]
        h = np.tanh(x + m.recurrent @ h)
    for position in range(length):
        logits = m.output @ h
        best = sorted(range(VOCABULARY), key=lambda v: (-logits[v], v))
        if temperature == 0:
            t = best[0]
        else:
            best = best[:top_k]
            p = [math.exp((logits[v] - logits[best[0]]) / temperature) for v in best]
            p = [x / sum(p) for x in p]
            if top_p is not None:
                n = next(k for k in range(1, len(p) + 1) if k == len(p) or sum(p[:k]) >= top_p)
                best, p = best[:n], [x / sum(p[:n]) for x in p[:n]]
            u, total = D.uniform(key, sample, position, 1), 0.0
            for t, x in sorted(zip(best, p)):
                total += x
                if u < total:
                    break
        if t == end:
            break
        out.append(t)
        h = np.tanh(m.embeddings[t] + m.recurrent @ h)
    return out


@pytest.mark.parametrize("temperature,top_k,top_p", [(0, None, None), (1.0, None, None), (0.7, 4, None), (1.3, None, 0.6), (2.0, 5, 0.8)])
def test_continuations(spark, temperature, top_k, top_p):
    r = random.Random(1)
    rows = [(k, [r.choice([1, 2, 3, MARKER]) for _ in range(r.randint(0, 6))], [r.gauss(0, 1) for _ in range(INPUTS)], "x") for k in range(40)] + [(50, None, None, "x"), (None, [MARKER], None, "x"), (3, [1], [0.0] * INPUTS, "x")]
    df = spark.createDataFrame(rows, "id long, prompt array<int>, feature array<double>, sample string")
    want = sorted((str(k), s, plain(p, f, k, s, 7, temperature, top_k, top_p)) for k, p, f, _ in rows for s in range(2))
    for parts, batch in ((1, 256), (5, 3)):
        got = D.decode(df.repartition(parts), model(), "id", "prompt", "feature", MARKER, 2, 7, END, temperature, top_k, top_p, batch=batch).collect()
        assert sorted((str(x.id), x.sample, x.tokens) for x in got) == want
    assert D.decode(df.limit(0), model(), "id", "prompt", "feature", MARKER).count() == 0


def test_what_may_be_drawn():
    p = D.allowed(np.log([[0.5, 0.25, 0.125, 0.125]]), 1.0, None, 0.7)
    assert np.allclose(p, [[2 / 3, 1 / 3, 0, 0]]) and D.allowed(np.zeros((1, 3)), 0, None, None).tolist() == [[1, 0, 0]]
    assert np.allclose(D.allowed(np.log([[0.5, 0.25, 0.25]]), 1.0, 2, 0.01), [[1, 0, 0]])

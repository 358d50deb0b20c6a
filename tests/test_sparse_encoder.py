"""Block-sparse attention against dense attention under the same mask; samples against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.operators import sparse_encoder as S

PAD, MASK, VOCABULARY = 0, 1, 20


def weights(width=6, heads=2, most=2):
    r = np.random.default_rng(7)
    return S.Weights(r.normal(size=(VOCABULARY, width)), *(r.normal(size=(width, width)) for _ in range(3)), r.normal(size=(heads, 2 * most + 1)))


def dense(ids, links, layout, w):
    """One row, all pairs of tokens, with a mask."""
    n, locals_ = layout.length, layout.blocks * layout.block_size
    nodes = layout.blocks * layout.node_size
    part = ["local"] * locals_ + ["node"] * nodes + ["global"] * layout.global_size
    block = [i // layout.block_size for i in range(locals_)] + [i // layout.node_size for i in range(nodes)] + [None] * layout.global_size
    both = {(u, v) for u, v in links} | {(v, u) for u, v in links}
    x = w.embeddings[np.array(ids)]
    width = x.shape[1] // w.heads
    out = []
    for h in range(w.heads):
        cols = slice(h * width, (h + 1) * width)
        q, k, v = (x @ m[:, cols] for m in (w.query, w.key, w.value))
        scores = np.full((n, n), -np.inf)
        for i in range(n):
            for j in range(n):
                if part[j] == "local" and ids[j] == PAD:
                    continue
                bias = 0.0
                if part[i] == "local":
                    may = part[j] == "global" or block[i] == block[j]
                elif part[i] == "node":
                    may = part[j] == "global" or (part[j] == "local" and block[i] == block[j]) or (part[j] == "node" and (i == j or (block[i], block[j]) in both))
                    if part[j] == "node":
                        most = w.bias.shape[1] // 2
                        bias = w.bias[h, max(-most, min(most, block[j] - block[i])) + most]
                else:
                    may = True
                if may:
                    scores[i, j] = q[i] @ k[j] / np.sqrt(width) + bias
        p = np.exp(scores - scores.max(1, keepdims=True))
        out.append(p / p.sum(1, keepdims=True) @ v)
    return np.concatenate(out, axis=1)


@pytest.mark.parametrize("layout", [S.Layout(4, 3), S.Layout(3, 2, 2, 2), S.Layout(1, 1)])
def test_equals_dense_attention(spark, layout):
    r, w = np.random.default_rng(2), weights()
    rows = []
    for k in range(20):
        ids = r.integers(0, VOCABULARY, layout.length)
        ids[: int(r.integers(0, 3)) * layout.block_size] = PAD
        rows.append((k, ids.tolist(), [(int(a), int(b)) for a, b in r.integers(0, layout.blocks, (int(r.integers(0, 4)), 2))], "clash"))
    rows += [(90, [1], [], "x"), (91, None, [], "x"), (None, rows[0][1], None, "x")]
    df = spark.createDataFrame(rows, "id long, ids array<int>, links array<struct<u:int,v:int>>, hidden string").repartition(3)
    got = {x.id: x.hidden for x in S.encode(df, "id", "ids", "links", layout, w, PAD, batch=7).collect()}
    assert got.pop(90) is None and got.pop(91) is None
    for k, ids, links, _ in rows[:20] + [(None, rows[0][1], [], "")]:
        assert np.allclose(got[k], dense(ids, links, layout, w)), k
    assert S.encode(df.limit(0), "id", "ids", "links", layout, w).count() == 0


def test_weights_have_a_bound(monkeypatch):
    monkeypatch.setattr(S, "MOST_WEIGHTS", 10)
    with pytest.raises(ValueError):
        S.checked(weights())


def test_samples_and_heads(spark):
    layout, w = S.Layout(5, 4), weights()
    r = np.random.default_rng(3)
    rows = [(k, r.integers(2, VOCABULARY, layout.length).tolist(), [(0, 1), (1, 0), (2, 2), (3, 1)] if k else None, 5) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, ids array<int>, links array<struct<u:int,v:int>>, n int")
    first = {x.id: x for x in S.masked_tokens(df, "id", "ids", layout, MASK, VOCABULARY).collect()}
    again = {x.id: x for x in S.masked_tokens(df.repartition(5), "id", "ids", layout, MASK, VOCABULARY).collect()}
    assert first == again
    masked = total = 0
    for k, ids, *_ in rows:
        x = first[k]
        assert x.labels == [ids[i] for i in x.masked] and all(i < 20 for i in x.masked)
        assert all(a == b for i, (a, b) in enumerate(zip(ids, x.ids)) if i not in x.masked)
        total, masked = total + len(x.masked), masked + sum(x.ids[i] == MASK for i in x.masked)
    assert 0.12 < total / (300 * 20) < 0.18 and 0.75 < masked / total < 0.85
    pairs = S.linked_pairs(df, "id", "links", "n")
    found = {}
    for x in pairs.collect():
        found.setdefault(x.id, []).append((x.u, x.v, x.linked))
    assert 0 not in found and all({(u, v) for u, v, y in f if y} == {(0, 1), (1, 3)} and all(u < v < 5 and (u, v) not in {(0, 1), (1, 3)} for u, v, y in f if not y) for f in found.values())
    encoded = S.encode(df, "id", "ids", "links", layout, w).join(S.masked_tokens(df, "id", "ids", layout, MASK, VOCABULARY).select("id", "masked"), "id").persist()
    hidden = {x.id: np.array(x.hidden) for x in encoded.collect()}
    tokens = S.token_scores(encoded, "masked", w, "id").collect()
    assert len(tokens) == total and all(x.token == int(np.argmax(hidden[x.id][x.place] @ w.embeddings.T)) for x in tokens)
    assert all(x.score == pytest.approx(hidden[x.id][20 + x.u] @ hidden[x.id][20 + x.v]) for x in S.link_scores(encoded, pairs, "id", layout).collect())

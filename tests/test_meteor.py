"""METEOR's stems, alignments and scores against plain versions."""

import random

import pytest

from basalt.functions.stems import measure, stem
from basalt.operators import meteor as M


def test_stems():
    words = "caresses ponies caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll"
    want = "caress poni caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration valenc digit conform radic differ vile analog vietnam predic oper feudal decis hope callous formal sensit sensibl triplic form formal electr electr hope good reviv allow infer airlin gyroscop adjust defens irrit replac adjust depend adopt homolog commun activ angular homolog effect bowdler probat rate ceas control roll"
    assert [stem(w) for w in words.split()] == want.split()
    assert [measure(w) for w in "tr ee tree y by trouble oats trees ivy troubles private oaten orrery".split()] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]
    assert stem("") == "" and stem("as") == "as" and stem("école") and stem("ing")


def plain_best(starting):
    """The best value over all alignments."""
    every = [m for x in starting for m in x]

    def go(k, taken):
        if k == len(every):
            order = sorted(taken)
            chunks = sum(not (i and order[i - 1].h + order[i - 1].h_len == m.h and order[i - 1].r + order[i - 1].r_len == m.r) for i, m in enumerate(order))
            yield -sum(m.h_len + m.r_len for m in taken), chunks, sum(abs(m.h - m.r) for m in taken)
            return
        yield from go(k + 1, taken)
        m = every[k]
        if all((m.h + m.h_len <= o.h or o.h + o.h_len <= m.h) and (m.r + m.r_len <= o.r or o.r + o.r_len <= m.r) for o in taken):
            yield from go(k + 1, [*taken, m])

    return min(go(0, []))


def test_alignments_are_the_best():
    r = random.Random(8)
    for _ in range(400):
        h, ref = ([r.choice(["a", "b", "cats", "cat", "dog", "hound"]) for _ in range(r.randint(0, 5))] for _ in range(2))
        starting = M.matches(h, ref, {"dog": ["d"], "hound": ["d"]}, {"a b": ["dog", "b a"], "cat": ["a a"]})
        if sum(map(len, starting)) > 14:
            continue
        found, chunks = M.align(starting, beam=10**6)
        assert (-sum(m.h_len + m.r_len for m in found), chunks, sum(abs(m.h - m.r) for m in found)) == plain_best(starting)
        assert sum(m.h_len + m.r_len for m in M.align(starting)[0]) == -plain_best(starting)[0]


def plain_score(c, delta=0.75, alpha=0.85, beta=0.2, gamma=0.6):
    part = {}
    for side in M.SIDES:
        hit = sum(w * (delta * c[f"{side}_content_{k}"] + (1 - delta) * c[f"{side}_function_{k}"]) for k, w in enumerate((1, 0.6, 0.8, 0.6)))
        whole = delta * c[f"{side}_content"] + (1 - delta) * c[f"{side}_function"]
        part[side] = hit / whole if whole else 0
    p, r = part["hypothesis"], part["reference"]
    if not p or not r:
        return 0
    words = sum(c[f"{s}_{k}"] for s in M.SIDES for k in ("content", "function"))
    hits = sum(c[f"{s}_{k}_{n}"] for s in M.SIDES for k in ("content", "function") for n in range(4))
    broken = 0 if c["chunks"] == 1 and hits == words else c["chunks"] / (hits / 2)
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * broken**beta)


def test_scores(spark):
    pairs = [
        (0, "the cat sat on the mat", "the cat sat on the mat"), (1, "Cats sitting.", "the cat sits"), (2, None, "x"), (3, "", ""), (4, "x", None), (5, "a big dog barks", "a large hound barks"),
        (6, "it is over now", "it has come to an end now"), (7, "mat the on sat cat the", "the cat sat on the mat"), (8, "word " * 300, "word other " * 200), (9, "Summary: it's fine ||| ok", "it's fine ok"),
    ]
    df = spark.createDataFrame([(*p, "x", "y") for p in pairs], "k int, h string, r string, classes string, phrases string")
    synonyms = spark.createDataFrame([("big", 1), ("Large", 1), ("dog", 2), ("hound", 2), ("dog", None), (None, 3)], "word string, class int")
    paraphrases = spark.createDataFrame([("is over", "come to an end"), ("is over", "x"), (None, "y")], "a string, b string")
    tables = {"synonyms": synonyms, "paraphrases": paraphrases, "function_words": ["the", "a", "on"]}
    counts = {r.k: r.asDict() for r in M.meteor_counts(df, "k", "h", "r", **tables).collect()}
    got = {r.k: r.meteor for r in M.meteor(df, "k", "h", "r", **tables).collect()}
    assert got == {k: pytest.approx(plain_score(c)) for k, c in counts.items()}
    assert got[0] == 1 and got[2] == got[3] == got[4] == 0 and got[9] == 1 and 0 < got[7] < 0.75
    assert counts[5]["hypothesis_content_2"] == 2 and counts[5]["hypothesis_function_0"] == 1 and counts[5]["chunks"] == 1
    assert counts[6]["hypothesis_content_3"] == 2 and counts[6]["reference_content_3"] == 4 and counts[1]["hypothesis_content_1"] == 2
    total = {c: sum(x[c] for x in counts.values()) for c in M.COUNTS}
    assert M.corpus_meteor(M.meteor_counts(df, "k", "h", "r", **tables)).first().meteor == pytest.approx(100 * plain_score(total))
    assert M.meteor(df.limit(0), "k", "h", "r", **tables).count() == 0 and M.corpus_meteor(M.meteor_counts(df.limit(0), "k", "h", "r")).first().meteor == 0


def test_a_frequent_run_brings_only_what_the_reference_says(spark):
    """One run has a paraphrase for every sample: a sample gets its own, not all of them."""
    n = 60
    rows = spark.createDataFrame([(k, ["so", "it", "is", f"h{k}"], [f"r{k}", f"s{k}", "end"]) for k in range(n)], "id long, hypothesis array<string>, reference array<string>")
    table = spark.createDataFrame([("so it", f"r{k} s{k}") for k in range(n)] + [("is h3", "end"), ("it is", "r3 s3"), ("no", "end")], "run string, value string")
    said = {x.id: x.phrases for x in M._said(rows, "id", table, "phrases").collect()}
    assert said == {k: {"so it": [f"r{k} s{k}"]} | ({"is h3": ["end"], "it is": ["r3 s3"]} if k == 3 else {}) for k in range(n)}

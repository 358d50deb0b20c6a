"""The pipeline on a small table against a plain version of each stage."""

import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P

tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def components(texts):
    """Groups of near copies by all pairs' shingles."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").encode().lower().split()) else set() for t in texts]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if group[a] != group[b] and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def test_stages(spark, tmp_path):
    r = random.Random(12)
    words = {"en": ["the", "thing", "and", "with", "other", "where"], "de": ["schein", "und", "einung", "nicht", "öde"]}
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 3 == 0]
        rows.append((i, " ".join(r.choice(words[lang]) + r.choice("aeiou") for _ in range(r.randint(5, 90))), (lang, None)[i % 11 == 0], (None, "s1", "s2")[i % 3], None, "other"))
    rows += [(200 + k, rows[k][1].upper(), "en", "s1", 1, None) for k in range(9)] + [(300, None, "en", "s1", None, None), (301, "", None, None, None, None), (302, "12 !!", "en", "s2", 5, None), (303, rows[5][1] + ".", "en", "s1", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rejected string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, names = rows, []
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        names.append(name)
        got = docs.collect()
        if name == "packing":
            # Every copy of the stream is packed whole: its ids lie in pieces, each in one sequence, without gaps.
            stream = before.collect()
            want = sorted((x.doc_id, len(tokenizer.encode(x.text, add_special_tokens=False).ids) + 1) for x in stream)
            starts = sorted((x.doc_id, x.doc_tokens) for x in got if x.start == 0)
            assert starts == want and sum(x.length for x in got) == sum(n for _, n in want)
            sequences = {}
            for x in got:
                sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
            for pieces in sequences.values():
                pieces.sort()
                assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(n for _, n in pieces) <= 4096
            continue
        assert docs.columns == df.columns
        if name == "language_id":
            kept = [x for x in kept if re.search(r"[^\W\d_]", x[1] or "")]
        elif name == "exact_dedup":
            last = {}
            for x in kept:
                key = x[1].encode().lower()
                last[key] = max(last.get(key, x), x, key=lambda x: x[0])
            kept = list(last.values())
        elif name == "near_dedup":
            first = {}
            for g, x in zip(components([x[1] for x in kept]), kept, strict=True):
                first[g] = min(first.get(g, x), x, key=lambda x: x[0])
            kept = list(first.values())
        if name == "mixing":
            by_id = {x[0]: x for x in kept}
            taken = {}
            for x in got:
                assert by_id[x.doc_id][1].startswith(x.text) and tuple(x)[2:] == by_id[x.doc_id][2:]
                taken[x.source] = taken.get(x.source, 0) + len(x.text.split())
            size = {}
            for x in kept:
                size[x[3]] = size.get(x[3], 0) + len(x[1].split())
            # Sources by name, null last, weigh 5, 2, 1; none goes beyond twice its size.
            weight, target, free = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=True)), {}, 1.5 * sum(size.values())
            while weight:
                over = {s for s in weight if free * weight[s] / sum(weight.values()) > 2 * size[s]}
                if not over:
                    target |= {s: free * w / sum(weight.values()) for s, w in weight.items()}
                    break
                target |= {s: 2.0 * size[s] for s in over}
                free -= sum(2 * size[s] for s in over)
                weight = {s: w for s, w in weight.items() if s not in over}
            assert taken.keys() == target.keys() and all(abs(taken[s] - target[s]) <= 1 for s in target)
            copies = {}
            for x in got:
                copies.setdefault(x.doc_id, []).append(len(x.text.split()))
            assert all(len(c) <= 2 and sum(n < len(by_id[i][1].split()) for n in c) <= 1 for i, c in copies.items())
        else:
            assert sorted(x.doc_id for x in got) == sorted(x[0] for x in kept), name
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0

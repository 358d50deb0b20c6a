"""Each operator against a plain version of itself, on small inputs with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import exact_dedup, hamming_topk, langid, license_scan, line_runs, mixing, packing, simhash, toxicity, unigram_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fp string, size string, bucket string"


def frame(spark, rows, n=3):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, s, None, "x", "y", "z", "b") for i, t, lang, s in rows], DOCS).repartition(n)


def lower(t):
    return (t or "").encode().lower().decode()


@pytest.fixture(scope="module")
def odd():
    """Texts that operators trip over."""
    return [None, "", " ", "\n\n", "a", "A", "É é", "\x1cb\x85c", "x" * 5000, "one two three four five six " * 400, "漢字 仮名 😀", "ends\r\n", None, ""]


@pytest.fixture(scope="module")
def rows(odd):
    r = random.Random(3)
    vocabulary = [r.choice("bcdfg") + r.choice("aeiou") + r.choice("lmnrs") for _ in range(60)]
    texts = odd + [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 80))) for _ in range(60)]
    texts += [texts[-1].upper(), texts[-2], texts[-2], texts[-3] + " end"]
    return [(i, t, ("en", "fr", None)[i % 3], (None, "s1", "s2", "s10")[i % 4]) for i, t in enumerate(texts)] + [(None, "no id", "en", "s1"), (5, "A", "en", "s1"), (5, "A", "en", "s1")]


def test_exact_dedup(spark, rows):
    df = frame(spark, rows).persist()
    got = exact_dedup.exact_dedup(df, prefix_chars=4, bits=8).select("doc_id", "keep_id", "group_size", "kept").collect()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    want = sorted((str(i), str(max(x for x in [-1, *g] if x is not None) if any(x is not None for x in g) else None), len(g)) for g in groups.values() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_distinct_texts(spark, rows, tmp_path):
    df = frame(spark, rows).withColumn("__xd_keep_id", F.lit(1))
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    last = {}
    for i, t, *_ in rows:
        last[lower(t)] = max(last.get(lower(t), -1), -1 if i is None else i)
    want = sorted(str(None if i < 0 else i) for i in last.values())
    for most in (0, 100):
        stays = exact_dedup.distinct_texts(df, broadcast_rows=most)
        assert stays.columns == df.columns and sorted(str(r.doc_id) for r in stays.collect()) == want
    assert exact_dedup.distinct_texts(df.limit(0)).count() == 0


def test_sketches_stay_small():
    assert [exact_dedup.sketch_bits(n) for n in (0, 1000, 10**6, 10**7, 10**12)] == [16, 16, 24, 27, 27]


def test_exact_dedup_slots_may_collide(spark):
    df = frame(spark, [(i, f"text {i % 40}", None, None) for i in range(100)])
    got = exact_dedup.exact_dedup(df, bits=6)
    assert got.filter("kept").count() == 40 and got.agg(F.min("group_size"), F.max("group_size")).first()[:] == (2, 3)


def bits(n, at):
    for b in at:
        n ^= 1 << b
    return n


@pytest.mark.parametrize("crowd", [0, 2, 1000])
def test_links_give_the_components_of_all_pairs(spark, crowd):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(40)]
    found = set(base) | {bits(b, r.sample(range(64), r.choice((1, 2, 3, 4)))) for b in base for _ in range(4)}
    found |= {bits(base[0], c) for c in [(0,), (1,), (0, 1), (22,), (23,), (22, 23), (45, 46), (63,)]} | {0, (1 << 64) - 1, 3, 1}
    fps = sorted(found)
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[x] = y
    want = {}
    for f in fps:
        want.setdefault(root(f), set()).add(simhash.signed(f))
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = {}
    for x in simhash.components(simhash.links(df, crowd)).collect():
        got.setdefault(x.root, set()).add(x.node)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_golay_code_is_perfect():
    t = simhash.golay_tables()
    assert (t["count"][0] == 1).all() and t["count"].sum() == sum(len(list(simhash.combinations(range(23), w))) for w in range(6))


def test_fingerprint_is_the_majority_of_hashes():
    import xxhash

    for text in [None, "", "A", "a b", "A b c D e f", "w " * 700, "é É ß"]:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark, rows):
    df = frame(spark, rows).persist()
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df).collect()}
    prints = [(i, simhash.fingerprint(t)) for i, t, *_ in rows]
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least.setdefault(root(k), []).append(i)
    want = {(i, f"{f:016x}"): min((x for x in least[root(k)] if x is not None), default=None) for k, (i, f) in enumerate(prints)}
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0

def test_replicas_are_not_broadcast(spark, tmp_path):
    """Each fingerprint has 61 replicas, which Spark's estimate takes for one."""
    r = random.Random(8)
    spark.createDataFrame([(simhash.signed(r.getrandbits(64)),) for _ in range(200)], "fp long").write.parquet(str(tmp_path / "t"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [anchor" in plan and "Broadcast" not in plan


def jaccard(a, b, k=5):
    x, y = ({tuple(t.encode().lower().split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("crowd", [8, 128])
def test_representatives_of_near_copies(spark, tmp_path, rows, crowd):
    """Copies with a few words changed go, texts that share half of their shingles stay, whatever the crowd; other columns, repeats, nulls and clashing names stay as they are."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    table = []
    for k in range(60):
        base = [word() for _ in range(r.randint(80, 400))]
        table.append((10 * k, " ".join(base), None, None))
        for c in range(3):
            copy = list(base)
            for _ in range(len(base) // 100):
                copy[r.randrange(len(copy))] = word()
            assert jaccard(table[-1 - c][1], " ".join(copy)) > 0.85
            table.append((10 * k + 1 + c, " ".join(copy), None, None))
        half = base[: len(base) // 2] + [word() for _ in range(len(base) // 2)]
        table.append((10 * k + 5, " ".join(half), None, None))
    table += [(2000, None, None, None), (2001, "", None, None), (None, " \n", None, None), (2002, "one word", None, None), (2002, "ONE  word", None, None), (None, "ONE word\t", None, None)]
    df = frame(spark, table).withColumn("simhash_place", F.lit(1))
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    stays = simhash.representatives(df, crowd=crowd)
    assert stays.columns == df.columns
    got = sorted(x.doc_id for x in stays.collect())
    want = {10 * k + c for k in range(60) for c in (0, 5)} | {2000, 2002}
    # The chance that a copy of so high a similarity has no anchor in common with any of its group is small, not nought.
    assert want <= set(got) and len(got) <= len(want) + 3 and set(got) - want <= {10 * k + c for k in range(60) for c in (1, 2, 3)}
    assert simhash.representatives(df, crowd=crowd, broadcast_rows=0).count() == len(got)
    assert simhash.representatives(df.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [0.79, 0.802, 0.82, 0.9])
def test_recall_of_pairs(spark, tmp_path, similarity):
    """Pairs of a true five-word Jaccard similarity a little over the limit or higher are linked, nine of ten at least; pairs under it never."""
    r = random.Random(int(similarity * 1000))
    table, n = [], 250
    for k in range(n):
        base = [f"{r.randrange(10**6):x}" for _ in range(r.randint(120, 400))]
        copy = list(base)
        if k % 2:  # a new end
            shared = similarity * 2 * (len(base) - 4) / (1 + similarity)
            low = 4 + (int(shared) if similarity < 0.8 else -int(-shared // 1))
            copy[low:] = [f"n{r.randrange(10**6):x}" for _ in copy[low:]]
        else:  # words changed here and there
            while jaccard(" ".join(base), " ".join(copy)) > similarity + 0.02:
                copy[r.randrange(len(copy))] = f"n{r.randrange(10**6):x}"
        texts = " ".join(base), " ".join(copy)
        table += [(2 * k, texts[0], None, None), (2 * k + 1, texts[1], None, None)]
    alike = {k for k in range(n) if jaccard(table[2 * k][1], table[2 * k + 1][1]) >= 0.8}
    frame(spark, table).write.parquet(str(tmp_path / "t"))
    stays = {x.doc_id for x in simhash.representatives(spark.read.parquet(str(tmp_path / "t"))).collect()}
    linked = {k for k in range(n) if 2 * k + 1 not in stays}
    assert {2 * k for k in range(n)} <= stays and linked <= alike
    assert len(linked) >= 0.9 * len(alike)


def test_wide_links_are_all_pairs_that_meet(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (30, 32), np.uint8)
    fps = np.unique(np.concatenate([base, *(base ^ np.packbits(rng.random((30, 256)) < p, axis=1) for p in (0.01, 0.05, 0.1, 0.15, 0.2) for _ in range(3))]), axis=0)
    homes = simhash.homes(fps)
    near = {(a, b) for a in range(len(fps)) for b in range(a) if np.bitwise_count(fps[a] ^ fps[b]).sum() <= 42 and (homes[a] == homes[b]).any()}
    group = list(range(len(fps)))
    for a, b in near:
        x, y = group[a], group[b]
        group = [min(x, y) if g in (x, y) else g for g in group]
    df = spark.createDataFrame([(bytearray(f.tobytes()),) for f in fps], "fp binary").repartition(3)
    place = {f.tobytes(): k for k, f in enumerate(fps)}
    got = {}
    for x in simhash.components(simhash.wide_links(df, 42)).collect():
        got.setdefault(bytes(x.root), set()).add(place[bytes(x.node)])
    want = {}
    for k, g in enumerate(group):
        want.setdefault(g, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


@pytest.mark.parametrize("crowd", [4, 32])
def test_a_crowd_of_near_copies_is_one_group(spark, crowd):
    """Far more near copies of one text than an anchor compares go to finer anchors, and still hang together; others near them stay apart."""
    rng = np.random.default_rng(6)
    base, other = rng.integers(0, 256, (2, 32), np.uint8)
    fps = np.unique(np.concatenate([base ^ np.packbits(rng.random((600, 256)) < 0.04, axis=1), [base, other]]), axis=0)
    df = spark.createDataFrame([(bytearray(f.tobytes()),) for f in fps], "fp binary").repartition(3)
    found = simhash.components(simhash.wide_links(df, 42, crowd)).collect()
    assert len(found) == len(fps) - 1 and len({bytes(x.root) for x in found}) == 1


@pytest.mark.parametrize("forests", [1, 3])
def test_forests_connect_what_all_links_connect(monkeypatch, forests):
    monkeypatch.setattr(simhash, "FORESTS", forests)
    rng = np.random.default_rng(9)
    for most in (20, 42, 60):
        base = rng.integers(0, 256, (12, 32), np.uint8)
        fps = np.concatenate([base ^ np.packbits(rng.random((12, 256)) < p, axis=1) for p in (0.0, 0.03, 0.08, 0.12, 0.2)])
        keys = np.sort(rng.integers(0, 4, len(fps)))
        d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
        everything = [(a, b) for b in range(len(fps)) for a in range(b) if keys[a] == keys[b] and d[a, b] <= most]
        a, b, distance = simhash._run_links(keys, np.ascontiguousarray(fps), most)

        def groups(pairs):
            group = list(range(len(fps)))
            for x, y in pairs:
                group = [min(group[x], group[y]) if g in (group[x], group[y]) else g for g in group]
            return group

        assert groups(zip(a.tolist(), b.tolist(), strict=True)) == groups(everything) and len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(a)
        if forests == 1:
            assert len(a) == len(fps) - len(set(groups(everything)))
        # Links up to `sure` are one forest; those above it come several times over.
        a2, b2, d2 = simhash._run_links(keys, np.ascontiguousarray(fps), most, 20)
        close = lambda x, y, z: groups((i, j) for i, j, k in zip(x.tolist(), y.tolist(), z.tolist(), strict=True) if k <= 20)
        assert close(a2, b2, d2) == groups((i, j) for i, j in everything if d[i, j] <= 20) and len(a2) <= len(a)
        assert (distance == d[a, b]).all() and (keys[a] == keys[b]).all()


def test_a_refused_link_loses_no_other(spark, tmp_path):
    """Many texts of a group are near the limit, so that the closest links of an anchor are often refused: what meets at an anchor and is alike is one group all the same."""
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(2):
        base = [word() for _ in range(50)]
        for _ in range(250):
            copy = list(base)
            for k in r.sample(range(len(copy)), r.choice((1, 2))):
                copy[k] = word()
            texts.append(" ".join(copy))
    wide = np.array([np.frombuffer(simhash.wide_fingerprint(t), np.uint8) for t in texts])
    long = np.array([np.frombuffer(simhash.wide_fingerprint(t, 5, simhash.LONG, simhash.WIDE // 64), np.uint8) for t in texts])
    home, group = simhash.homes(wide), list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            d, far = (int(np.bitwise_count(x[a] ^ x[b]).sum()) for x in (wide, long))
            if group[a] != group[b] and (home[a] == home[b]).any() and (d <= simhash.wide_distance(0.8, 256, -3) or d <= 50 and (far <= simhash.wide_distance(0.8, 1024, -3) or far <= simhash.wide_distance(0.8, 1024, 2) and jaccard(texts[a], texts[b]) >= 0.8)):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    frame(spark, [(k, t, None, None) for k, t in enumerate(texts)]).write.parquet(str(tmp_path / "t"))
    stays = {x.doc_id for x in simhash.representatives(spark.read.parquet(str(tmp_path / "t")), crowd=1000).collect()}
    assert stays == set(group)


def test_pairs_that_further_bits_refuse_are_no_rows(spark, tmp_path, monkeypatch):
    """A large group whose texts are mostly just below the similarity: of all its pairs only those that the further bits leave open are made rows of the second look."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(60)], []
    for _ in range(200):
        copy = list(base)
        for k in r.sample(range(len(copy)), 2):
            copy[k] = word()
        texts.append(" ".join(copy))
    frame(spark, [(k, t, None, None) for k, t in enumerate(texts)]).write.parquet(str(tmp_path / "t"))
    made, scratch_table = {}, simhash.scratch_table
    monkeypatch.setattr(simhash, "scratch_table", lambda df, name, *a, **b: made.setdefault(name, scratch_table(df, name, *a, **b)))
    simhash.representatives(spark.read.parquet(str(tmp_path / "t"))).collect()
    long = {simhash.wide_fingerprint(t): np.frombuffer(simhash.wide_fingerprint(t, 5, simhash.LONG, simhash.WIDE // 64), np.uint8) for t in texts}
    pairs = [(bytes(x.a), bytes(x.b)) for x in made["simhash-rest"].collect()]
    assert pairs
    assert all(np.bitwise_count(long[a] ^ long[b]).sum() <= simhash.wide_distance(0.8, simhash.LONG, 2) for a, b in pairs)


def test_chance_of_meeting():
    """Of pairs that differ in the bits expected at a similarity of 0.85 nine in ten meet at an anchor, of closer ones nearly all; more codes keep that for larger inputs."""
    assert [simhash.wide_distance(0.8, 256, k) for k in (-2, 0, 1)] == [27, 39, 45] and simhash.code_sizes(10**5) == (80, 6)
    assert simhash.meeting(0.1515) > 0.93 and simhash.meeting(0.13) > 0.97 and simhash.meeting(0.1) > 0.99 and simhash.meeting(0.5) < 0.01
    codes, raw = simhash.code_sizes(5 * 10**7)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (500, 32), np.uint8)
    b = a ^ np.packbits(rng.random((500, 256)) < 0.13, axis=1)
    assert raw == 12 and (simhash.homes(a, codes, raw) == simhash.homes(b, codes, raw)).any(axis=1).mean() > 0.88


def test_packing_round_trip(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*rows, (900, "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> c", None, None)]
    assert 49407 in tokenizer.encode(rows[-1][1], add_special_tokens=False).ids
    df = frame(spark, rows)
    got = packing.pack(df, length=256, docs_per_group=20).collect()
    want = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for _, t, *_ in rows)
    sequences, by_doc = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(map(len, want))
    assert sum(r.length for r in got) == total
    fills = [sum(r.length for r in rs) for rs in sequences.values()]
    assert sum(0 if f & f - 1 == 0 else 256 - f for f in fills) < 0.02 * total
    texts = {(i, len(ids)): ids for i, t, *_ in rows for ids in [tokenizer.encode(t or "", add_special_tokens=False).ids + [2]]}
    for (i, n), rs in by_doc.items():
        if sum(r.length for r in rs) == n:
            at = 0
            for r in sorted(rs, key=lambda r: r.start):
                assert r.start == at and zlib.crc32(np.array(texts[i, n][at : at + r.length], "<u4").tobytes()) == r.ids_crc32
                at += r.length
            assert at == n
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_spreads_copies_over_all_groups(spark):
    rows = [(i % 3 or None, ("one text of many copies", None)[i % 4 == 0], None, None) for i in range(400)]
    groups = {}
    for r in packing.pack(frame(spark, rows), length=256, docs_per_group=20).collect():
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + (r.start == 0)
    assert sum(groups.values()) == 400 and len(groups) == 20 and max(groups.values()) < 50


def test_words_give_the_ids_of_whole_texts():
    import public_tokenizers

    words = packing.load_word_ids(public_tokenizers.path("word_bpe_49k.json"), 50)
    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choice("aB1 '\"s.é ßİΣσς́x語😀\n\t\x1c\x85\xa0½ŉƁ<|endoftext|>") for _ in range(r.randint(0, 40)))
        assert words.text(text) == words.encode(text)


def test_first_fit_decreasing_takes_the_leftmost_bin():
    r = random.Random(2)
    for _ in range(50):
        sizes, room = [r.randint(1, 60) for _ in range(40)], [r.randint(0, 100) for _ in range(r.randint(1, 30))]
        left, want = list(room), [-1] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            for b, free in enumerate(left):
                if free >= sizes[k]:
                    left[b] -= sizes[k]
                    want[k] = b
                    break
        assert packing.first_fit_decreasing(sizes, room) == want


@pytest.mark.parametrize("limit", [0, 1000])
def test_line_runs(spark, limit):
    r = random.Random(4)
    lines = ["", "  ", "common line", " COMMON line\t", "Ä", "ä", "rare one", "x" * 3000, "\x0bcommon line\r"] + [f"line {k}" for k in range(30)]
    rows = [(i, r.choice([None, ""]) if i % 9 == 0 else "\n".join(r.choice(lines) for _ in range(r.randint(1, 9))), None, None) for i in range(120)] + [(1, "common line", None, None), (None, "common line\nrare one", None, None), (None, None, None, None)]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    docs = {}
    for k, (_, t, *_r) in enumerate(rows):
        for x in {key(line) for line in (t or "").split("\n")}:
            docs.setdefault(x, set()).add(k)
    often = {x for x, own in docs.items() if x and len(own) >= 10}
    want = sorted((str(i), "\n".join(x for x in (t or "").split("\n") if key(x) not in often), (t or "").count("\n") + 1, sum(key(x) in often for x in (t or "").split("\n"))) for i, t, *_ in rows)
    df = frame(spark, rows).persist()
    assert sorted((str(x[0]), *x[1:]) for x in map(tuple, line_runs.drop_frequent_lines(df, broadcast_keys=limit).collect())) == want
    assert line_runs.drop_frequent_lines(df.limit(0), broadcast_keys=limit).count() == 0


def test_line_runs_are_few_and_leave_nothing(spark, monkeypatch):
    from basalt.llm.common import shared_dir

    r = random.Random(8)
    folder = shared_dir(spark).removeprefix("file:")
    left = lambda: ([x.name for x in spark.catalog.listTables() if x.name.startswith("line_runs_")], [f for f in os.listdir(folder) if f.startswith("line_runs_")])
    store, total, decided = line_runs.LineRuns(spark, 6, buckets=3), {}, set()
    for k in range(16):
        batch = {r.randrange(80): r.choice([1, 1, 2, 7]) for _ in range(40)}
        for key, n in batch.items():
            total[key] = total.get(key, 0) + n
        store.append(spark.createDataFrame([(key, -key, n) for key, n in batch.items()], "h1 long, h2 long, docs long"))
        assert len(store.runs) == (k + 1).bit_count() and len(left()[0]) == len(store.runs)
        # A merge of two runs shuffles nothing.
        plan = store._merged(store.runs[:2])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    got = {x.h1 for x in store.frequent().collect()}
    store.close()
    assert got == {key for key, n in total.items() if n >= 6} and left() == ([], [])

    def broken(self, rows):
        self.made += 1
        rows.limit(1).write.parquet(f"{self.folder}/{self.name}_{self.made}")
        raise RuntimeError("lost")

    monkeypatch.setattr(line_runs.LineRuns, "_write", broken)
    with pytest.raises(RuntimeError):
        line_runs.frequent_lines(frame(spark, [(1, "a", None, None), (None, "a", None, None)]))
    assert left() == ([], [])


def test_top_k(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 64))
    vectors[50:90] = vectors[50]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(900, None), (901, []), (902, [float("nan")] * 64), (None, vectors[3].tolist()), (7, vectors[8].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit("x")).persist()
    code = lambda v: sum(1 << b for b, x in enumerate(v[:64]) if x > 0)
    want = set()
    for q, v in rows:
        if q is not None and q % 20 == 0 and v is not None:
            near = sorted((((code(v) ^ code(w)).bit_count(), -1 if i is None else i) for i, w in rows if w is not None))[:10]
            want |= {(q, None if i < 0 else i, d, k) for k, (d, i) in enumerate(near, 1)}
    got = hamming_topk.top_k(df, df.filter("vec_id % 20 = 0"), shard_codes=100)
    assert {tuple(r) for r in got.collect()} == want
    assert hamming_topk.top_k(df.limit(0), df).count() == 0 and hamming_topk.top_k(df, df.limit(0)).count() == 0


def test_top_k_of_all_dimensions(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 150))
    vectors[:, :64] = vectors[0, :64]
    rows = [(k, v[: 150 - k % 2 * 40].tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").persist()
    code = [sum(1 << b for b, x in enumerate(v) if x > 0) for _, v in rows]
    want = {(q, i, d, k) for q in range(0, 120, 20) for k, (d, i) in enumerate(sorted(((code[q] ^ c).bit_count(), i) for i, c in enumerate(code))[:10], 1)}
    assert {tuple(r) for r in hamming_topk.top_k(df, df.filter("vec_id % 20 = 0"), shard_codes=50).collect()} == want


def test_token_counts_are_the_tokenizers(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = unigram_counts.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    r = random.Random(6)
    texts = ["".join(r.choice("ab ▁e\nthéß語😀<>s0x4") for _ in range(r.randint(0, 60))) for _ in range(400)]
    counter = unigram_counts.PieceCounter(vocabulary)
    assert [counter.text(t) for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = unigram_counts.token_counts(frame(spark, rows)).collect()
    assert sorted((str(x.doc_id), x.n_chars, x.n_tokens) for x in got) == sorted((str(i), len(t or ""), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert unigram_counts.token_counts(frame(spark, rows).limit(0)).count() == 0
    # Equal scores: the path whose last piece starts first stays.
    tied = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -9.0), ("c", -7.0)]
    exact = Tokenizer(models.Unigram(tied, unk_id=0))
    assert unigram_counts.PieceCounter(tied).best("ab") == len(exact.encode("ab").ids)


def brute_mix(rows):
    key = lambda s: ("1",) if s is None else ("0", s.encode())
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _l, _s in rows]
    totals = {}
    for n, (*_, s) in zip(size, rows, strict=True):
        totals[key(s)] = totals.get(key(s), 0) + n
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(sorted(totals))}
    target, budget, open_ = {}, 1.5 * sum(totals.values()), set(totals)
    while open_:
        level = budget / sum(weight[k] for k in open_)
        over = {k for k in open_ if level * weight[k] > 2 * totals[k]}
        if not over:
            target |= {k: level * weight[k] for k in open_}
            break
        target |= {k: 2.0 * totals[k] for k in over}
        budget -= sum(2 * totals[k] for k in over)
        open_ -= over
    return size, totals, {k: target[k] for k in totals}, key


def test_mixing(spark, rows):
    df = frame(spark, rows).persist()
    size, totals, target, key = brute_mix(rows)
    plan = mixing.plan_mix(df, carry=["source"])
    got = plan.withColumnRenamed("__mx_c_source", "source").collect()
    taken = {}
    for r in got:
        assert r.source_size == totals[key(r.source)] and r.target == pytest.approx(target[key(r.source)]) and 0 <= r.taken <= 2 * r.size
        taken[key(r.source)] = taken.get(key(r.source), 0) + r.taken
    assert len(got) == len(rows) and sorted(r.size for r in got) == sorted(size)
    assert all(abs(taken[k] - target[k]) <= 1 for k in target)
    again = mixing.plan_mix(df.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in got)
    stream = mixing.mix(df)
    assert stream.columns == [*df.columns, "mix_position"]
    rows_out = stream.collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows_out) == sum(r.taken for r in got)
    positions = [r.mix_position for r in rows_out]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.plan_mix(df.limit(0)).count() == 0


def test_curriculum_inverts_the_integral(spark):
    rows = spark.createDataFrame([(t / 20, s) for t in range(21) for s in (-0.5, 0.0, 0.25, 1.0)], "t double, s double")
    demand = 100 * ((1 + F.col("s")) * F.col("t") - F.col("s") * F.col("t") ** 2)
    back = rows.select("t", mixing.curriculum_time(demand, F.lit(100.0), F.col("s")).alias("b")).collect()
    assert all(r.b == pytest.approx(r.t, abs=1e-6) for r in back)


def test_license_scan(spark, odd):
    gpl = license_scan.TEMPLATES["GPL-3.0"]
    texts = [*odd, "words before. " + gpl + " and after", gpl.upper().replace(" ", "\n") + "\n" + gpl, gpl.replace("General", "Foo"), "this license is not licensed", "noise " * 300 + license_scan.TEMPLATES["MIT"] + " noise" * 300]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    n = len(odd)
    assert [got[i].license for i in range(n)] == [None] * n
    assert [got[n + k].license for k in range(5)] == ["GPL-3.0", "GPL-3.0", "GPL-3.0", None, "MIT"]
    assert got[n].coverage == 1 and (got[n].first_word, got[n].last_word) == (2, 13) and 0.8 < got[n + 2].coverage < 1
    assert got[n + 4].first_word == 300


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            here = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(here, row[j])
            before = here
    return row[-1]


def test_license_coverage_is_that_of_the_best_window():
    """Against longest common subsequences of all windows, on texts of recurring words: all that reach the coverage are found, with it, and no others."""
    r = random.Random(5)
    names = ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "All-Rights-Reserved", "CC-BY-4.0", "BSD-text"]
    parsed = {k: license_scan.parse(license_scan.TEMPLATES[k], 0.8) for k in names}
    reached = 0
    for _ in range(1500):
        name = r.choice(names)
        words, text = parsed[name].words, []
        for _ in range(r.randint(1, 5)):
            if r.random() < 0.5:
                for w in words:
                    if r.random() > r.choice((0, 0.1, 0.2, 0.3)):
                        text.append(w)
                        while r.random() < r.choice((0, 0.2, 0.5)):
                            text.append(r.choice([*words, "noise", "x", "y"]))
            else:
                text += [r.choice([*words, "noise", "x", "y", "z"]) for _ in range(r.randint(1, 30))]
        window = 2 * len(words)
        best = max(common(text[lo : lo + window], words) for lo in range(max(1, len(text) - window + 1)))
        found = license_scan.scan(" ".join(text), {name: parsed[name]}, 0.8)
        assert [f[1] for f in found] == ([best / len(words)] if best >= 0.8 * len(words) else []), (name, text)
        if found:
            _, _, first, last = found[0]
            assert common(text[first : last + 1], words) == best and last - first < window
            reached += 1
    assert reached > 500


def test_license_ties_repeats_and_empty_tables(spark):
    text = "Licensed under CC BY-NC 4.0. " + "noise " * 40 + "All rights reserved."
    df = frame(spark, [(1, text, None, None), (1, text, None, None), (None, text, None, None)])
    got = [tuple(x) for x in license_scan.scan_licenses(df).collect()]
    assert sorted(map(str, got)) == sorted(str((i, "CC-BY-NC-4.0", 1.0, 0, 4, ["All-Rights-Reserved", "CC-BY-NC-4.0"])) for i in (1, 1, None))
    assert license_scan.scan_licenses(df.limit(0)).count() == 0 and license_scan.scan_licenses(df, templates={"none": "..."}).filter("license IS NOT NULL").count() == 0


def test_license_copy_without_the_rarest_word(spark):
    copies = "Issued under the MIT License. " * 2
    texts = [copies + "noise " * n + "released" for n in (0, 2, 5, 8, 12, 40)]
    got = license_scan.scan_licenses(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    assert [(r.license, r.coverage) for r in sorted(got.collect())] == [("MIT", 0.8)] * len(texts)


def test_standard_notices_and_full_texts_are_found(spark):
    names = sorted(k for k in license_scan.TEMPLATES if k.endswith(("-full", "-notice")))
    assert {"MIT-full", "Apache-2.0-full", "BSD-3-Clause-full", "GPL-3.0-full", "GPL-3.0-notice"} <= set(names)
    texts = ["noise " * 30 + license_scan.TEMPLATES[k] + " noise" * 30 for k in names]
    got = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i].license for i in range(len(names))] == names and all(r.coverage == 1 for r in got.values())
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/."
    assert license_scan.scan_licenses(frame(spark, [(1, gpl, None, None)])).first().license == "GPL-3.0-notice"


def test_patience_alignment_is_a_common_subsequence():
    r = random.Random(8)
    for _ in range(300):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 14))] for _ in "ab")
        m = license_scan.align(a, b)
        assert all(a[x] == b[y] for x, y in m)
        assert all(x < x2 and y < y2 for (x, y), (x2, y2) in zip(m, m[1:], strict=False))
    for _ in range(200):
        v = [r.randint(0, 20) for _ in range(r.randint(0, 12))]
        best = max((sum(1 for _ in s) for mask in range(1 << len(v)) for s in [[v[k] for k in range(len(v)) if mask >> k & 1]] if all(x < y for x, y in zip(s, s[1:], strict=False))), default=0) if len(v) <= 9 else None
        found = license_scan.longest_increasing(v)
        assert [v[k] for k in found] == sorted({v[k] for k in found}) and (best is None or len(found) == best)


def test_toxicity_learns_words_and_misspellings(spark):
    r = random.Random(9)
    plain = ["table", "river", "window", "garden", "paper", "silver", "morning", "letter"]
    make = lambda bad: " ".join(r.choice(plain) for _ in range(r.randint(8, 40))) + (f" {bad} {r.choice(plain)} {bad}" if bad else "")
    rows = [(i, make(("dunderhead", "blockhead")[i // 4 % 2] if i % 4 == 0 else ""), None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None), (100000, 1)], "doc_id long, toxic int")
    df = frame(spark, rows)
    model = toxicity.fit(df, labels, max_per_class=80)
    test = [(0, make("")), (1, make("dunderheads")), (2, make("Blockhead!")), (3, ""), (4, None), (5, make("dunderhaed"))]
    got = {x.doc_id: x for x in toxicity.score(frame(spark, [(i, t, None, None) for i, t in test]), model).collect()}
    assert [got[i].predicted for i in (0, 1, 2, 3, 4)] == [0, 1, 1, 0, 0] and got[5].score > got[0].score and got[3].score == got[4].score
    empty = toxicity.fit(df, labels.limit(0))
    assert all(0 <= x.score <= 1 for x in toxicity.score(df, empty).collect()) and toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_is_the_softmax_over_the_mean_embedding():
    rng = np.random.default_rng(8)
    bags = [(np.unique(rng.integers(0, 500, 30)), None) for _ in range(60)]
    bags = [(b, rng.integers(1, 4, len(b)).astype(np.float32)) for b, _ in bags]
    labels = np.array([int(b[0] < 12) for b, _ in bags])
    embedding, weight, bias = toxicity.matrices(bags, labels, 8, 100, 0.5, 16, 7)
    model = toxicity.train(bags, labels, float(labels.mean()), 8, 100, 0.5, 16, 7)
    for b, n in bags:
        logits = (embedding[b] * n[:, None]).sum(axis=0) / n.sum() @ weight + bias
        p = np.exp(logits - logits.max())
        assert model.score(float((model.slope[b] * n).sum()), int(n.sum())) == pytest.approx(p[1] / p.sum(), abs=1e-4)


def test_label_sample_is_the_first_by_hash(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"))
    want = sorted(df.collect(), key=lambda r: (r.h, r.doc_id))
    for most in (0, 1, 50, 4999, 6000):
        assert sorted(toxicity.first_by_hash(df, "h", "doc_id", 5000, most).collect()) == sorted(want[:most])


def test_toxicity_of_repeated_ids_and_very_long_texts(spark):
    model = toxicity.Model(np.random.default_rng(4).normal(size=toxicity.BUCKETS), 0.1)
    long = "word other thing " * 100_000
    df = frame(spark, [(1, "a b", None, None), (1, "a b", None, None), (2, long, None, None), (3, long + "word other thing", None, None)])
    got = sorted((x.doc_id, round(x.score, 4)) for x in toxicity.score(df, model).collect())
    assert [i for i, _ in got] == [1, 1, 2, 3] and got[0] == got[1] and got[2][1] == got[3][1]


def test_toxicity_of_a_long_token_is_that_of_all_its_characters(spark):
    slope = np.random.default_rng(3).normal(size=toxicity.BUCKETS)
    model = toxicity.Model(slope, 0.0)
    texts = ["y" * 300, "y" * 300 + "_dunderhead", "漢字" * 200 + "_dunderhead", "no " + "y_" * 400 + "z"]
    got = {x.doc_id: x.score for x in toxicity.score(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), model).collect()}
    for i, text in enumerate(texts):
        found = []
        for w in text.split():
            p = f"<{w}>"
            found += [zlib.crc32(g.encode()) % toxicity.BUCKETS for g in [w, *(p[k : k + n] for n in (3, 4, 5) for k in range(len(p) - n + 1))]]
        assert got[i] == pytest.approx(model.score(slope[found].sum(), len(found)))
    bag = toxicity.bags(frame(spark, [(0, texts[1], None, None)]).withColumn("y", F.lit(1)), "text", "y").first()
    assert sum(bag.counts) == 1 + sum(len(texts[1]) + 3 - n for n in (3, 4, 5))


def test_language_models(spark, odd):
    r = random.Random(10)
    sounds = {"en": ["the", "ing", "and", "th", "wh"], "de": ["sch", "ein", "ung", "ch", "ö"]}
    make = lambda lang, n: " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, make(("en", "de")[i % 2], r.randint(2, 60)), ("en", "de")[i % 2], None) for i in range(200)]
    df = frame(spark, [*rows, (500, None, "en", None), (501, "the", None, None)])
    model = langid.train(df)
    tests = [(1000 + i, make(lang, 12), lang, None) for i in range(40) for lang in ("en", "de")] + [(2000 + i, t, None, None) for i, t in enumerate(odd)] + [(3000, "12 34 !!", None, None), (3001, "привет мир это другой язык " * 5, None, None)]
    got = {(x.doc_id, x.lang_pred, x.rejected) for x in langid.identify(frame(spark, tests), model).collect()}
    assert {(i, lang, False) for i, _, lang, _ in tests[:80]} <= got
    assert all((2000 + i, "und", True) in got for i in (0, 1, 2, 3)) and (3000, "und", True) in got
    assert any(i == 3001 and rejected for i, _, rejected in got)
    none = langid.train(df.limit(0))
    assert none is None and {x.lang_pred for x in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_training_in_spark_is_that_of_the_plain_version(spark, rows):
    df = frame(spark, rows)
    model = langid.train(df)
    by_lang = {}
    for r in sorted(langid.count_grams(df.filter("text IS NOT NULL AND lang IS NOT NULL"), "text", "lang").collect(), key=lambda r: r.gram):
        by_lang.setdefault(r.lang, []).append((r.gram, r.n))
    want = langid.build_model({lang: ("".join(g for g, _ in own), np.array([n for _, n in own])) for lang, own in by_lang.items()})
    assert model.langs == want.langs and model.even == pytest.approx(want.even)
    for name in ("grams", "logs", "contexts", "backoffs"):
        assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(getattr(model, name), getattr(want, name), strict=True)), name
    for name in ("unseen", "entropy", "sigma"):
        assert np.allclose(getattr(model, name), getattr(want, name), atol=1e-4), name


def test_a_model_in_tables_gives_the_same_results(spark, rows, odd):
    df = frame(spark, rows)
    model, tables = langid.train(df), langid.train(df, broadcast_bytes=0)
    assert isinstance(tables, langid.Tables) and np.allclose(model.entropy, tables.entropy)
    texts = [*odd, "the thing", "привет мир " * 30, "bal rel x" * 9, "12 34"]
    asked = frame(spark, [*rows, *((1000 + i, t, None, None) for i, t in enumerate(texts))]).withColumn("langid_place", F.lit(7)).persist()
    one, two = (sorted(langid.identify(asked, m, carry=["doc_id", "text", "langid_place"]).collect(), key=str) for m in (model, tables))
    assert len(one) == len(two) == len(rows) + len(texts)
    for a, b in zip(one, two, strict=True):
        assert (a.doc_id, a.text, a.langid_place, a.lang_pred, a.rejected) == (b.doc_id, b.text, b.langid_place, b.lang_pred, b.rejected)
        assert a.score == pytest.approx(b.score, abs=1e-4) and (a.cross_entropy is None) == (b.cross_entropy is None) and (a.cross_entropy or 0) == pytest.approx(b.cross_entropy or 0, abs=1e-4)
    assert langid.identify(asked.limit(0), tables).count() == 0


def test_training_keeps_every_gram(spark):
    """More 5-grams of a language than any table size that was ever fixed."""
    letters = np.random.default_rng(1).integers(0x4E00, 0x9FA0, (12_000, 50))
    words = ["".join(map(chr, w)) for w in letters]
    want = {w[k : k + 5] for w in (f"    {w} " for w in words) for k in range(len(w) - 4)}
    rows = [(k, " ".join(words[k::40]), "zh", None) for k in range(40)] + [(99, "the other language", "en", None)]
    model = langid.train(frame(spark, rows))
    assert len(want) > 500_000 and abs(len(model.grams[4]) - len(want) - len("the other language")) < 6


def test_kneser_ney_sums_to_one(spark):
    """For any context, probabilities of all letters and of what is left for unseen ones sum to one."""
    grams = {"    a": 3, "   ab": 2, "  ab ": 2, "   a ": 1, "    b": 1, "   bb": 1, "  bb ": 1}
    model = langid.build_model({"x": ("".join(grams), np.array(list(grams.values())))})
    letters = ["a", "b", " ", "z"]
    for context in ("    ", "   a", "  ab", "qqqq", "   b"):
        p = [np.exp(model._letters(langid._points(context + c), np.array([0]))[0, 0]) for c in letters]
        assert sum(p) == pytest.approx(1, abs=1e-4)


def test_probabilities_are_plain_kneser_ney():
    """Against a recursive version over dictionaries."""
    r = random.Random(2)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 7))) for _ in range(60)]
    grams = {}
    for w in words:
        padded = f"    {w} "
        for k in range(len(w) + 1):
            grams[padded[k : k + 5]] = grams.get(padded[k : k + 5], 0) + 1
    model = langid.build_model({"x": ("".join(grams), np.array(list(grams.values())))})
    counts = {5: grams}
    for n in range(4, 0, -1):
        before = {}
        for g in counts[n + 1]:
            before.setdefault(g[1:], set()).add(g[0])
        counts[n] = {g: len(b) for g, b in before.items()}
    letters = len(counts[1]) + 1

    def probability(context, c):
        n = len(context) + 1
        below = probability(context[1:], c) if n > 1 else 1 / letters
        own = {g: k for g, k in counts[n].items() if g[:-1] == context}
        if not own:
            return below
        ones, twos = (sum(k == m for k in counts[n].values()) for m in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        return max(own.get(context + c, 0) - discount, 0) / sum(own.values()) + discount * len(own) / sum(own.values()) * below

    for _ in range(300):
        g = r.choice(list(grams)) if r.random() < 0.5 else "".join(r.choice("abcdz ") for _ in range(5))
        assert model._letters(langid._points(g), np.array([0]))[0, 0] == pytest.approx(np.log(probability(g[:4], g[4])), abs=1e-4), g
    assert model.even[0] == pytest.approx(np.log(letters))


def test_without_a_model_only_texts_without_letters_are_rejected(spark, odd):
    got = {x.doc_id: (x.lang_pred, x.rejected) for x in langid.identify(frame(spark, [(i, t, None, None) for i, t in enumerate(odd)]), None).collect()}
    assert {p for p, _ in got.values()} == {"und"} and [r for _, r in sorted((i, r) for i, (_, r) in got.items())] == [not any(map(str.isalpha, t or "")) for t in odd]


def test_folds(spark):
    df = spark.range(50).select(F.col("id"), langid.fold("id", 5).alias("k"))
    assert all(r.k == zlib.crc32(str(r.id).encode()) % 5 for r in df.collect())


def test_hash_of_normalised_text(spark):
    got = spark.createDataFrame([("ÀB",), (None,), ("Ab",)], "text string").select(F.sha2(exact_dedup.normalised("text"), 256)).collect()
    assert [r[0] for r in got] == [hashlib.sha256(x.encode()).hexdigest() for x in ("Àb", "", "ab")]

"""Conversation repair, spelling variants and URL filters against plain versions, with nulls, empty and long texts, ties, repeats, clashing columns and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basalt.llm import conversation_repair as cr
from basalt.llm import spelling, url_filter

SPACE = " \t\n\v\f\r"
TURNS = "conv_id long, turn long, role string, text string, conv string, pid string, k string, roles string"


def plain_repair(rows):
    """rows: (turn, role, text) in order. All ways, state by state, cheapest (cost, letters) with the repaired turns."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    follows = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    names = {"u": "user", "a": "assistant"}

    def with_insertions(ways):
        for _ in range(4):
            for (state, (cost, letters, out)) in list(ways.items()):
                for role in "ua":
                    if (state, role) in follows:
                        new = (cost + 2, letters + "I", [*out, f"{names[role]}:"])
                        to = follows[state, role]
                        ways[to] = min(ways.get(to, new), new)
        return ways

    ways = with_insertions({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def way(state, value):
            new[state] = min(new.get(state, value), value)

        for state, (cost, letters, out) in ways.items():
            way(state, (cost + 3, letters + "D", out))
            if fault in "bd":
                continue
            more = fault == "t"
            if (state, role[:1]) in follows:
                way(follows[state, role[:1]], (cost + more, letters + "K", [*out, f"{role}:{text}"]))
            for r in "ua":
                if (state, r) in follows:
                    way(follows[state, r], (cost + more + 2, letters + "R", [*out, f"{names[r]}:{text}"]))
        ways = with_insertions(new)
    cost, letters, out = min(ways[s] for s in (0, 3) if s in ways)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def conversations(seed):
    r = random.Random(seed)
    texts = ["Fine.", "What?", "cut off", "", " \n", "Yes!", None, "no end", "é\u2028."]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((conv, r.choice([turn, turn, turn + 3, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2"]), r.choice(texts)))
    rows += [(77, t, ("user", "assistant")[t % 2], f"Turn {t % 70}." if t % 11 else "x") for t in range(300)]
    rows += [(78, 0, "user", "same."), *[(78, 5, "assistant", "same.")] * 50, (79, 0, "user", "long " * 30_000), (79, 1, "assistant", "word " * 30_000 + ".")]
    return rows


@pytest.mark.parametrize("chunk_rows,chunk_chars,parts", [(512, 1 << 20, 1), (4, 50, 7), (1, 10, 3)])
def test_repair(spark, tmp_path, chunk_rows, chunk_chars, parts):
    rows = conversations(5)
    spark.createDataFrame([(*x, "a", "b", "c", "d") for x in rows], TURNS).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        fixed = cr.repair(df, chunk_rows=chunk_rows, chunk_chars=chunk_chars)
        got = {r.conv_id: tuple(r)[1:] for r in fixed.conversations.collect()}
        digests = {r.conv_id: r.repaired_sha256 for r in cr.digests(fixed.pieces).collect()}
        turns = cr.turns(fixed.pieces).orderBy("pid", "k", "i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for conv, *row in rows:
        groups.setdefault(conv, []).append(tuple(row))
    want = {c: plain_repair(sorted(g, key=lambda x: (x[0] is not None, x[0] or 0))) for c, g in groups.items()}
    assert {c: (*v, digests[c]) for c, v in got.items()} == want
    of_long = [t for t in turns if t.conv_id == 77]
    assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in of_long)) and {t.edit for t in of_long} <= set("KRI")


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    fixed = cr.repair(empty)
    assert fixed.conversations.count() == 0 and cr.digests(fixed.pieces).count() == 0 and cr.turns(fixed.pieces).count() == 0


def test_products_may_be_grouped_in_any_way():
    r = random.Random(1)
    for _ in range(200):
        rows = [cr.matrix_of(r.choice("suax"), r.choice("bdt--")) for _ in range(r.randint(1, 9))]
        one = rows[0]
        for m in rows[1:]:
            one = cr.product(one, m)
        assert one == cr.tree_product(rows)


def test_damage(spark):
    rows = [(c, t, "assistant", "Ends. Here! Now?") for c in (None, *range(30)) for t in (None, 0, 1)]
    got = Counter((x.conv_id, x.turn, x.role, x.text) for x in cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want[c, t, "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text] += {0: 0, 3: 2}.get(f, 1)
    assert got == +want


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, times=2):
    out, form = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if o != w and near(w, o))
        form[w] = others[0][1] if others and -others[0][0] >= times * n else None
        out[w] = [form[w], None, n, len(others), -others[0][0] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("letters,crowd", [("ab", 128), ("abé", 3), ("abcdefg", 16), ("a", 1)])
def test_variants(spark, letters, crowd):
    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(400)} | {"x" * 3000, "x" * 2999, "y" + "x" * 2999}
    counts = {w: r.choice([3, 3, 4, 7, 9, 20, 50]) for w in words}
    df = spark.createDataFrame([(n, w, "a", "b") for w, n in counts.items()], "n long, word string, key string, best string").repartition(3)
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(df, least_chars=2, crowd=crowd).collect()}
    assert got == plain_variants(counts)


def test_long_chain_of_forms(spark):
    words = ["abcdefghijklmnop"[:i] for i in range(5, 17)]
    got = {x.word: x.root for x in spelling.variants(spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(words)], "word string, n long")).collect()}
    assert set(got.values()) == {words[-1]}


def test_word_counts(spark):
    r = random.Random(2)
    texts = [None, "", "É école ECOLE École écoles", "can't naïve-ly ×÷ÿ123abcdef", "x" * 100_000 + " word wordy", " ".join("".join(r.choice("abcDE") for _ in range(r.randint(1, 9))) for _ in range(5000))]
    rows = [(i, t, "w", "n") for i, t in enumerate(texts)] + [(None, "Nobody nobody", "w", "n"), (3, texts[3], "w", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n string").repartition(2)
    for damage in (None, 3):
        want = Counter()
        for i, t, *_ in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = run.encode().lower().decode()
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if damage and h % damage == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 5:
                    want[run] += 1
        assert {x.word: x.n for x in spelling.word_counts(df, damage=damage).collect()} == dict(want)
    none = spelling.word_counts(df.limit(0))
    assert none.count() == 0 and spelling.variants(none).count() == 0


URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?y=1", "https://example.com", "https://example.com/en", "https://example.com/en/a.html#f", "ftp://a.www.example.com/en/", "http://notexample.com/en/",
        "http://x.net/es/1", "http://x.net:80/es/1", "http://net/fr/?q", "http://net?/fr/", "x://y://z/p", "http://É.com/Ä/é?Q=1&=2&b", "http://q.org/" + "a/" * 5000, "http://q.org#/x", "mailto:a@b.com"]
RULES = [url_filter.Rule(*x) for x in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))]


def plain_given(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", url.split("://", 1)[1], re.S).groups()
    host = host.encode().lower().decode()
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_given_rules(spark):
    df = spark.createDataFrame([(i, u, "a", "b", "c") for i, u in [*enumerate(URLS), (None, URLS[5]), (3, URLS[3])]], "page_id long, url string, host string, key string, items string")
    got = url_filter.filter_urls(df, spark.createDataFrame([], "url string, block boolean"), RULES).collect()
    assert sorted((str(x.page_id), x.host, x.path, str(x.rule), x.verdict) for x in got) == sorted(
        (str(i), h, p, str(r), v or "allow") for i, u in [*enumerate(URLS), (None, URLS[5]), (3, URLS[3])] for h, p, r, v in [plain_given(u)]
    )
    assert url_filter.filter_urls(df.limit(0), df.select("url", F.lit(True).alias("block")), RULES).count() == 0


def plain_rules(rows, min_rows, min_confidence):
    sets, labelled = Counter(), Counter()
    for items, block in rows:
        for mask in range(1, 1 << len(items)):
            s = tuple(x for k, x in enumerate(items) if mask >> k & 1)
            sets[s] += 1
            labelled[s, block] += 1
    return {(s, "block" if b else "allow"): (n / sets[s], n) for (s, b), n in labelled.items() if n >= min_rows and n / sets[s] >= min_confidence}


def test_mined_rules(spark):
    r = random.Random(4)
    pick = lambda: f"http{r.choice(['', 's'])}://{r.choice(['ads.', 'm.', ''])}{r.choice('abc')}.org/{r.choice(['x', 'casino', 'y'])}/{r.randint(1, 99)}{r.choice(['', '.html', '?ref=1', '#t'])}"
    urls = [pick() for _ in range(300)]
    bad = [("casino" in u and "ads." in u) != (r.random() < 0.1) for u in urls]
    rows = [(u, None if k % 50 == 0 else b, "x", "y") for k, (u, b) in enumerate(zip(urls, bad))]
    df = spark.createDataFrame(rows, "url string, block boolean, items string, parts string")
    parts = {x.url: tuple(x.p) for x in df.select("url", url_filter.parts(F.col("url")).alias("p")).distinct().collect()}
    every = plain_rules([(parts[u], b) for u, b, *_ in rows if b is not None], 6, 0.7)
    mined = url_filter.mine(df, min_support=0.001, min_rows=6, min_confidence=0.7)
    got = {(tuple(x.items_), x.verdict): (x.confidence, x.support) for x in mined.withColumnRenamed("items", "items_").collect()}
    assert set(got.items()) <= set(every.items())
    # What was pruned is covered: a rule with some of its parts, the same label and no less confidence is there.
    assert all(k in got or any(set(s) < set(k[0]) and v == k[1] and c[0] >= every[k][0] for (s, v), c in got.items()) for k in every)
    new = [pick() for _ in range(60)] + ["http://nowhere.net/", None]
    pages = spark.createDataFrame(list(enumerate(new)), "page_id long, url string")
    own = {x.page_id: tuple(x.p) for x in pages.select("page_id", url_filter.parts(F.col("url")).alias("p")).collect()}
    for bound in (0, 100):  # joined, and broadcast
        rules = mined.persist()
        judged = {tuple(x.parts): x.verdict for x in url_filter.judge(pages.select(url_filter.parts(F.col("url")).alias("parts")), rules, bound).collect()}
        for p in own.values():
            fits = [(-c, -n, len(s), v != "block", s, v) for (s, v), (c, n) in every.items() if set(s) <= set(p)]
            assert judged.get(p) == (min(fits)[-1] if fits else None)


def test_parts(spark):
    df = spark.createDataFrame([(u,) for u in [*URLS, "https://Blog.a-b.co.uk:8080/En/12/File.HTML?A=1&b=2&A=3#x"]], "url string")
    got = [x.p for x in df.select("url", url_filter.parts(F.col("url")).alias("p")).collect()]
    assert got[-1] == ["f:", "h:a-b", "h:blog", "h:co", "h:uk", "p:#", "p:en", "p:file", "q:a", "q:b", "s:https", "x:html"] and got[0] == got[1] == got[2] == []

"""Relational, graph, data-flow and metric operators against brute force on small and random inputs."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import callgraph, curation, dataflow, denoise, graphs, metrics, prompts, splits, vectors
from basalt.sources import sinks


def random_graph(r, n):
    return graphs.graph_of([(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 2 * n))], range(n))


def greedy(rows):
    a_seen, b_seen, kept = set(), set(), []
    for o, a, b in rows:
        if a in a_seen or b in b_seen:
            continue
        kept.append(o)
        if a is not None:
            a_seen.add(a)
        if b is not None:
            b_seen.add(b)
    return kept


@pytest.mark.parametrize("seed", [0, 1])
def test_greedy_dedup_is_sequential_greedy(spark, seed):
    r = random.Random(seed)
    rows = [(o, r.choice([None, *"abcdef"]), r.choice([None, *"uvwxyz"])) for o in range(40)]
    df = spark.createDataFrame(rows, "ord int, s string, k string")
    assert sorted(x.ord for x in curation.greedy_dedup(df, "ord", "s", "k").collect()) == greedy(rows)
    three = spark.createDataFrame([(1, "s1", "k1"), (2, "s2", "k1"), (3, "s2", "k3")], df.schema)
    assert sorted(x.ord for x in curation.greedy_dedup(three, "ord", "s", "k").collect()) == [1, 3]
    assert curation.greedy_dedup(df.limit(0), "ord", "s", "k").count() == 0


def test_positions_and_shards(spark):
    df = spark.range(101).select((F.col("id") * 37 % 101).alias("k")).repartition(5)
    got = splits.positions(df, ["k"])
    assert all(x.position == x.k + 1 for x in got.collect())
    assert Counter(x.split for x in splits.split_80_10_10(df, ["k"]).collect()) == {"train": 80, "valid": 10, "test": 11}
    assert Counter(x.shard for x in sinks.shards(got, 4, "position").collect()) == {0: 26, 1: 26, 2: 26, 3: 23}
    assert splits.zip_by_position(df, df.withColumnRenamed("k", "j"), ["k"], ["j"]).filter("k <> j").count() == 0


def test_enrich_keeps_empty_maps(spark):
    fns = spark.createDataFrame([("f1", "c1"), ("f2", "c2")], "fn string, code string")
    edges = spark.createDataFrame([("f1", "f2"), ("f1", "f2"), ("f2", "unknown")], "a string, b string")
    assert {x.fn: x.callees for x in callgraph.enrich(fns, edges, "fn", "code", "a", "b", "callees").collect()} == {"f1": {"f2": "c2"}, "f2": {}}
    instructions = spark.createDataFrame([("f1", "call", "t"), ("f1", "bl", "f2"), ("f1", "mov", "f2"), ("f2", "call", "imp")], "fn string, mnemonic string, target string")
    thunks = spark.createDataFrame([("f1", None), ("f2", None), ("t", "f2"), ("imp", None)], "fn string, thunk_of string")
    imports = spark.createDataFrame([("imp",)], "fn string")
    assert [tuple(x) for x in callgraph.calls_in(instructions, thunks, imports).collect()] == [("f1", "f2", 2)]


def walks(g, n):
    """All maximal paths from n, cut where a node repeats: (nodes, goes round for ever)."""
    out, todo = [], [[n]]
    while todo:
        p = todo.pop()
        if not g[p[-1]]:
            out.append((set(p), False))
        for b in g[p[-1]]:
            if b in p:
                out.append((set(p), True))
            else:
                todo.append([*p, b])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_post_dominators_by_all_walks(seed):
    r = random.Random(seed)
    for _ in range(150):
        g = random_graph(r, r.randint(1, 6))
        least = {n: set() for n in g}
        for _ in range(50):
            for n in g:
                least[n] = {n} | (set.intersection(*(least[b] for b in g[n])) if g[n] else set())
        assert graphs.post_dominators(g) == least
        for n in g:
            ends = [p for p, forever in walks(g, n) if not forever]
            assert graphs.post_dominators(g, True)[n] == ({n} | set.intersection(*ends) if ends else {n})


def test_self_loop_and_zero():
    g = graphs.graph_of([(1, 2), (2, 2), (2, 3)])
    assert graphs.post_dominators(g)[2] == {2} and graphs.post_dominators(g, True)[2] == {2, 3}
    assert graphs.entry_exits({}) == (None, [])


def every_path(g, a, b):
    every, todo = [], [[a]]
    while todo:
        p = todo.pop()
        if p[-1] == b:
            every.append(p)
            continue
        todo += [[*p, x] for x in g[p[-1]] if x not in p]
    return sorted(every, key=lambda p: (len(p), p))


def test_path_covers_by_enumeration(spark):
    r = random.Random(8)
    many = {0: graphs.graph_of([(0, 1)]), 1: graphs.graph_of([(1, 2), (2, 1)])} | {k: random_graph(r, r.randint(1, 8)) for k in range(2, 90)}
    want = {}
    for f, g in many.items():
        start, exits = graphs.entry_exits(g)
        candidates = [p for e in exits for p in every_path(g, start, e)[:4]]
        chosen, covered = [], set()
        for turn in range(3 if candidates else 0):
            best = max(candidates, key=lambda p: len(set(p) - covered)) if turn else min(candidates, key=lambda p: (len(p), p))
            chosen.append(best)
            covered |= set(best)
        want[f] = (sorted(map(list, {tuple(p) for p in chosen})), len(covered) / len(g))
    rows = [(f, a, b) for f, g in many.items() for a in g for b in [*g[a], None]]
    got = {x.fn: (x.path, x.coverage) for x in graphs.paths(spark.createDataFrame(rows, "fn long, src long, dst long"), "fn", 4).collect()}
    assert got == want and got[0] == ([[0, 1]], 1.0) and got[1] == ([], 0.0)


@pytest.mark.parametrize("seed", range(3))
def test_simple_paths_by_enumeration(seed):
    r = random.Random(seed)
    for _ in range(100):
        g = random_graph(r, r.randint(2, 6))
        a, b = r.sample(list(g), 2)
        every = every_path(g, a, b)
        assert graphs.simple_paths(g, a, b, 5) == every[:5]
        assert all(graphs.is_path(g, p) for p in every) and graphs.shortest_path(g, a, b) == (every[0] if every else None)


def test_diamond_paths(spark):
    edges = spark.createDataFrame([("f", 1, 2), ("f", 1, 3), ("f", 2, 4), ("f", 3, 4), ("g", 7, None)], "fn string, src long, dst long")
    got = {x.fn: x for x in graphs.paths(edges, "fn").collect()}
    assert got["f"].path == [[1, 2, 4], [1, 3, 4]] and got["f"].coverage == 1 and got["g"].path == [[7]]
    ends = {x.fn: (x.entry, x.exits, x.n_nodes) for x in graphs.entries_and_exits(edges, "fn").collect()}
    assert ends == {"f": (1, [4], 4), "g": (7, [7], 1)}
    assert {tuple(x)[1:] for x in graphs.control_dependences(edges, "fn").collect()} == {(2, 1), (3, 1)}
    assert graphs.back_edges(graphs.graph_of([(1, 2), (2, 3), (3, 1), (3, 4)])) == {(3, 1)}
    deps = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 9), ("g", 5, 4)], "fn string, use_instr long, def_instr long")
    far = {x.fn: x.positions for x in dataflow.dependence_distances(deps, "fn", 3).collect()}
    assert far == {"f": [[0, 1, 2], [-1, 0, 1], [-1, -1, 0]], "g": [[0, -1, -1], [-1, 0, -1], [-1, -1, 0]]}


def test_exit_paths_by_single_searches(spark):
    r = random.Random(3)
    many = {k: random_graph(r, r.randint(1, 7)) for k in range(80)}
    rows = [(k, a, b) for k, g in many.items() for a in g for b in [*g[a], None]]
    want = set()
    for k, g in many.items():
        start, exits = graphs.entry_exits(g)
        want |= {(k, e, len(p) - 1, tuple(p)) for e in exits if (p := graphs.shortest_path(g, start, e))}
    got = graphs.shortest_exit_paths(spark.createDataFrame(rows, "fn long, src long, dst long"), "fn").collect()
    assert {(x.fn, x.exit, x.length, tuple(x.path)) for x in got} == want and len(got) == len(want)


def random_code(r, n):
    """Graphs and blocks of moves by function; blocks may be empty."""
    regs = ["eax", "ebx", "[rcx]"]
    graphs_ = {k: random_graph(r, r.randint(1, 4)) for k in range(n)}
    return graphs_, {k: {b: [r.choice([f"mov {r.choice(regs)}, {r.choice(regs[:2])}", "nop"]) for _ in range(r.randint(0, 3))] for b in g} for k, g in graphs_.items()}


def code_rows(spark, graphs_, blocks):
    edges = [(k, a, b) for k, g in graphs_.items() for a in g for b in g[a]]
    instructions = [(k, b, n, a) for k, bs in blocks.items() for b, lines in bs.items() for n, a in enumerate(lines)]
    return spark.createDataFrame(instructions, "fn long, block long, pos int, asm string"), spark.createDataFrame(edges, "fn long, src long, dst long")


DEFINES = {"mov eax": ["rax"], "mov ebx": ["rbx"], "mov [rcx]": ["[rcx]", "GLOBAL"], "nop": []}
READS = {"eax": ["rax"], "ebx": ["rbx"]}


def brute_reaching(g, own, defs):
    """Facts flow along edges until nothing is new."""
    todo = [(s, v, i) for b in g for i in own[b] for v in defs[i] if v == "GLOBAL" or not any(v in defs[j] for j in own[b] if j > i) for s in g[b]]
    facts = set()
    while todo:
        f = todo.pop()
        if f in facts:
            continue
        facts.add(f)
        b, v, i = f
        if v == "GLOBAL" or not any(v in defs[j] for j in own[b]):
            todo += [(s, v, i) for s in g[b]]
    return facts


def test_reaching_definitions_by_walks(spark):
    many, blocks = random_code(random.Random(0), 180)
    instructions, edges = code_rows(spark, many, blocks)
    reaching, deps, slices, roots = set(), set(), {}, {}
    for k, g in many.items():
        lines, own = [], {}
        for b in sorted(g):
            own[b] = range(len(lines), len(lines) + len(blocks[k][b]))
            lines += blocks[k][b]
        defs = [DEFINES[a.split(",")[0]] for a in lines]
        reads = [READS[a.split(", ")[1]] + ["rcx"] * ("[rcx]" in a) if a != "nop" else [] for a in lines]
        into = brute_reaching(g, own, defs)
        reaching |= {(k, *f) for f in into}
        met = {}
        for b in g:
            for i in own[b]:
                near = {v: max((j for j in own[b] if j < i and v in defs[j]), default=None) for v in reads[i]}
                met[i] = {x for x in near.values() if x is not None} | {x for c, v, x in into if c == b and v in near and near[v] is None}
        deps |= {(k, i, j) for i, js in met.items() for j in js}
        control = graphs.control_dependence(g)
        above = {i: met[i] | {own[c][-1] for n, c in control if n == b and own[c]} for b in g for i in own[b]}
        important = [i for i, d in enumerate(defs) if "GLOBAL" in d]
        for i in range(len(lines)):
            slices[k, i] = 0
        for root in important:
            seen, todo = {root}, [root]
            while todo:
                fresh = above[todo.pop()] - seen
                seen |= fresh
                todo += fresh
            for i in seen:
                slices[k, i] += 1
        roots[k] = len(important)
    got = [tuple(x) for x in dataflow.reaching_definitions(instructions, edges, "fn").collect()]
    assert set(got) == reaching and len(got) == len(reaching)
    assert sorted(map(tuple, dataflow.data_dependences(instructions, edges, "fn").collect())) == sorted(deps)
    affected = dataflow.importance(instructions, edges, "fn").collect()
    assert {(x.fn, x.instr): x.affected for x in affected} == slices and len(affected) == len(slices)
    assert all(x.importance == pytest.approx(x.affected / (roots[x.fn] + 1e-5)) for x in affected)
    features = {x.fn: x for x in dataflow.code_features(instructions, edges, "fn").collect()}
    assert {(k, d.use_id, d.def_id) for k, x in features.items() for d in x.data_dep} == deps and all([c.asm for c in x.code] == [a for b in sorted(many[k]) for a in blocks[k][b]] for k, x in features.items())


def test_instruction_limit(spark):
    instructions, edges = code_rows(spark, {7: {0: [1], 1: [3], 2: [], 3: []}}, {7: {k: ["nop"] * 1500 for k in range(4)}})
    kept = dataflow.instruction_effects(instructions, "fn")
    assert {x.block for x in kept.select("block").distinct().collect()} == {0, 1} and kept.count() == 3000
    assert [tuple(x) for x in dataflow.flow_within(instructions, edges, "fn").collect()] == [(7, 0, 1)]


def test_dependences_of_whole_long_functions(spark):
    """No block is cut, however many instructions come before it. In one function few blocks write memory and many read it, in the other it is the other way round; a variable's rows span Arrow batches."""
    r = random.Random(5)
    many = {k: {b: sorted({b + 1, r.randrange(60)}) if b < 59 else [] for b in range(60)} for k in range(2)}
    rare, frequent = ("mov [rcx], ebx", "mov eax, [rcx]"), ("mov eax, [rcx]", "mov [rcx], ebx")
    blocks = {k: {b: r.sample(["nop"] * 46 + ["mov eax, ebx", "mov ebx, eax"] + [frequent[k]] * 2 + [rare[k]] * (b % 20 == 7), 50) for b in many[k]} for k in many}
    want = set()
    for k, g in many.items():
        lines = [a for b in g for a in blocks[k][b]]
        own = {b: range(50 * b, 50 * b + 50) for b in g}
        defs = [DEFINES[a.split(",")[0]] for a in lines]
        reads = [[] if a == "nop" else READS.get(a.split(", ")[1], ["[rcx]", "GLOBAL"]) + ["rcx"] * ("[rcx]" in a) for a in lines]
        into = brute_reaching(g, own, defs)
        for b in g:
            for i in own[b]:
                for v in reads[i]:
                    near = max((j for j in own[b] if j < i and v in defs[j]), default=None)
                    want |= {(k, i, x) for c, u, x in into if c == b and u == v} if near is None else {(k, i, near)}
    assert max(i for _, i, _ in want) > 2900
    instructions, edges = code_rows(spark, many, blocks)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [tuple(x) for x in dataflow.data_dependences(instructions, edges, "fn").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert set(got) == want and len(got) == len(want)


def test_code_without_rows(spark):
    instructions, edges = code_rows(spark, {1: {0: []}}, {1: {0: []}})
    assert dataflow.data_dependences(instructions, edges, "fn").count() == dataflow.importance(instructions, edges, "fn").count() == graphs.shortest_exit_paths(edges, "fn").count() == 0
    odd = spark.createDataFrame([(1, None, 0, "nop"), (1, 2, 0, None), (1, 2, None, "ret")], "fn long, block long, pos int, asm string")
    assert [(x.instr, x.asm) for x in dataflow.instruction_effects(odd, "fn").orderBy("instr").collect()] == [(0, "ret"), (1, "")]


def bleu(h, r):
    out, product = [], 1.0
    for n in range(1, 5):
        grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        product *= (sum((grams(h) & grams(r)).values()) + 1e-15) / (max(0, len(h) - n + 1) + 1e-9)
        out.append(product ** (1 / n))
    ratio = (len(h) + 1e-15) / (len(r) + 1e-9)
    return [x * (math.exp(1 - 1 / ratio) if ratio < 1 else 1) for x in out]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_text_metrics(spark):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice("abcd") for _ in range(r.randint(0, 12))), " ".join(r.choice("abcd") for _ in range(r.randint(1, 12)))) for k in range(40)] + [(90, "", "a b"), (91, None, "a"), (92, "a b c d e", "a b c d e"), (93, "x", "")]
    df = spark.createDataFrame(rows, "k int, h string, r string")
    got = {x.k: x for x in metrics.sentence_bleu(df, "k", "h", "r").collect()}
    rouge = {x.k: x.rouge_l for x in metrics.rouge_l(df, "k", "h", "r").collect()}
    for k, h, ref in rows:
        a, b = (h or "").split(), ref.split()
        assert [got[k][f"bleu_{n}"] for n in range(1, 5)] == pytest.approx(bleu(a, b), rel=1e-9)
        n = lcs(a, b)
        p, q = (n / len(a), n / len(b)) if a and b else (0, 0)
        assert rouge[k] == pytest.approx((1 + 1.44) * p * q / (q + 1.44 * p) if n else 0)
    meteor = {x.k: x.meteor_approx for x in metrics.meteor(df, "k", "h", "r").collect()}
    assert meteor[90] == 0 and meteor[93] == 0 and meteor[92] > 0.4 and max(meteor.values()) <= 1
    scored, errors = metrics.score_all(df, "k", "h", "r", metrics.SCORERS | {"broken": lambda *a: 1 / 0})
    assert set(errors) == {"broken"} and scored.count() == len(rows)
    assert metrics.present_systems(df.withColumn("n", F.lit(None)), ["h", "n", "zz"]) == ["h"]


def test_vector_search(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(60, 8)))]
    keys = vectors.normalised_keys(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    got = vectors.search(keys.filter("key < 5").withColumnRenamed("key", "q"), keys, "q", "key", "embedding", k=4, block=16)
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in rows])
    want = {(q, int(k), n) for q in range(5) for n, k in enumerate(np.argsort(-(unit @ unit[q]))[:4], 1)}
    assert {(x.q, x.key, x["rank"]) for x in got.collect()} == want
    encoded = vectors.encode(spark.createDataFrame([("ab",), (None,)], "s string"), "s", lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert sorted(x.embedding for x in encoded.collect()) == [[0.0, 1.0], [2.0, 1.0]]
    assert one_row(vectors.cosine(spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>"), "a", "b")).side == pytest.approx(0.96)


def one_row(df):
    return df.collect()[0]


def test_denoising(spark):
    cands = spark.createDataFrame([("f", 0, "s0", True), ("f", 1, "s1", False), ("f", 2, "s2", None), ("f", 3, "s3", False), ("g", 0, "t", False)], "fn_id string, idx int, fragment string, is_junk boolean")
    code = spark.createDataFrame([("f", "uses zlib here"), ("g", "nothing")], "fn_id string, code string")
    second = spark.createDataFrame([("f", ["zlib", "png"], [(1, True, True), (2, False, True)]), ("g", ["absent"], [(0, True, True)])], "fn_id string, features array<string>, results array<struct<index:int,is_source_match:boolean,is_domain_match:boolean>>")
    tagged = denoise.denoise(cands, code, second)
    assert {(x.fn_id, x.idx): x.tag for x in tagged.collect()} == {("f", 0): "junk", ("f", 1): "strong", ("f", 2): "backup", ("f", 3): "junk", ("g", 0): "uncertain"}
    assert one_row(denoise.totals(tagged)).checks
    assert {x.fn_id: (x.filter_strong, x.filter_backup, x.filter_uncertain) for x in denoise.buckets(tagged).collect()} == {"f": (["s1"], ["s2"], []), "g": ([], [], ["t"])}


def test_path_order_by_permutation(spark):
    r = random.Random(7)
    rows = [(f, p, i, r.choice(["aaa", "bb", "cccccccccccccc", "aaa "])) for f in range(10) for p in range(r.randint(1, 3)) for i in range(r.randint(1, 4))]
    got = {x.fn: (x.path_order, x.cost) for x in prompts.path_order(spark.createDataFrame(rows, "fn int, path int, pos int, content string"), "fn").collect()}
    for f in {x[0] for x in rows}:
        own = {}
        for _, p, i, c in sorted(x for x in rows if x[0] == f):
            own.setdefault(p, []).append(c)
        costs = []
        for o in permutations(sorted(own)):
            seen, cost = set(), 0
            for p in o:
                for c in own[p]:
                    cost += 10 if c.strip() in seen else len(c)
                    seen.add(c.strip())
            costs.append((cost, list(o)))
        assert got[f] == (min(costs)[1], min(costs)[0])


def test_sinks_resume(spark, tmp_path):
    path, calls = str(tmp_path / "done"), []
    df = spark.createDataFrame([(k,) for k in range(5)], "key int")

    def compute(todo):
        calls.append(todo.count())
        return todo.withColumn("v", F.lit(1))

    sinks.append_missing(df.filter("key < 3"), path, "key", compute)
    sinks.append_missing(df, path, "key", compute)
    assert calls == [3, 2] and spark.read.parquet(path).count() == 5
    assert sinks.next_version(df, str(tmp_path / "t"), 1).endswith("v000001")


def test_require_fields(spark):
    df = spark.createDataFrame([("a",), (" ",)], "s string")
    with pytest.raises(Exception, match="empty field s"):
        curation.require_fields(df, ["s"]).collect()
    assert curation.require_fields(df.limit(1), ["s"]).count() == 1


def test_tagged_snippets(spark):
    df = spark.createDataFrame([(["a"], None, ["b", "c"])], "s array<string>, b array<string>, u array<string>")
    assert one_row(df.select(T.tagged_snippets("s", "b", "u", 2).alias("x"))).x == [T.TAG_STRONG + "a", T.TAG_UNCERTAIN + "b"]


def test_post_dominators_of_a_large_function():
    import time

    r = random.Random(3)
    g = graphs.graph_of([(k, k + 1) for k in range(999)] + [(r.randrange(1000), r.randrange(1000)) for _ in range(300)])
    start = time.perf_counter()
    found = graphs.post_dominators(g)
    assert time.perf_counter() - start < 3 and len(found) == 1000 and found[999] == {999}


def test_broken_steps(spark):
    edges = spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("f", 3, None)], "fn string, src long, dst long")
    paths = spark.createDataFrame([("f", [1, 2, 3]), ("f", [1, 3]), ("f", [3]), ("g", [1, 2]), ("f", [])], "fn string, path array<long>")
    got = {(x.fn, tuple(x.path)): x.broken for x in graphs.broken_steps(paths, edges, "fn").collect()}
    assert got == {("f", (1, 2, 3)): 0, ("f", (1, 3)): 1, ("f", (3,)): 0, ("g", (1, 2)): 1, ("f", ()): 0}


def test_back_edges_are_what_keeps_a_graph_from_being_a_dag(spark):
    r = random.Random(11)
    for _ in range(40):
        g = random_graph(r, 7)
        back = graphs.back_edges(g)
        rest = {n: [b for b in bs if (n, b) not in back] for n, bs in g.items()}
        assert all(n not in graphs.reachable(rest, b) for n, bs in rest.items() for b in bs)
        assert all(a in graphs.reachable(g, b) for a, b in back)
    edges = spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("f", 3, 1), ("f", 3, 4), ("g", 5, 5)], "fn string, src long, dst long")
    assert sorted(tuple(x) for x in graphs.back_edge_rows(edges, "fn").collect()) == [("f", 3, 1), ("g", 5, 5)]


def plain_meteor(hyp, ref):
    """METEOR by loops over all pairs: exact matches, then stems, each to the free word nearest to where the last match goes on."""
    if not hyp or not ref:
        return 0.0
    pairs, weight = {}, 0.0
    for form, w in ((str.lower, 1.0), (lambda x: metrics._stem(x.lower()), 0.6)):
        free = [j for j in range(len(ref)) if j not in pairs.values()]
        for i, x in enumerate(hyp):
            if i in pairs:
                continue
            fits = [j for j in free if form(ref[j]) == form(x)]
            if fits:
                goal = pairs[i - 1] + 1 if i - 1 in pairs else i
                j = min(fits, key=lambda j: (abs(j - goal), j))
                pairs[i] = j
                free.remove(j)
                weight += w
    if not pairs:
        return 0.0
    p, q = weight / len(hyp), weight / len(ref)
    mean = p * q / (0.85 * p + 0.15 * q)
    chunks = sum(1 for i in pairs if i - 1 not in pairs or pairs[i - 1] + 1 != pairs[i])
    return mean if len(pairs) == 1 and chunks == 1 else mean * (1 - 0.6 * (chunks / len(pairs)) ** 0.2)


def test_meteor_is_the_plain_version():
    r = random.Random(12)
    vocabulary = ["Run", "runs", "running", "the", "cat", "cats", "a", "Sat"]
    for _ in range(500):
        h, f = ([r.choice(vocabulary) for _ in range(r.randint(0, 9))] for _ in "hf")
        assert metrics._meteor(h, f) == pytest.approx(plain_meteor(h, f)), (h, f)


def test_path_order_is_the_cheapest_permutation(spark):
    r = random.Random(13)
    rows = [(f, p, i, r.choice(["aa", "bbb", " bbb", "cccccccccccccc", "cccccccccccccc  ", ""])) for f in range(40) for p in range(r.randint(1, 3)) for i in range(r.randint(1, 5))]
    got = {x.fn: (x.path_order, x.cost) for x in prompts.path_order(spark.createDataFrame(rows, "fn long, path int, pos int, content string"), "fn").collect()}
    for f in range(40):
        own = [x for x in rows if x[0] == f]
        costs = []
        for order in permutations(sorted({x[1] for x in own})):
            seen, cost = set(), 0
            for p in order:
                for _, _, _, c in sorted((x for x in own if x[1] == p), key=lambda x: x[2]):
                    cost += 10 if c.strip() in seen else len(c)
                    seen.add(c.strip())
            costs.append((cost, list(order)))
        assert got[f] == (min(costs)[1], min(costs)[0])


def test_thunks_of_code_and_external_functions(spark):
    rows = [("t", "go", "// attributes: thunk\nint go() { return real(1); }", ".text", "push"), ("r", "real", "int real(int a) { a = 2; return a; }", ".text", "push"), ("p", "x", "int x;", ".plt", "push"), ("e", "y", "  ", ".text", "push"), ("j", "z", "int z;", None, "jmp"), ("i", "w", "int w;", ".text", None)]
    fns = spark.createDataFrame(rows, "fn string, name string, code string, segment string, mnemonic string")
    assert {x.fn: x.thunk_of for x in callgraph.thunk_links(fns).collect()} == {"t": "r", "r": None, "p": None, "e": None, "j": None, "i": None}
    assert sorted(x.fn for x in callgraph.without_external(fns, spark.createDataFrame([("i",)], "fn string")).collect()) == ["r", "t"]


def test_caller_maps_have_a_bound(spark):
    counts = spark.createDataFrame([(f"c{k}", "hub", 1) for k in range(30)] + [("c0", "leaf", 2)], "caller string, callee string, n long")
    got = {x.callee: (x.n_callers, x.callers) for x in callgraph.caller_maps(counts, 10).collect()}
    assert got == {"hub": (30, None), "leaf": (1, {"c0": 2})} and callgraph.callers_of(counts).count() == 31


def test_bleu_of_several_references_takes_the_closest_length():
    assert metrics._bleu_counts("a b c".split(), ["a b c d e".split(), "a x".split()])[:3] == (3, 2, 3)
    assert metrics._bleu_counts("a a b".split(), ["a b".split(), "a a a".split()])[2:4] == (3, 2)
    assert metrics._bleu_counts([], [[]]) == (0, 0, 0, 0, 0, 0)


def test_definitions_that_reach_a_block_are_not_dealt_by_variable(spark):
    """Memory that many blocks write and none reads: the written definitions and the blocks they reach are no rows that are shuffled, and instructions are dealt once, by function."""
    rows = [(f, b, 0, "mov dword ptr [rax+8], rbx") for f in range(3) for b in range(1, 20)] + [(f, 20, 0, "mov rcx, rax") for f in range(3)]
    code = spark.createDataFrame(rows, "fn long, block long, pos long, asm string")
    edges = spark.createDataFrame([(f, b, b + 1) for f in range(3) for b in range(1, 20)], "fn long, src long, dst long")
    found = dataflow.data_dependences(code, edges, "fn")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*\b(var|block)#", plan)
    assert found.count() == 0
    again = dataflow.data_dependences(code.unionByName(spark.createDataFrame([(0, 1, 1, "mov rdx, [rax+8]"), (1, 20, 1, "mov rdx, [rax+8]")], code.schema)), edges, "fn")
    assert {(0, 1, 0)} <= {tuple(x) for x in again.collect()}
    assert {(x.use_instr, x.def_instr) for x in again.filter("fn = 1").collect()} >= {(20, 18)}

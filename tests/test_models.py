"""Graph layers, flow graphs, pickles, caches and table functions against plain versions."""

import gzip
import json
import os
import pickle
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from basalt.functions import tables
from basalt.functions import text as T
from basalt.operators import callgraph, flowgraph, messages, prompts
from basalt.sources import manifest, pickles

IN, HEADS, WIDTH, TYPES = 5, 2, 3, 2


def layer(kind, seed=1, inputs=IN):
    r = np.random.default_rng(seed)
    w = HEADS * WIDTH
    return messages.Layer(kind, r.normal(size=(inputs, w)), HEADS, r.normal(size=(inputs, w)), r.normal(size=w), r.normal(size=w), r.normal(size=(HEADS, WIDTH)), r.normal(size=(HEADS, WIDTH)), r.normal(size=(TYPES, w)), r.normal(size=(HEADS, WIDTH)), r.normal(size=w))


def plain_layer(x, edges, m, typed):
    """One layer node by node. x: node to vector; edges: (src, dst, type)."""
    left = {n: v @ m.left + m.left_bias for n, v in x.items()}
    out = {}
    for n, v in x.items():
        own = [(s, t) for s, d, t in edges if d == n and s in x]
        if m.kind == messages.SAGE:
            mean = np.mean([x[s] for s, _ in own], axis=0) if own else np.zeros(len(v))
            out[n] = mean @ m.left + m.left_bias + v @ m.right
            continue
        own = [(s, np.eye(TYPES)[t]) for s, t in own if s != n]
        own.append((n, np.mean([t for _, t in own], axis=0) if own else np.zeros(TYPES)))
        value = np.zeros((HEADS, WIDTH))
        for h in range(HEADS):
            part = slice(h * WIDTH, (h + 1) * WIDTH)
            logits = []
            for s, t in own:
                e = (t @ m.edge if typed else np.zeros(HEADS * WIDTH))[part]
                if m.kind == messages.GATV2:
                    z = left[s][part] + (v @ m.right + m.right_bias)[part] + e
                    logits.append(np.where(z > 0, z, 0.2 * z) @ m.attention[h])
                else:
                    z = left[s][part] @ m.attention[h] + left[n][part] @ m.attention_right[h] + e @ m.attention_edge[h]
                    logits.append(z if z > 0 else 0.2 * z)
            a = np.exp(np.array(logits) - max(logits))
            value[h] = (a / a.sum()) @ np.array([left[s][part] for s, _ in own])
        out[n] = value.ravel() + m.bias
    return out


@pytest.fixture(scope="module")
def graph():
    r = random.Random(3)
    x = {n: np.array([r.gauss(0, 1) for _ in range(IN)]) for n in range(40)}
    edges = [(r.randrange(42), r.randrange(42), r.randrange(TYPES)) for _ in range(120)] + [(n, 7, 1) for n in range(40)] * 3 + [(3, 3, 0), (5, 9, 1), (5, 9, 1)]
    return x, edges


@pytest.mark.parametrize("kind", [messages.GATV2, messages.GAT, messages.SAGE])
@pytest.mark.parametrize("typed", [True, False])
def test_layers(spark, graph, kind, typed):
    x, edges = graph
    nodes = spark.createDataFrame([(n, v.tolist(), "clash") for n, v in x.items()], "node long, x array<double>, message string").repartition(3)
    rows = spark.createDataFrame([*edges, (None, 3, 0), (3, None, 0)], "src long, dst long, t int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        got = {r.node: r.x for r in messages.encode_graph(nodes, rows, [layer(kind)], edge_type="t" if typed else None).collect()}
        two = {r.node: r.x for r in messages.encode_graph(nodes, rows, [layer(kind), layer(kind, 2, HEADS * WIDTH)], edge_type="t" if typed else None).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plain_layer(x, edges, layer(kind), typed)
    assert got.keys() == want.keys() and all(np.allclose(got[n], want[n]) for n in want)
    hidden = {n: np.where(v > 0, v, np.expm1(v)) for n, v in want.items()}
    want = plain_layer(hidden, edges, layer(kind, 2, HEADS * WIDTH), typed)
    assert all(np.allclose(two[n], want[n]) for n in want)


def test_layers_of_nothing(spark):
    nodes = spark.createDataFrame([], "node long, x array<double>")
    edges = spark.createDataFrame([], "src long, dst long, t int")
    assert messages.attention(nodes, edges, layer(messages.GATV2), edge_type="t").count() == 0
    assert messages.mean_messages(nodes, edges).count() == 0


def test_states_merge_in_any_order():
    r = np.random.default_rng(0)
    top, value = r.normal(size=(50, HEADS)) * 300, r.normal(size=(50, HEADS, WIDTH))
    codes = r.integers(0, 4, 50)
    whole = messages.merged(codes, top, np.ones_like(top), value)
    parts = [messages.merged(codes[i : i + 10], top[i : i + 10], np.ones((10, HEADS)), value[i : i + 10]) for i in range(0, 50, 10)]
    again = messages.merged(*(np.concatenate(x) for x in zip(*parts)))
    assert all(np.allclose(a, b) for a, b in zip(whole, again))


def test_weights_have_a_bound(spark, monkeypatch):
    rows = spark.createDataFrame([("left", 0, [1.0, 2.0]), ("left", 1, [3.0, 4.0]), ("bias", 0, [5.0, 6.0])], "part string, at int, values array<double>")
    got = messages.layer_of(rows, messages.SAGE)
    assert got.left.tolist() == [[1, 2], [3, 4]] and got.bias.tolist() == [5, 6]
    monkeypatch.setattr(messages, "MOST_WEIGHTS", 5)
    with pytest.raises(ValueError):
        messages.layer_of(rows, messages.SAGE)


def plain_flow(code):
    """code: address to (mnemonic, target) of one function. Blocks by leader, and edges."""
    order = sorted(code)
    kind = lambda m: "jump" if m in ("jmp", "b") else "end" if m in ("retn", "hlt") else "branch" if m in ("jz", "jnz", "loop", "cbz", "b.eq", "beq") else "plain"
    leaders = {order[0]} | {b for a, b in zip(order, order[1:]) if kind(code[a][0]) != "plain"} | {t for m, t in code.values() if kind(m) in ("jump", "branch") and t in code}
    blocks, edges = {}, set()
    for a in order:
        if a in leaders:
            now = a
        blocks.setdefault(now, []).append(a)
    for b, members in blocks.items():
        m, t = code[members[-1]]
        after = next((x for x in order if x > members[-1]), None)
        out = {after} if kind(m) in ("plain", "branch") else set()
        out |= {t} if kind(m) in ("jump", "branch") and t in code else set()
        edges |= {(b, x) for x in out - {None}} or {(b, None)}
    return {b: len(m) for b, m in blocks.items()}, edges


@pytest.mark.parametrize("parts", [1, 7])
def test_flow_graphs(spark, parts):
    r = random.Random(parts)
    listings = {f: {a * 4: (r.choice(["mov", "add", "call", "jz", "jnz", "jmp", "retn", "loop", "bl", "b.eq", "cbz", "beq", "blr", "push", "b", "hlt"]), r.choice([None, r.randrange(n) * 4, r.randrange(n) * 4, 3, -8])) for a in range(n)} for f, n in enumerate([1, 2, 30, 400, 5, 90])}
    rows = [(f, a, m, t, "x", 5) for f, code in listings.items() for a, (m, t) in code.items()] + [(None, 1, "mov", None, "x", 5), (1, None, "mov", None, "x", 5)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "fn long, address long, mnemonic string, target long, kind string, block int").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        placed = flowgraph.placed_instructions(df)
        blocks = flowgraph.blocks(placed).persist()
        got, edges = {(x.fn, x.block): x.n for x in blocks.collect()}, {tuple(x) for x in flowgraph.flow_edges(blocks).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {f: plain_flow(code) for f, code in listings.items()}
    assert got == {(f, b): n for f, (bs, _) in want.items() for b, n in bs.items()}
    assert edges == {(f, *e) for f, (_, es) in want.items() for e in es}
    assert flowgraph.flow_edges(flowgraph.blocks(flowgraph.placed_instructions(df.limit(0)))).count() == 0


class Evil:
    def __reduce__(self):
        return os.system, ("touch /tmp/never",)


def test_pickles(spark, tmp_path, monkeypatch):
    good = [{"a": 1, "b": "x", "c": [1.5, None]}, {"a": None, "z": {(1, 2): {3}}}, 7]
    loop = []
    loop.append(loop)
    laughs = ["ha"]
    for _ in range(40):
        laughs = [laughs, laughs]
    files = {
        "good.pkl.gz": gzip.compress(pickle.dumps(good)), "old.pkl": pickle.dumps([good[0], {}, 7], 0), "one.pkl": pickle.dumps({"a": 5, "k": {b"x", b"y"}}, 4), "list.json": json.dumps(good[:1]).encode(), "two.pkl.gz": gzip.compress(pickle.dumps([{"a": 9}])[:10]) + gzip.compress(pickle.dumps([{"a": 9}])[10:]),
        "evil.pkl.gz": gzip.compress(pickle.dumps([1, Evil()])), "set.pkl": pickle.dumps({1}, 2), "evil2.pkl": b"cbuiltins\neval\n(S'1'\ntR.", "loop.pkl": pickle.dumps(loop), "laughs.pkl": pickle.dumps(laughs), "cut.pkl.gz": gzip.compress(pickle.dumps(good))[:-12], "text.pkl": b"hello", "bomb.gz": gzip.compress(b"\0" * 5_000_000), "skipped.txt": b"x",
    }
    for name, data in files.items():
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / name).write_bytes(data)
    monkeypatch.setattr(pickles, "MOST_VALUES", 100_000)
    read = pickles.pickled_records(spark.read.format("binaryFile").option("pathGlobFilter", "*.{pkl,gz,json}").load(str(tmp_path / "d")), "a long, b string, c array<double>", most=1_000_000).collect()
    by = {}
    for x in read:
        by.setdefault(x.path.rsplit("/", 1)[-1], []).append((x.position, x.record and (x.record.a, x.record.b, x.record.c), x.error))
    three = [(0, (1, "x", [1.5, None]), None), (1, (None, None, None), None), (2, (None, None, None), None)]
    assert sorted(by["good.pkl.gz"]) == three and sorted(by["old.pkl"]) == three and by["one.pkl"] == [(0, (5, None, None), None)] and by["list.json"] == three[:1] and by["two.pkl.gz"] == [(0, (9, None, None), None)]
    bad = {k: v for k, v in by.items() if v[0][2]}
    assert bad.keys() == {"set.pkl", "evil.pkl.gz", "evil2.pkl", "loop.pkl", "laughs.pkl", "cut.pkl.gz", "text.pkl", "bomb.gz"} and all(len(v) == 1 and v[0][0] is None for v in bad.values())
    assert "system" in bad["evil.pkl.gz"][0][2] and "refused" in bad["bomb.gz"][0][2] and not os.path.exists("/tmp/never")
    assert len(pickles.pickle_files(spark, str(tmp_path / "d"), "a long").select("path").distinct().collect()) == 13


def test_cache_follows_its_input(spark, tmp_path):
    store, asked = str(tmp_path / "store"), []
    schema = "k long, j string, v string, entry_ string"

    def compute(rows):
        asked.append(sorted((x.k, x.j, x.v) for x in rows.select("k", "j", "v").fillna("-").fillna(-1).collect()))
        return rows.select("entry", "k", "j", F.upper("v").alias("big"))

    def refresh(rows):
        return manifest.refresh(spark.createDataFrame([(*r, "x") for r in rows], schema), store, ["k", "j"], compute)

    def now():
        return sorted((x.k, x.j, x.big, x.version) for x in manifest.results(spark, store).fillna("-").fillna(-1).collect())

    with pytest.raises(AnalysisException):
        manifest.results(spark, store)
    assert refresh([(1, "a", "x"), (2, "a", "y"), (None, "a", "z"), (None, None, None), (1, "a", "x")]) == 1
    assert now() == [(-1, "-", "-", 1), (-1, "a", "Z", 1), (1, "a", "X", 1), (2, "a", "Y", 1)]
    assert refresh([(1, "a", "x"), (2, "a", "y"), (None, "a", "z"), (None, None, None)]) == 1 and len(asked) == 1
    # A run that ended before its manifest was written is not seen, and is written over.
    spark.createDataFrame([("e", 1, "a", "BAD")], "entry string, k long, j string, big string").write.parquet(f"{store}/results/version=2")
    assert now()[-1] == (2, "a", "Y", 1) and len(now()) == 4
    assert refresh([(1, "a", "changed"), (None, "a", "z"), (None, None, "set"), (5, "a", "new")]) == 2
    assert asked[1] == [(-1, "-", "set"), (1, "a", "changed"), (5, "a", "new")]
    assert now() == [(-1, "-", "SET", 2), (-1, "a", "Z", 1), (1, "a", "CHANGED", 2), (5, "a", "NEW", 2)]
    assert refresh([(2, "a", "y")]) == 3 and now() == [(2, "a", "Y", 3)]
    manifest.compact(spark, store, str(tmp_path / "other"))
    assert [(x.big, x.version) for x in manifest.results(spark, str(tmp_path / "other")).collect()] == [("Y", 1)]
    assert refresh([]) == 4 and now() == []


def test_table_function(spark):
    tables.register(spark)
    spark.createDataFrame([("a.c", "/* Adds. */\nint add(int a) { return a; }\nint sub(int a) { return -a; }"), ("b.c", None), ("c.c", "")], "file string, text string").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT f.file, c.function_name FROM some_files f, LATERAL c_functions(f.text) c").collect()
    assert sorted(map(tuple, got)) == [("a.c", "add"), ("a.c", "sub")]


def test_enrichment_has_a_bound(spark):
    fns = spark.createDataFrame([(n, f"c{n}") for n in range(30)], "fn int, code string")
    edges = spark.createDataFrame([(0, n) for n in range(60, 0, -1)] + [(1, 2), (1, 2), (2, 99)], "a int, b int")
    got = {x.fn: x.m for x in callgraph.enrich(fns, edges, "fn", "code", "a", "b", "m", most=5).collect()}
    assert got[0] == {n: f"c{n}" for n in range(1, 6)} and got[1] == {2: "c2"} and got[2] == {} and len(got) == 30


def test_one_rule_for_poor_summaries(spark):
    said = [None, "", "  ", "This function adds.", "this code", "Performs a check.", "Performs a check of all its arguments now.", "Does.", "Adds two numbers.", "w " * 30, "w " * 31, "handles one two three four five", "handles one two three four five six"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string").select("k", T.is_bad_summary("s").alias("bad")).collect()
    assert {x.k: x.bad for x in rows} == {k: T.bad_summary(s) for k, s in enumerate(said)}


def test_unit_is_linear(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [])], "k int, v array<float>").select("k", T.unit("v").alias("u")).collect()
    assert {x.k: x.u for x in rows} == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: None, 3: []}


def test_prompts_take_the_cheapest_order(spark):
    long = "L" * 50
    # Shown first, path 1 shows the long form of the block that both have: the other order is cheaper.
    blocks = [("f", 0, 0, "  " + long + "  "), ("f", 0, 1, "a"), ("f", 1, 0, long), ("g", 0, 0, "x")] + [("many", p, 0, f"b{p}") for p in range(6)]
    df = spark.createDataFrame(blocks, "fn string, path int, pos int, content string")
    got = {x.fn: x.prompt_blocks for x in prompts.in_best_order(df, "fn").collect()}
    assert got["f"] == f"Path 1:\n{long}\n\nPath 0:\nSame as REF_1_0\na" and got["g"] == "Path 0:\nx" and got["many"].startswith("Path 0:\nb0\n\nPath 1:")

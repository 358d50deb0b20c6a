"""Registered queries of graph layers, flow graphs, pickles, caches and table functions, with their SQL."""

from __future__ import annotations

import gzip
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import tables
from basalt.functions import text as T
from basalt.operators import dataflow, decoding, flowgraph, learning, messages, meteor, sparse_encoder, vectors
from basalt.plans.code_queries import _CODE, _files, _instructions
from basalt.plans.queries import _PAIRS, _pairs
from basalt.plans.registry import ORACLE_SQL, query, table
from basalt.sources import manifest, pickles
from basalt.sources.shared import kept, scratch_folder

# Message passing. The graph: each vector has edges to the next three by id, of type 0 and 1, and the ids divisible by 50 to vector 7, a hub. The first vectors are the layer's weights.

HEADS, WIDTH = 2, 4
_W = HEADS * WIDTH
_NODES = """n AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT * FROM (SELECT vec_id AS src, unnest([vec_id + 1, vec_id + 2, vec_id + 3]) AS dst, unnest([0, 1, 0]) AS t FROM embeddings UNION ALL SELECT vec_id, 7, 1 FROM embeddings WHERE vec_id % 50 = 0) WHERE src <> dst AND dst IN (SELECT vec_id FROM n))"""
_ALL = f"""ids AS (SELECT vec_id AS dst FROM n), mean AS (SELECT dst, avg(CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE 0 END) AS s0, avg(CASE WHEN t = 1 THEN 1.0::DOUBLE ELSE 0 END) AS s1 FROM e GROUP BY dst),
every AS (SELECT src, dst, CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE 0 END AS s0, CASE WHEN t = 1 THEN 1.0::DOUBLE ELSE 0 END AS s1 FROM e UNION ALL SELECT ids.dst, ids.dst, coalesce(s0, 0), coalesce(s1, 0) FROM ids LEFT JOIN mean ON ids.dst = mean.dst),
weight AS (SELECT list(x ORDER BY vec_id) AS w FROM n WHERE vec_id < 24),
p AS (SELECT vec_id, list_transform(range(1, {_W + 1}), lambda c: list_dot_product(x, w[c])) AS l, list_transform(range(1, {_W + 1}), lambda c: list_dot_product(x, w[c + {_W}])) AS r FROM n, weight)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, weights)."""
    vectors = table(spark, d, "embeddings")
    nodes = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    near = vectors.select(F.col("vec_id").alias("src"), F.posexplode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("t", "dst")).select("src", "dst", (F.col("t") % 2).alias("t"))
    hub = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("src"), F.lit(7).cast("long").alias("dst"), F.lit(1).alias("t"))
    first = nodes.filter("vec_id < 24").select((F.col("vec_id")).alias("at"), "x")
    part = lambda name, low, high, values: first.filter((F.col("at") >= low) & (F.col("at") < high)).select(F.lit(name).alias("part"), F.col("at").cast("int").alias("at"), values.alias("values"))
    head = lambda k: F.slice("x", 1 + k * WIDTH, WIDTH)
    weights = part("left", 0, _W, F.col("x")).unionByName(part("right", _W, 2 * _W, F.col("x")))
    for name, row in (("attention", 16), ("attention_right", 17), ("attention_edge", 18)):
        for k in range(HEADS):
            weights = weights.unionByName(part(name, row, row + 1, head(k)).withColumn("at", F.lit(k)))
    weights = weights.unionByName(part("edge", 19, 21, F.slice("x", 1, _W))).unionByName(part("bias", 21, 22, F.slice("x", 1, _W)))
    return nodes, near.unionByName(hub), weights


def _layer(weights: DataFrame, kind: str) -> messages.Layer:
    """Columns of the projections are rows of the table."""
    layer = messages.layer_of(weights, kind, HEADS)
    return layer._replace(left=layer.left.T, right=layer.right.T)


def _element(k: int) -> Column:
    """Element k of x, rounded; a zero has no sign."""
    x = F.round(F.get("x", F.lit(k)), 6)
    return F.when(x == 0, 0.0).otherwise(x).alias(f"x{k}")


def _out(found: DataFrame) -> DataFrame:
    return found.select("vec_id", *map(_element, range(_W)))


def _without_signed_zeros(keys: str, n: int, sql: str) -> str:
    return f"SELECT {keys}, {', '.join(f'CASE WHEN x{k} = 0 THEN 0.0::DOUBLE ELSE x{k} END AS x{k}' for k in range(n))} FROM ({sql})"


_SOFTMAX = f"""m AS (SELECT dst, h, max(z) AS z FROM z GROUP BY ALL),
o AS (SELECT z.dst, z.h, sum(exp(z.z - m.z)) AS s, {", ".join(f"sum(exp(z.z - m.z) * l[z.h * {WIDTH} + {k + 1}]) AS v{k}" for k in range(WIDTH))} FROM z JOIN m ON m.dst = z.dst AND m.h = z.h GROUP BY ALL)
SELECT dst AS vec_id, {", ".join(f"round(max(v{k % WIDTH} / s) FILTER (h = {k // WIDTH}) + any_value(w[22][{k + 1}]), 6) AS x{k}" for k in range(_W))} FROM o, weight GROUP BY dst"""


@query(_without_signed_zeros("vec_id", _W, f"""WITH {_NODES}, {_ALL},
q AS (SELECT dst, a.l, list_transform(range(1, {_W + 1}), lambda c: a.l[c] + b.r[c] + s0 * w[20][c] + s1 * w[21][c]) AS z, w[17] AS att FROM every JOIN p a ON a.vec_id = src JOIN p b ON b.vec_id = dst, weight),
z AS (SELECT dst, l, h, list_sum(list_transform(range(1, {WIDTH + 1}), lambda k: att[h * {WIDTH} + k] * CASE WHEN z[h * {WIDTH} + k] > 0 THEN z[h * {WIDTH} + k] ELSE 0.2::DOUBLE * z[h * {WIDTH} + k] END)) AS z FROM q, range({HEADS}) t(h)),
{_SOFTMAX}"""))
def graph_attention(spark, d):
    """GR19: a layer of dynamic attention with edge types, two heads, over all vectors; node 7 is a hub."""
    nodes, edges, weights = _graph(spark, d)
    return _out(messages.attention(nodes, edges, _layer(weights, messages.GATV2), "vec_id", "x", edge_type="t"))


@query(_without_signed_zeros("vec_id", _W, f"""WITH {_NODES}, {_ALL},
q AS (SELECT dst, a.l, a.l AS ls, b.l AS lt, s0, s1, w FROM every JOIN p a ON a.vec_id = src JOIN p b ON b.vec_id = dst, weight),
y AS (SELECT dst, l, h, list_sum(list_transform(range(1, {WIDTH + 1}), lambda k: ls[h * {WIDTH} + k] * w[17][h * {WIDTH} + k] + lt[h * {WIDTH} + k] * w[18][h * {WIDTH} + k] + (s0 * w[20][h * {WIDTH} + k] + s1 * w[21][h * {WIDTH} + k]) * w[19][h * {WIDTH} + k])) AS y FROM q, range({HEADS}) t(h)),
z AS (SELECT dst, l, h, CASE WHEN y > 0 THEN y ELSE 0.2::DOUBLE * y END AS z FROM y),
{_SOFTMAX}"""))
def graph_attention_static(spark, d):
    """GR19: the same with static attention."""
    nodes, edges, weights = _graph(spark, d)
    return _out(messages.attention(nodes, edges, _layer(weights, messages.GAT), "vec_id", "x", edge_type="t"))


@query(_without_signed_zeros("vec_id", _W, f"""WITH {_NODES}, weight AS (SELECT list(x ORDER BY vec_id) AS w FROM n WHERE vec_id < 24),
means AS (SELECT dst, {", ".join(f"avg(x[{k}]) AS m{k}" for k in range(1, 65))} FROM e JOIN n ON n.vec_id = src GROUP BY dst),
s AS (SELECT n.vec_id, x, CASE WHEN dst IS NULL THEN list_transform(range(64), lambda i: 0.0::DOUBLE) ELSE [{", ".join(f"m{k}" for k in range(1, 65))}] END AS mean FROM n LEFT JOIN means ON dst = vec_id)
SELECT vec_id, {", ".join(f"round(list_dot_product(mean, w[{k + 1}]) + list_dot_product(x, w[{k + 1 + _W}]), 6) AS x{k}" for k in range(_W))} FROM s, weight"""))
def graph_sage(spark, d):
    """GR19: mean aggregation with weights."""
    nodes, edges, weights = _graph(spark, d)
    return _out(messages.encode_graph(nodes, edges, [_layer(weights, messages.SAGE)], "vec_id", "x"))


# Flow graphs. A customer is a function, the lines of their orders its instructions; a jump leads into its own order, or to the first order.

MNEMONICS = ("mov", "add", "jz", "cmp", "call", "jnz", "lea", "jmp", "xor", "test", "retn", "push")
_LISTING = f"""first AS (SELECT o_custkey AS fn, min(o_orderkey) AS low FROM orders GROUP BY 1),
m AS (SELECT o_custkey AS fn, l_orderkey * 8 + l_linenumber AS address, {list(MNEMONICS)}[(l_partkey + l_linenumber) % {len(MNEMONICS)} + 1] AS mnemonic, l_orderkey * 8 + (l_linenumber + l_suppkey) % 7 + 1 AS near, low * 8 + 1 AS back
      FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey JOIN first ON fn = o_custkey),
listing AS (SELECT fn, address, mnemonic, CASE WHEN mnemonic = 'jmp' THEN back WHEN mnemonic IN ('jz', 'jnz') THEN near END AS target,
            CASE mnemonic WHEN 'jmp' THEN 'jump' WHEN 'jz' THEN 'branch' WHEN 'jnz' THEN 'branch' WHEN 'retn' THEN 'end' ELSE 'plain' END AS kind FROM m),
led AS (SELECT *, lead(address) OVER o AS following, CASE WHEN coalesce(lag(kind) OVER o, 'end') <> 'plain' OR (fn, address) IN (SELECT (fn, target) FROM listing WHERE target IS NOT NULL) THEN address END AS leader
        FROM listing WINDOW o AS (PARTITION BY fn ORDER BY address)),
placed AS (SELECT *, max(leader) OVER (PARTITION BY fn ORDER BY address) AS block FROM led)"""


def _listing(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("fn"))
    first = orders.groupBy("fn").agg(F.min("l_orderkey").alias("low"))
    # An order's line numbers repeat: one line of each.
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    lines = lines.join(orders, "l_orderkey").join(first, "fn")
    at: Column = F.col("l_orderkey") * 8
    mnemonic = F.get(F.array(*map(F.lit, MNEMONICS)), ((F.col("l_partkey") + F.col("l_linenumber")) % len(MNEMONICS)).cast("int"))
    code = lines.select("fn", (at + F.col("l_linenumber")).alias("address"), mnemonic.alias("mnemonic"), (at + (F.col("l_linenumber") + F.col("l_suppkey")) % 7 + 1).alias("near"), (F.col("low") * 8 + 1).alias("back"))
    return code.select("fn", "address", "mnemonic", F.when(F.col("mnemonic") == "jmp", F.col("back")).when(F.col("mnemonic").isin("jz", "jnz"), F.col("near")).alias("target"))


@query(f"WITH {_LISTING} SELECT fn, block, max(address) AS last, count(*) AS n, arg_max(kind, address) AS kind FROM placed GROUP BY fn, block")
def flow_blocks(spark, d):
    """SC8: basic blocks of linear listings."""
    return flowgraph.blocks(flowgraph.placed_instructions(_listing(spark, d))).select("fn", "block", "last", "n", "kind")


@query(f"""WITH {_LISTING}, b AS (SELECT fn, block, arg_max(kind, address) AS kind, arg_max(target, address) AS target, max(following) AS following, max(address) AS last FROM placed GROUP BY fn, block),
z AS (SELECT p.fn, p.block, p.kind, p.target, p.following FROM placed p JOIN b ON b.fn = p.fn AND b.block = p.block AND b.last = p.address),
ways AS (SELECT fn, block AS src, following AS dst FROM z WHERE kind IN ('plain', 'branch') UNION SELECT fn, block, target FROM z WHERE kind IN ('jump', 'branch')),
edges AS (SELECT w.fn, src, dst FROM ways w JOIN z ON z.fn = w.fn AND z.block = w.dst)
SELECT fn, src, dst FROM edges UNION ALL SELECT fn, block, NULL FROM z WHERE (fn, block) NOT IN (SELECT (fn, src) FROM edges)""")
def flow_graph(spark, d):
    """SC8: the edges of the blocks."""
    return flowgraph.flow_edges(flowgraph.blocks(flowgraph.placed_instructions(_listing(spark, d))))


# Sources: pickles, caches that follow their input, table functions.

#: A pickle that would run a command if it were loaded by Python's own reader.
HOSTILE = b"cos\nsystem\n(S'true'\ntR."


@query("SELECT doc_id, text, lang, source, n_chars, NULL AS error FROM documents UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'refused: os.system'")
def pickled_tables(spark, d):
    """SC16: all documents as gzipped pickles of records, a file a batch, read back; beside them a file that names a global, which is refused."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(["documents"]), pa.array([gzip.compress(pickle.dumps(b.to_pylist()))], pa.binary())], names=["path", "content"])

    files = docs.mapInArrow(run, "path string, content binary").unionByName(spark.range(1).select(F.lit("hostile").alias("path"), F.lit(HOSTILE).alias("content")))
    return pickles.pickled_records(files, "doc_id long, text string, lang string, source string, n_chars long").select("record.*", "error")


@query(r"""WITH v1 AS (SELECT doc_id, lang, text FROM documents WHERE source IS NOT NULL AND source <> 'src1'),
v2 AS (SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN coalesce(text, '') || ' fin' ELSE text END AS text FROM documents WHERE lang <> 'de' OR lang IS NULL)
SELECT coalesce(v2.doc_id, v1.doc_id) AS doc_id, CASE WHEN v2.doc_id IS NULL THEN 'deleted' WHEN v1.doc_id IS NULL THEN 'new' WHEN v1.text IS DISTINCT FROM v2.text THEN 'changed' ELSE 'same' END AS state,
       CASE WHEN v2.doc_id IS NOT NULL THEN len(regexp_extract_all(coalesce(v2.text, ''), '\S+'))::BIGINT END AS words,
       CASE WHEN v2.doc_id IS NULL THEN NULL WHEN v1.doc_id IS NULL OR v1.text IS DISTINCT FROM v2.text THEN 2 ELSE 1 END::BIGINT AS version
FROM v2 FULL JOIN v1 ON v1.doc_id = v2.doc_id""")
def cache_refresh(spark, d):
    """SK5: a cache of word counts over a first version of the documents (without one source), then over a second one (French texts longer, German ones gone): what was computed when."""
    docs, store = table(spark, d, "documents"), scratch_folder(spark)
    first = docs.filter("source <> 'src1'").select("doc_id", "lang", "text")
    second = docs.filter("lang <> 'de' OR lang IS NULL").select("doc_id", "lang", F.when(F.col("lang") == "fr", F.concat(T.text("text"), F.lit(" fin"))).otherwise(F.col("text")).alias("text"))
    count = lambda rows: rows.select("entry", "doc_id", T.word_count("text").cast("long").alias("words"))
    manifest.refresh(first, store, ["doc_id"], count)
    old = manifest.results(spark, store).select("entry", F.col("doc_id").alias("old_id"))
    state = kept(manifest.changes(second, store, ["doc_id"]).select("entry", "doc_id", "state").join(old, "entry", "left").select("entry", F.coalesce("doc_id", "old_id").alias("doc_id"), "state"))
    manifest.refresh(second, store, ["doc_id"], count)
    return state.join(manifest.results(spark, store).select("entry", "words", "version"), "entry", "left").select("doc_id", "state", "words", F.col("version").cast("long").alias("version"))


@query(ORACLE_SQL["c_extraction"])
def c_functions_sql(spark, d):
    """SC2 as a table function of SQL: the same as c_extraction, by a lateral join."""
    tables.register(spark)
    _files(spark, d).select(T.first_path_part("file_path").alias("project_name"), "text").createOrReplaceTempView("basalt_c_files")
    return spark.sql("SELECT f.project_name, c.function_name, c.comment, substring_index(c.source_code, '\n', -1) AS tail FROM basalt_c_files f, LATERAL c_functions(f.text) c")


# METEOR

def _meteor_tables(pairs: DataFrame) -> dict[str, DataFrame]:
    """Words that begin alike are synonyms; a pair's first two words say the same on both sides."""
    words = pairs.select(F.explode(F.concat(meteor.tokens("hypothesis"), meteor.tokens("reference"))).alias("word")).distinct()
    first = lambda c: F.array_join(F.slice(meteor.tokens(c), 1, 2), " ")
    return {"synonyms": words.filter(F.length("word") > 3).select("word", F.substring("word", 1, 4).alias("class")), "paraphrases": pairs.select(first("hypothesis").alias("a"), first("reference").alias("b")).distinct()}


_METEOR_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{M}}\p{{N}}_]+(?:''[\p{{L}}\p{{M}}\p{{N}}_]+)*|[^\p{{L}}\p{{M}}\p{{N}}_\s]')"


@query(f"""WITH {_PAIRS}, t AS (SELECT sample, {_METEOR_TOKENS.format("hypothesis")} AS hw, {_METEOR_TOKENS.format("reference")} AS rw FROM pairs),
hc AS (SELECT sample, w, count(*) AS n FROM (SELECT sample, unnest(hw) AS w FROM t) GROUP BY ALL), rc AS (SELECT sample, w, count(*) AS n FROM (SELECT sample, unnest(rw) AS w FROM t) GROUP BY ALL),
m AS (SELECT hc.sample, sum(least(hc.n, rc.n))::BIGINT AS n FROM hc JOIN rc ON hc.sample = rc.sample AND hc.w = rc.w GROUP BY hc.sample)
SELECT t.sample, len(hw)::BIGINT AS hypothesis_words, len(rw)::BIGINT AS reference_words, coalesce(n, 0)::BIGINT AS exact FROM t LEFT JOIN m ON m.sample = t.sample""")
def meteor_exact(spark, d):
    """TX6's counts: an alignment of exact matches covers as many equal words as there are on both sides."""
    found = meteor.meteor_counts(_pairs(spark, d), "sample", "hypothesis", "reference", kinds=[meteor.EXACT])
    length = lambda side: F.col(f"{side}_content") + F.col(f"{side}_function")
    return found.select("sample", length("hypothesis").alias("hypothesis_words"), length("reference").alias("reference_words"), F.col("hypothesis_content_0").alias("exact"))


@query()
def meteor_full(spark, d):
    """TX6: exact, stem, synonym and paraphrase matches, with tables made of the texts."""
    pairs = kept(_pairs(spark, d))
    return meteor.meteor(pairs, "sample", "hypothesis", "reference", **_meteor_tables(pairs), function_words=["the", "of", "la", "de", "que", "and"]).select("sample", F.round("meteor", 6).alias("meteor"))


# Training and decoding. The right vector of a pair is the left one turned round, with every other sign changed; held out are the ids whose CRC-32 is a multiple of five.

def _pairs_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("left"))
    return rows.select("id", "left", F.transform(F.reverse("left"), lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)).alias("right"), (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("held_out"))


@query()
def dual_encoder(spark, d):
    """VC7, VC14: a contrastive dual encoder trained on pairs, and for each pair held out the nearest right vector."""
    pairs = _pairs_of_vectors(spark, d)
    state = learning.train(pairs.filter("NOT held_out"), learning.Contrastive((64, 64), batch=256), scratch_folder(spark), epochs=4, steps=4, rate=0.05)
    held = kept(learning.projected(learning.projected(pairs.filter("held_out").drop("held_out"), "left", state["left"], "u"), "right", state["right"], "v").select("id", "u", "v"))
    found = vectors.search(held.select("id", "u"), held.select(F.col("id").alias("found_id"), F.col("v").alias("u")), "id", "found_id", "u", 1)
    return found.select("id", "found_id", F.round("score", 6).alias("score"))


@query()
def distilled_ranker(spark, d):
    """VC8: candidates of a vector are the right vectors of the next five, ranked by a student that has learned from a teacher's scores."""
    pairs = _pairs_of_vectors(spark, d)
    asked = pairs.select("id", "left", "held_out", F.explode(F.sequence(F.col("id"), F.col("id") + 4)).alias("candidate"))
    rows = asked.join(pairs.select(F.col("id").alias("candidate"), "right", F.col("left").alias("own")), "candidate")
    rows = kept(rows.select("id", "candidate", "left", "right", "held_out", (10 * T.dot(T.unit("left"), T.unit("own"))).alias("teacher")))
    state = learning.train(rows.filter("NOT held_out"), learning.Distilled((64, 64)), scratch_folder(spark), epochs=4, steps=4, rate=0.05)
    held = learning.projected(learning.projected(rows.filter("held_out").select("id", "candidate", "left", "right"), "left", state["left"], "u"), "right", state["right"], "v")
    return vectors.rerank(held, "id", "candidate", "u", "v", 3).select("id", "candidate", "rank")


_VOCABULARY, _STATE, _MARKER, _STEPS = 16, 8, 15, 6


def _recurrent(spark: SparkSession, d: str) -> decoding.Recurrent:
    """Weights are the first vectors: tokens 0 to 15, the recurrent rows 16 to 23, outputs 24 to 39, features 40 to 47."""
    first = table(spark, d, "embeddings").filter("vec_id < 48").orderBy("vec_id").collect()
    w = np.array([list(r.embedding) for r in first], float)
    return decoding.Recurrent(w[:16, :_STATE], w[16:24, :_STATE], w[24:40, :_STATE], w[40:48])


@query(f"""WITH RECURSIVE n AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), weight AS (SELECT list(x ORDER BY vec_id) AS w FROM n WHERE vec_id < 48),
cells AS (SELECT w, list_transform(range(1, {_STATE + 1}), lambda i: list_slice(w[16 + i], 1, {_STATE})) AS rec, list_transform(range(1, {_VOCABULARY + 1}), lambda v: list_slice(w[24 + v], 1, {_STATE})) AS o FROM weight),
prompt AS (SELECT vec_id, x, [(vec_id % 15)::INT, {_MARKER}, ((vec_id // 15) % 15)::INT] AS tokens FROM n),
run(vec_id, k, h, token) AS (
    SELECT vec_id, 0, list_transform(range({_STATE}), lambda i: 0.0::DOUBLE), NULL::INT FROM prompt
    UNION ALL
    SELECT vec_id, k + 1, h2, CASE WHEN k >= 2 THEN list_position(z, list_max(z)) - 1 END FROM (
        SELECT *, list_transform(o, lambda v: list_dot_product(v, h2)) AS z FROM (
            SELECT r.vec_id, k, o, list_transform(range(1, {_STATE + 1}), lambda i: (exp(2 * (CASE WHEN k = 1 THEN list_dot_product(w[40 + i], p.x) ELSE w[CASE WHEN k < 3 THEN p.tokens[k + 1] ELSE r.token END + 1][i] END + list_dot_product(rec[i], h))) - 1)
                   / (exp(2 * (CASE WHEN k = 1 THEN list_dot_product(w[40 + i], p.x) ELSE w[CASE WHEN k < 3 THEN p.tokens[k + 1] ELSE r.token END + 1][i] END + list_dot_product(rec[i], h))) + 1)) AS h2
            FROM run r JOIN prompt p ON p.vec_id = r.vec_id, cells WHERE k < {2 + _STEPS})))
SELECT vec_id, array_to_string(list(token ORDER BY k), ' ') AS tokens FROM run WHERE token IS NOT NULL GROUP BY vec_id""")
def probe_greedy(spark, d):
    """VC10: continuations without chance, each vector put in at the marker of its prompt."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.array((F.col("vec_id") % 15).cast("int"), F.lit(_MARKER), (F.floor(F.col("vec_id") / 15) % 15).cast("int")).alias("prompt"))
    found = decoding.decode(rows, _recurrent(spark, d), "vec_id", "prompt", "embedding", _MARKER, 1, _STEPS, None, 0.0)
    return found.select("vec_id", F.array_join("tokens", " ").alias("tokens"))


@query()
def probe_sampled(spark, d):
    """VC10: three draws a vector among the eight likeliest tokens that come to 0.9."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.array((F.col("vec_id") % 15).cast("int"), F.lit(_MARKER)).alias("prompt"))
    return decoding.decode(rows, _recurrent(spark, d), "vec_id", "prompt", "embedding", _MARKER, 3, 12, 0, 0.8, 8, 0.9).select("vec_id", "sample", F.array_join("tokens", " ").alias("tokens"))


# The sparse encoder. A customer is a function of four instructions (the first ones) of three tokens; instructions with the same operator are linked. A token's id is the sum of its length and its first character's code, modulo 38, plus 2; padding is 0, node tokens 1, the global token 2.

_LAYOUT = sparse_encoder.Layout(4, 3)
_D, _N = 4, 12 + 4 + 1


#: Columns of the three projections in SQL.
_PROJECTED = ", ".join("[" + ", ".join("list_dot_product(x, [" + ", ".join(f"w[{low + r}][{c}]" for r in range(1, _D + 1)) + "])" for c in range(1, _D + 1)) + f"] AS {name}" for name, low in (("q", 40), ("k", 44), ("v", 48)))


def _encoder_weights(spark: SparkSession, d: str) -> sparse_encoder.Weights:
    """From the first vectors: embeddings 0 to 39, projections 40 to 51, biases 52 and 53; two heads of two."""
    w = np.array([list(r.embedding) for r in table(spark, d, "embeddings").filter("vec_id < 54").orderBy("vec_id").collect()], float)
    return sparse_encoder.Weights(w[:40, :_D], w[40:44, :_D], w[44:48, :_D], w[48:52, :_D], w[52:54, :5])


def _encoder_rows(spark: SparkSession, d: str) -> DataFrame:
    first = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("block", "pos", "asm"))), lambda s: F.split(s["asm"], "[ ,]+")), 1, 4)
    rows = dataflow.block_tokens(_instructions(spark, d).groupBy("fn").agg(first.alias("tokens")), "tokens", 3, 4)
    number = lambda t: F.when(t == "<pad>", 0).when(t == "<inst>", 1).when(t == "<cls>", 2).otherwise((F.length(t) + F.ascii(t)) % 38 + 2)
    blocks = F.transform("tokens", lambda t, i: F.struct(i.alias("i"), F.get(t, F.lit(0)).alias("o")))
    pairs = F.flatten(F.transform(blocks, lambda a: F.transform(F.filter(blocks, lambda b: (b["i"] < a["i"]) & (b["o"] == a["o"])), lambda b: F.struct(b["i"].alias("u"), a["i"].alias("v")))))
    return rows.select("fn", F.transform("input_tokens", number).alias("ids"), pairs.alias("links"))


@query(_without_signed_zeros("fn, place", _D, f"""WITH {_CODE}, wt AS (SELECT list(embedding::DOUBLE[] ORDER BY vec_id) AS w FROM embeddings WHERE vec_id < 54),
o AS (SELECT fn, (list(string_split_regex(asm, '[ ,]+') ORDER BY block, pos, asm))[1:4] AS o FROM code GROUP BY fn),
tk AS (SELECT fn, i, CASE WHEN i < 12 THEN i // 3 WHEN i < 16 THEN i - 12 END AS b, CASE WHEN i < 12 THEN 'l' WHEN i < 16 THEN 'n' ELSE 'g' END AS part, CASE WHEN i < 12 THEN o[i // 3 + 1][i % 3 + 1] END AS tok, CASE WHEN i < 16 THEN o[CASE WHEN i < 12 THEN i // 3 ELSE i - 12 END + 1][1] END AS op FROM o, range({_N}) r(i)),
ids AS (SELECT *, CASE WHEN part = 'n' THEN 1 WHEN part = 'g' THEN 2 WHEN tok IS NULL THEN 0 ELSE (length(tok) + ascii(tok)) % 38 + 2 END AS id FROM tk),
x AS (SELECT fn, i, b, part, op, id, w, list_slice(w[id + 1], 1, {_D}) AS x FROM ids, wt),
p AS (SELECT fn, i, b, part, op, id, w, {_PROJECTED} FROM x),
s AS (SELECT a.fn, a.i, h, b.v, (a.q[2 * h + 1] * b.k[2 * h + 1] + a.q[2 * h + 2] * b.k[2 * h + 2]) / sqrt(2.0::DOUBLE) + CASE WHEN a.part = 'n' AND b.part = 'n' THEN a.w[53 + h][greatest(-2, least(2, b.b - a.b)) + 3] ELSE 0 END AS s
      FROM p a JOIN p b ON a.fn = b.fn, range(2) r(h)
      WHERE (b.part <> 'l' OR b.id <> 0) AND (a.part = 'g' OR b.part = 'g' OR (a.b = b.b AND NOT (a.part = 'n' AND b.part = 'n')) OR (a.part = 'n' AND b.part = 'n' AND (a.i = b.i OR a.op = b.op)))),
m AS (SELECT fn, i, h, max(s) AS m FROM s GROUP BY ALL),
r AS (SELECT s.fn, s.i, s.h, sum(exp(s - m) * v[2 * s.h + 1]) / sum(exp(s - m)) AS y1, sum(exp(s - m) * v[2 * s.h + 2]) / sum(exp(s - m)) AS y2 FROM s JOIN m ON m.fn = s.fn AND m.i = s.i AND m.h = s.h GROUP BY ALL)
SELECT fn, i::INT AS place, {", ".join(f"round(max(y{k % 2 + 1}) FILTER (h = {k // 2}), 6) AS x{k}" for k in range(_D))} FROM r GROUP BY fn, i"""))
def sparse_attention(spark, d):
    """VC9: hidden vectors of all tokens, against dense attention under the same mask in SQL."""
    found = sparse_encoder.encode(_encoder_rows(spark, d), "fn", "ids", "links", _LAYOUT, _encoder_weights(spark, d))
    return found.select("fn", F.posexplode("hidden").alias("place", "x")).select("fn", "place", *map(_element, range(_D)))


@query()
def encoder_samples(spark, d):
    """VC9: samples of masked tokens, what the encoder's head says of them, and how many pairs of blocks there are to tell linked from not."""
    rows, w = _encoder_rows(spark, d), _encoder_weights(spark, d)
    masked = kept(sparse_encoder.masked_tokens(rows, "fn", "ids", _LAYOUT, 3, 40))
    encoded = sparse_encoder.encode(masked.join(rows.select("fn", "links"), "fn"), "fn", "ids", "links", _LAYOUT, w)
    told = sparse_encoder.token_scores(encoded.join(masked.select("fn", "masked"), "fn"), "masked", w, "fn")
    labels = masked.select("fn", F.inline(F.arrays_zip(F.col("masked").alias("place"), F.col("labels").alias("label"))))
    pairs = sparse_encoder.linked_pairs(rows.withColumn("n", F.lit(_LAYOUT.blocks)), "fn", "links", "n")
    counts = pairs.groupBy("fn").agg(F.count_if("linked").alias("n_linked"), F.count_if(~F.col("linked")).alias("n_free"))
    return labels.join(told, ["fn", "place"]).join(counts, "fn", "left").select("fn", "place", "label", "token", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("n_free", F.lit(0)).alias("n_free"))

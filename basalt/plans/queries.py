"""Registered queries over the driver's tables, with their SQL.

Documents stand for functions (source: project, text: code, lang: architecture), events for calls, orders of a customer for
a function's walk, user and assistant turns for reference and hypothesis, embeddings for code vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import callgraph, curation, denoise, graphs, judge, metrics, prompts, splits, vectors
from basalt.plans.registry import query, table

_TOKENS = r"len(regexp_extract_all(coalesce({}, ''), '[\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]+|[^\s\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]'))"
_WORDS = r"len(regexp_extract_all(coalesce({}, ''), '\S+'))"


@query(f"SELECT doc_id, {_TOKENS.format('text')}::BIGINT AS tokens, {_WORDS.format('text')}::BIGINT AS words FROM documents WHERE {_TOKENS.format('text')} > 30 AND {_TOKENS.format('text')} < 9192")
def token_gate(spark, d):
    """PJ7, PJ8, FL1, FL3."""
    # Tokens are counted once a row: a filter on a column would be pushed below it, with the count.
    counted = F.array(F.struct(T.token_count("text").cast("long").alias("tokens"), T.word_count("text").cast("long").alias("words")))
    return table(spark, d, "documents").select("doc_id", F.inline(F.filter(counted, lambda n: (n["tokens"] > 30) & (n["tokens"] < 9192))))


@query("""SELECT source || '::' || substr(text, 1, 20) AS key, min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' AND text IS NOT NULL GROUP BY 1""")
def augref_collect(spark, d):
    """ST1, ST2, WN6, PJ6, FL6, SF4."""
    return curation.collect_references(table(spark, d, "documents"), "source", "text", ["doc_id"]).select("key", "doc_id")


@query("""SELECT d.doc_id, l.quality AS reference, l.doc_id IS NOT NULL AS applied FROM documents d LEFT JOIN (SELECT source || '::' || substr(text, 1, 20) AS key, min_by(l.quality, d.doc_id) AS quality, min(d.doc_id) AS doc_id FROM documents d JOIN labels l USING (doc_id) GROUP BY 1) l ON d.source || '::' || substr(d.text, 1, 20) = l.key""")
def reference_apply(spark, d):
    """JN4, AG10, SK4's join."""
    docs, labels = table(spark, d, "documents").select("doc_id", "source", "text"), table(spark, d, "labels")
    refs = curation.collect_references(docs.join(labels, "doc_id"), "source", "text", ["doc_id"]).select("key", F.col("quality").alias("reference"))
    return curation.apply_reference(docs, refs, "source", "text").select("doc_id", "reference", F.col("reference").isNotNull().alias("applied"))


@query("""WITH b AS (SELECT source, lang, max(doc_id) AS source_doc FROM documents GROUP BY ALL) SELECT d.doc_id, b.source_doc FROM documents d JOIN b ON d.source = b.source AND d.lang = b.lang""")
def match_source(spark, d):
    """JN2, PJ1: the last source of each (project, name) wins."""
    docs = table(spark, d, "documents")
    fns = docs.select(F.concat("source", F.lit("-bin")).alias("project_name"), F.col("lang").alias("function_name"), "doc_id")
    sources = docs.select(F.concat("source", F.lit("-src")).alias("project_name"), F.col("lang").alias("function_name"), F.col("doc_id").cast("string").alias("source_code"), F.col("source").alias("comment"), F.col("doc_id").alias("ord"))
    return curation.match_source(fns, sources, ["ord"]).select("doc_id", F.col("source_code").cast("long").alias("source_doc"))


@query("""SELECT a.doc_id, a.toxic, b.quality FROM labels a JOIN labels b ON a.doc_id = b.doc_id WHERE a.doc_id IN (SELECT doc_id FROM documents)""")
def match_builds(spark, d):
    """JN1, SC14: two builds of the same functions by address."""
    docs, labels = table(spark, d, "documents").select("doc_id", F.lit("p").alias("project_name"), F.col("source").alias("binary_name")), table(spark, d, "labels")
    one = docs.join(labels, "doc_id").select("project_name", "binary_name", F.col("doc_id").alias("function_addr"), F.col("toxic").cast("string").alias("function_name"), F.lit("").alias("decompiled_code"))
    two = docs.join(labels, "doc_id").select("project_name", "binary_name", F.col("doc_id").alias("function_addr"), F.col("quality").cast("string").alias("function_name"), F.lit("").alias("decompiled_code"))
    return curation.match_stripped(one, two).select(F.col("function_addr").alias("doc_id"), F.col("strip_function_name").cast("int").alias("toxic"), F.col("function_name").cast("int").alias("quality"))


_NEW = "NOT list_contains(texts, a) AND NOT list_contains(keys, b)"


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, hash(text) AS a, hash(concat_ws('::', source, substr(text, 1, 20))) AS b FROM documents WHERE {_TOKENS.format('text')} > 30 AND {_TOKENS.format('text')} < 9192),
n AS (SELECT *, count(*) OVER (PARTITION BY a) + count(*) OVER (PARTITION BY b) AS n FROM t), c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM n WHERE n > 2),
g AS (SELECT 0::BIGINT AS r, []::UBIGINT[] AS texts, []::UBIGINT[] AS keys, NULL::BIGINT AS doc_id
      UNION ALL SELECT c.r, CASE WHEN {_NEW} THEN list_append(texts, a) ELSE texts END, CASE WHEN {_NEW} THEN list_append(keys, b) ELSE keys END, CASE WHEN {_NEW} THEN c.doc_id END FROM g JOIN c ON c.r = g.r + 1)
SELECT doc_id FROM g WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id FROM n WHERE n = 2""")
def gates_and_dedup(spark, d):
    """FL1-FL5, ST3, WN7: gates, then greedy dedup over two keys."""
    docs = table(spark, d, "documents").filter(T.token_gate("text")).withColumn("base_key", T.reference_key("source", "text"))
    return curation.greedy_dedup(docs.select("doc_id", "text", "base_key"), "doc_id", "text", "base_key").select("doc_id")


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, r AS split_position, CASE WHEN r <= n * 8 // 10 THEN 'train' WHEN r <= n * 9 // 10 THEN 'valid' ELSE 'test' END AS split, {_WORDS.format('text')} > 200 AND {_WORDS.format('text')} < 250 AS medium FROM n""")
def split_80_10_10(spark, d):
    """WN1, FL7: exact split by position, numbered without bringing rows to one task."""
    out = splits.split_80_10_10(table(spark, d, "documents").select("doc_id", T.word_gate("text").alias("medium")), ["doc_id"])
    return out.select("doc_id", "split_position", "split", "medium")


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM n WHERE r > n * 9 // 10 AND {_WORDS.format('text')} > 200 AND {_WORDS.format('text')} < 250 ORDER BY doc_id LIMIT 200""")
def test_functions(spark, d):
    """WN1, WN2, FL7, PJ7: a test set, which is a limit by definition."""
    docs = splits.split_80_10_10(table(spark, d, "documents").select("doc_id", T.word_gate("text").alias("medium")), ["doc_id"])
    return splits.first_rows(docs.filter("split = 'test' AND medium"), ["doc_id"]).select("doc_id")


@query("SELECT user_id AS caller, event_type AS callee, count(*) AS n FROM events GROUP BY ALL")
def call_counts(spark, d):
    """AG1, SC9's aggregate."""
    return callgraph.call_counts(table(spark, d, "events").select(F.col("user_id").alias("caller"), F.col("event_type").alias("callee")))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type AS callee, count(*) AS n_callers, sum(n)::BIGINT AS n_calls, arg_max(user_id, (n, -user_id)) AS top_caller FROM c GROUP BY 1""")
def callers_map(spark, d):
    """SC10, AG2: the inverse graph, summarised."""
    counts = callgraph.call_counts(table(spark, d, "events").select(F.col("user_id").alias("caller"), F.col("event_type").alias("callee")))
    return callgraph.callers_of(counts).groupBy("callee").agg(F.count(F.lit(1)).alias("n_callers"), F.sum("n").alias("n_calls"), F.max_by("caller", F.struct("n", -F.col("caller"))).alias("top_caller"))


@query("""SELECT *, count(*) OVER (PARTITION BY callee) AS n_callers FROM (SELECT event_type AS caller, user_id AS callee, count(*) AS n FROM events GROUP BY ALL)""")
def caller_maps(spark, d):
    """SC10, SF17: callers of each function as a map, unfolded again."""
    counts = callgraph.call_counts(table(spark, d, "events").select(F.col("event_type").alias("caller"), F.col("user_id").alias("callee")))
    return callgraph.caller_maps(counts).select("callee", "n_callers", F.explode("callers").alias("caller", "n"))


@query("""SELECT o.o_orderkey, count(DISTINCT p.p_partkey) AS n_parts, sum(DISTINCT p.p_partkey)::BIGINT AS part_sum FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size > 25 GROUP BY 1""")
def cg_enrich(spark, d):
    """JN3: explode, look up, nest again; functions without a known neighbour keep an empty map."""
    orders, items, parts = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    fns = orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("fn"), F.lit(1).cast("long").alias("v")).unionByName(parts.filter("p_size > 25").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("fn"), F.col("p_partkey").alias("v")))
    edges = items.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey")).alias("b"))
    out = callgraph.enrich(fns, edges, "fn", "v", "a", "b", "callees").filter("fn LIKE 'o%'")
    total = F.aggregate(F.map_values("callees"), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(F.substring("fn", 2, 20).cast("long").alias("o_orderkey"), F.size("callees").cast("long").alias("n_parts"), F.when(F.size("callees") > 0, total).alias("part_sum"))


@query("""SELECT l_orderkey AS target, l_partkey AS neighbour, r AS neighbour_rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS r FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE r <= 5""")
def first_neighbours(spark, d):
    """PJ18, GR18's five neighbours."""
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_partkey").alias("neighbour"))
    return callgraph.first_neighbours(edges, "target", "neighbour").select("target", "neighbour", F.col("neighbour_rank").cast("long"))


_STATE = "(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END * 10 + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END)"
_EDGES = f"""w AS (SELECT o_custkey AS fn, {_STATE} AS s, lead({_STATE}) OVER o AS nxt, row_number() OVER o AS r FROM orders WINDOW o AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
edges AS (SELECT DISTINCT fn, s::BIGINT AS src, nxt::BIGINT AS dst FROM w WHERE nxt IS NOT NULL UNION SELECT fn, 0, s FROM w WHERE r = 1 UNION SELECT fn, s, 99 FROM w WHERE nxt IS NULL)"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as states in turn, from 0 (entry) to 99 (exit)."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("fn"), "o_orderdate", "o_orderkey", F.expr(_STATE).cast("long").alias("s"))
    ends = orders.select("fn").distinct()
    at = lambda when, key, state: ends.select("fn", F.to_timestamp(F.lit(when)).alias("o_orderdate"), F.lit(key).cast("long").alias("o_orderkey"), F.lit(state).cast("long").alias("s"))
    return orders.unionByName(at("0001-01-01", -1, 0)).unionByName(at("9999-01-01", -1, 99))


def _walks(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a graph of states that follow each other: (fn, src, dst)."""
    return graphs.consecutive_edges(_states(spark, d), "fn", F.col("s"), ["o_orderdate", "o_orderkey"])


@query(f"WITH {_EDGES} SELECT * FROM edges UNION SELECT fn, 99, NULL FROM edges")
def cfg_edges(spark, d):
    """GR1: block maps to edges; a block without successor names only itself."""
    steps = _walks(spark, d)
    blocks = steps.groupBy("fn", "src").agg(F.collect_set("dst").alias("successors"))
    ends = steps.select("fn").distinct().select("fn", F.lit(99).cast("long").alias("src"), F.array().cast("array<bigint>").alias("successors"))
    cfg = blocks.unionByName(ends).groupBy("fn").agg(F.map_from_entries(F.collect_list(F.struct("src", F.struct("successors")))).alias("cfg"))
    return graphs.edges_of(cfg, "fn")


@query(f"""WITH {_EDGES}, n AS (SELECT fn, src AS node FROM edges UNION SELECT fn, dst FROM edges)
SELECT fn, coalesce(min(node) FILTER (WHERE (fn, node) NOT IN (SELECT (fn, dst) FROM edges)), min(node)) AS entry, count(*) FILTER (WHERE (fn, node) NOT IN (SELECT (fn, src) FROM edges)) AS n_exits, count(*) AS n_nodes FROM n GROUP BY fn""")
def cfg_entry_exit(spark, d):
    """GR2, AG17."""
    return graphs.entries_and_exits(_walks(spark, d), "fn").select("fn", "entry", F.size("exits").cast("long").alias("n_exits"), "n_nodes")


@query(f"""WITH RECURSIVE {_EDGES}, bfs AS (SELECT DISTINCT fn, 0::BIGINT AS node, 0::BIGINT AS dist FROM edges UNION SELECT e.fn, e.dst, b.dist + 1 FROM bfs b JOIN edges e ON e.fn = b.fn AND e.src = b.node WHERE b.dist < 16)
SELECT fn, node AS exit, min(dist) AS length FROM bfs WHERE node = 99 GROUP BY ALL""")
def cfg_shortest_path(spark, d):
    """GR3, GR4."""
    return graphs.shortest_exit_paths(_walks(spark, d), "fn").select("fn", "exit", "length")


_FRESH = "len(list_filter(path, lambda x: NOT list_contains({}, x)))"


@query(f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT DISTINCT fn, [0::BIGINT] AS path, 0::BIGINT AS node FROM edges
      UNION ALL SELECT w.fn, list_append(path, e.dst), e.dst FROM walk w JOIN edges e ON e.fn = w.fn AND e.src = w.node WHERE NOT list_contains(path, e.dst)),
c AS (SELECT * FROM (SELECT fn, path, row_number() OVER (PARTITION BY fn ORDER BY len(path), path) AS r FROM walk WHERE node = 99) WHERE r <= 10),
one AS (SELECT fn, path AS a FROM c WHERE r = 1),
two AS (SELECT fn, a, path AS b FROM (SELECT c.*, a, row_number() OVER (PARTITION BY fn ORDER BY {_FRESH.format('a')} DESC, r) AS k FROM c JOIN one USING (fn)) WHERE k = 1),
three AS (SELECT fn, a, b, path AS d FROM (SELECT c.*, a, b, row_number() OVER (PARTITION BY fn ORDER BY {_FRESH.format('a || b')} DESC, r) AS k FROM c JOIN two USING (fn)) WHERE k = 1),
n AS (SELECT fn, count(*) AS n FROM (SELECT fn, src FROM edges UNION SELECT fn, dst FROM edges) GROUP BY fn)
SELECT fn, array_to_string(list_transform(list_sort(list_distinct([a, b, d])), lambda p: array_to_string(p, '-')), '|') AS paths, round(len(list_distinct(a || b || d)) / n, 6) AS coverage FROM three JOIN n USING (fn)""")
def cfg_paths_cover(spark, d):
    """GR5-GR7, WN12, AG14, AG15, ST4, ST5: ten shortest simple paths to each exit, greedy cover."""
    found = graphs.paths(_walks(spark, d), "fn")
    return found.select("fn", F.array_join(F.transform("path", lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), "-")), "|").alias("paths"), F.round("coverage", 6).alias("coverage"))


@query(f"""WITH RECURSIVE {_EDGES}, n AS (SELECT fn, src AS node FROM edges UNION SELECT fn, dst FROM edges),
-- without d: which nodes reach which
reach AS (SELECT e.fn, d.node AS d, e.src AS a, e.dst AS b FROM edges e JOIN n d ON d.fn = e.fn AND e.src <> d.node AND e.dst <> d.node
          UNION SELECT r.fn, r.d, r.a, e.dst FROM reach r JOIN edges e ON e.fn = r.fn AND e.src = r.b AND e.dst <> r.d),
ends AS (SELECT fn, d, a AS node FROM reach WHERE a = b UNION SELECT x.fn, d.node, x.node FROM n x JOIN n d ON d.fn = x.fn AND d.node <> x.node WHERE x.node = 99),
escapes AS (SELECT fn, d, node FROM ends UNION SELECT r.fn, r.d, r.a FROM reach r JOIN ends t ON t.fn = r.fn AND t.d = r.d AND t.node = r.b)
SELECT x.fn, x.node, d.node AS post_dominator FROM n x JOIN n d ON d.fn = x.fn LEFT JOIN escapes e ON e.fn = x.fn AND e.d = d.node AND e.node = x.node WHERE e.node IS NULL""")
def post_dominators(spark, d):
    """GR11: every maximal path, endless ones too, meets the post-dominator."""
    return graphs.post_dominance(_walks(spark, d), "fn")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """A document's lines, dealt in turn to three paths, as blocks: a block for each sentence."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("fn"), F.posexplode(F.split(T.text("text"), "\n")).alias("line", "s"))
    blocks = lines.select("fn", "line", F.posexplode(F.split("s", r"\. ")).alias("i", "content"))
    # Line and sentence in one number, 32 bits each: neither overflows.
    return blocks.select("fn", (F.col("line") % 3).alias("path"), (F.shiftleft(F.col("line").cast("long"), 32) + F.col("i")).alias("pos"), "content")


@query("""WITH l AS (SELECT doc_id AS fn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
b AS (SELECT fn, k % 3 AS path, unnest(string_split(line, '. ')) AS content, k * 4294967296 + generate_subscripts(string_split(line, '. '), 1) - 1 AS pos FROM l),
h AS (SELECT *, substr(md5(regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '')), 1, 8) AS x FROM b),
f AS (SELECT *, first_value(path) OVER w AS p, first_value(pos) OVER w AS i FROM h WINDOW w AS (PARTITION BY fn, x ORDER BY path, pos))
SELECT fn, path::INT AS path, pos::BIGINT AS pos, CASE WHEN p = path AND i = pos THEN content ELSE 'Same as REF_' || p || '_' || i END AS shown FROM f""")
def prompt_refs(spark, d):
    """GR21, SF6, SF7, PJ5."""
    return prompts.compressed(_blocks(spark, d), "fn").select("fn", "path", "pos", "shown")


@query("""WITH l AS (SELECT doc_id AS fn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
b AS (SELECT fn, k % 3 AS path, unnest(string_split(line, '. ')) AS content, k * 4294967296 + generate_subscripts(string_split(line, '. '), 1) - 1 AS pos FROM l),
h AS (SELECT fn, path, pos, substr(md5(regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '')), 1, 8) AS x, length(content) AS n FROM b),
k AS (SELECT fn, max(path) AS m FROM h GROUP BY 1),
o AS (SELECT fn, [0] AS o FROM k WHERE m = 0 UNION ALL SELECT fn, unnest([[0,1],[1,0]]) FROM k WHERE m = 1 UNION ALL SELECT fn, unnest([[0,1,2],[0,2,1],[1,0,2],[1,2,0],[2,0,1],[2,1,0]]) FROM k WHERE m = 2),
c AS (SELECT o.fn, o.o, h.n, row_number() OVER (PARTITION BY o.fn, o.o, h.x ORDER BY list_position(o.o, h.path), h.pos) AS r FROM o JOIN h ON h.fn = o.fn)
SELECT fn, min(cost)::BIGINT AS cost FROM (SELECT fn, o, sum(CASE WHEN r = 1 THEN n ELSE 10 END) AS cost FROM c GROUP BY ALL) GROUP BY fn""")
def prompt_order_cost(spark, d):
    """GR20."""
    return prompts.path_order(_blocks(spark, d), "fn").select("fn", "cost")


@query("""WITH l AS (SELECT doc_id AS fn, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
b AS (SELECT fn, k % 3 AS path, unnest(string_split(line, '. ')) AS content, k * 4294967296 + generate_subscripts(string_split(line, '. '), 1) - 1 AS pos FROM l),
h AS (SELECT fn, path, pos, content, substr(md5(regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '')), 1, 8) AS x, length(content) AS n FROM b),
k AS (SELECT fn, max(path) AS m FROM h GROUP BY 1),
o AS (SELECT fn, [0] AS o FROM k WHERE m = 0 UNION ALL SELECT fn, unnest([[0,1],[1,0]]) FROM k WHERE m = 1 UNION ALL SELECT fn, unnest([[0,1,2],[0,2,1],[1,0,2],[1,2,0],[2,0,1],[2,1,0]]) FROM k WHERE m = 2),
c AS (SELECT o.fn, o.o, h.n, row_number() OVER (PARTITION BY o.fn, o.o, h.x ORDER BY list_position(o.o, h.path), h.pos) AS r FROM o JOIN h ON h.fn = o.fn),
best AS (SELECT fn, min({'cost': cost, 'o': o}).o AS o FROM (SELECT fn, o, sum(CASE WHEN r = 1 THEN n ELSE 10 END) AS cost FROM c GROUP BY ALL) GROUP BY fn),
f AS (SELECT h.*, list_position(o, path) AS place, first_value(path) OVER w AS p, first_value(pos) OVER w AS i FROM h JOIN best ON best.fn = h.fn WINDOW w AS (PARTITION BY h.fn, x ORDER BY list_position(o, path), pos)),
t AS (SELECT fn, path, place, string_agg(CASE WHEN p = path AND i = pos THEN content ELSE 'Same as REF_' || p || '_' || i END, chr(10) ORDER BY pos) AS t FROM f GROUP BY ALL)
SELECT fn, md5(string_agg('Path ' || path || ':' || chr(10) || t, chr(10) || chr(10) ORDER BY place)) AS prompt_md5 FROM t GROUP BY fn""")
def prompt_in_order(spark, d):
    """GR20, GR21, LM2: the whole prompt, paths in the cheapest order."""
    return prompts.in_best_order(_blocks(spark, d), "fn").select("fn", F.md5("prompt_blocks").alias("prompt_md5"))


_PAIRS = r"""p AS (SELECT conv_id || '/' || turn AS sample, text AS reference, lead(text) OVER w AS hypothesis, role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT sample, reference, hypothesis, regexp_extract_all(coalesce(reference, ''), '\S+') AS r, regexp_extract_all(coalesce(hypothesis, ''), '\S+') AS h FROM p WHERE role = 'user' AND next_role = 'assistant')"""

def _pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("sample"), F.col("text").alias("reference"), F.lead("text").over(w).alias("hypothesis"), "role", F.lead("role").over(w).alias("next_role"))
    return turns.filter("role = 'user' AND next_role = 'assistant'").select("sample", "reference", "hypothesis")


_BLEU_BASE = f"""WITH {_PAIRS}, o AS (SELECT sample, h, r, unnest([1, 2, 3, 4]) AS n FROM pairs),
hg AS (SELECT sample, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS gram FROM o WHERE len(h) >= n),
rg AS (SELECT sample, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS gram FROM o WHERE len(r) >= n),
m AS (SELECT sample, n, sum(least(a.c, b.c)) AS ok FROM (SELECT sample, n, gram, count(*) AS c FROM hg GROUP BY ALL) a JOIN (SELECT sample, n, gram, count(*) AS c FROM rg GROUP BY ALL) b USING (sample, n, gram) GROUP BY ALL),
s AS (SELECT p.sample, len(p.h)::DOUBLE AS t, len(p.r)::DOUBLE AS f, {', '.join(f"coalesce(max(ok) FILTER (WHERE n = {n}), 0)::DOUBLE AS c{n}" for n in range(1, 5))} FROM pairs p LEFT JOIN m USING (sample) GROUP BY ALL)"""


def _bleu_select(c: Callable[[str], str], scale: float) -> str:
    ratio = f"(({c('t')} + 1e-15) / ({c('f')} + 1e-9))"
    cols, product = [], "1.0::DOUBLE"
    for n in range(1, 5):
        product += f" * ({c(f'c{n}')} + 1e-15::DOUBLE) / ({c(f'g{n}')} + 1e-9::DOUBLE)"
        cols.append(f"round(pow({product}, 1.0::DOUBLE / {n}) * CASE WHEN {ratio} < 1 THEN exp(1 - 1 / {ratio}) ELSE 1 END * {scale}, 6) AS bleu_{n}")
    return ", ".join(cols)


_G = ", ".join(f"greatest(0, t - {n - 1}) AS g{n}" for n in range(1, 5))


@query(f"{_BLEU_BASE}, z AS (SELECT *, {_G} FROM s) SELECT sample, {_bleu_select(lambda x: x, 1.0)} FROM z")
def bleu_sentence(spark, d):
    """TX1, TX2, AG12, AG13, SF2, SF14."""
    out = metrics.sentence_bleu(_pairs(spark, d), "sample", "hypothesis", "reference")
    return out.select("sample", *(F.round(f"bleu_{n}", 6).alias(f"bleu_{n}") for n in range(1, 5)))


@query(f"{_BLEU_BASE}, z AS (SELECT *, {_G} FROM s) SELECT {_bleu_select(lambda x: f'sum({x})', 100.0)} FROM z")
def bleu_corpus(spark, d):
    """TX3, AG3."""
    out = metrics.corpus_bleu(_pairs(spark, d), "sample", "hypothesis", "reference")
    return out.select(*(F.round(f"bleu_{n}", 6).alias(f"bleu_{n}") for n in range(1, 5)))


@query()
def meteor_approx(spark, d):
    """TX6, PJ15: exact and stem matches only."""
    return metrics.meteor(_pairs(spark, d), "sample", "hypothesis", "reference")


_DOT = "round(list_dot_product(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 9)"
_NORM = "WITH u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS embedding FROM embeddings)"
_KNN = f"""{_NORM}, s AS (SELECT q.vec_id AS query_id, k.vec_id AS vec_id, {_DOT} AS score FROM u q, u k WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return vectors.normalised_keys(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"{_KNN} SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def knn_topk(spark, d):
    """VC2-VC4, JN12, WN3, WN4, SF20: the stated query set against all keys, in blocks."""
    keys = _keys(spark, d)
    found = vectors.search(keys.filter("key % 20 = 0").withColumnRenamed("key", "query_id"), keys.withColumnRenamed("key", "vec_id"), "query_id", "vec_id", "embedding")
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"{_KNN} SELECT query_id, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5 AND score >= 0.6")
def knn_threshold(spark, d):
    """FL9, VC3."""
    keys = _keys(spark, d)
    found = vectors.search(keys.filter("key % 20 = 0").withColumnRenamed("key", "query_id"), keys.withColumnRenamed("key", "vec_id"), "query_id", "vec_id", "embedding", threshold=0.6)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(f"""{_NORM}, s AS (SELECT q.vec_id AS query_id, k.vec_id AS vec_id, {_DOT} AS score FROM u q JOIN u k ON k.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 8)
SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def rerank(spark, d):
    """VC5, JN11: each query's own eight candidates."""
    keys = _keys(spark, d)
    own = keys.select(F.col("key").alias("query_id"), F.col("embedding").alias("q"), F.explode(F.sequence(F.col("key") + 1, F.col("key") + 8)).alias("vec_id"))
    cands = own.join(keys.select(F.col("key").alias("vec_id"), F.col("embedding").alias("k")), "vec_id")
    return vectors.rerank(cands, "query_id", "vec_id", "q", "k").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(r"""SELECT page_id, split_part(html, '{', 1) AS sig, regexp_replace(regexp_replace(regexp_replace(html, '</?[a-z_]+>', '', 'g'), '^\s+', ''), '\s+$', '') AS clean FROM pages""")
def snippets(spark, d):
    """PJ9, PJ10, SF1, SF3."""
    return table(spark, d, "pages").select("page_id", T.signature("html").alias("sig"), T.clean_snippet("html").alias("clean"))


@query(r"""SELECT conv_id, turn, CASE WHEN s = '' OR len(regexp_extract_all(s, '\S+')) > 30 OR s LIKE 'this function%' OR s LIKE 'this code%' OR ((s LIKE 'performs%' OR s LIKE 'handles%' OR s LIKE 'does%' OR s LIKE 'implements%') AND len(regexp_extract_all(s, '\S+')) <= 6) THEN true ELSE false END AS bad FROM (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS s FROM conversations)""")
def bad_summary(spark, d):
    """FL8."""
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_bad_summary("text").alias("bad"))


@query(r"""WITH g AS (SELECT d.doc_id, b.item_id, contains(d.text, b.text) AS hit FROM documents d, benchmark b WHERE b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
t AS (SELECT g.*, l.quality, l.toxic FROM g LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN toxic = 1 THEN 'junk' WHEN NOT hit THEN 'uncertain' WHEN quality = 1 THEN 'strong' WHEN quality = 0 THEN 'backup' ELSE 'junk' END AS tag FROM t""")
def denoise_decision(spark, d):
    """LM5, FL10: a feature counts only if it stands in the code."""
    docs, bench, labels = (table(spark, d, t) for t in ("documents", "benchmark", "labels"))
    n = bench.count()
    rows = docs.withColumn("item_id", F.col("doc_id") % n).join(bench.select("item_id", F.col("text").alias("feature")), "item_id").join(labels, "doc_id", "left")
    found = T.grounded(F.array("feature"), "text")
    return rows.select("doc_id", denoise.decide(F.col("toxic") == 1, found, F.col("quality") == 1, F.col("quality") == 0).alias("tag"))


@query(r"""SELECT count(*) FILTER (WHERE quality = 1) AS n_strong, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS n_backup, 0::BIGINT AS n_uncertain, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS n_junk, count(*) AS n_total, true AS checks FROM labels""")
def denoise_totals(spark, d):
    """AG7."""
    tag = denoise.decide(F.lit(False), F.array(F.lit("x")), F.col("quality") == 1, F.col("toxic") == 1)
    return denoise.totals(table(spark, d, "labels").withColumn("tag", tag))


@query(r"""SELECT doc_id, array_to_string(list_concat(['// [HIGH CONFIDENCE SOURCE]' || chr(10) || coalesce(source, '')], ['// [DOMAIN RELATED SOURCE]' || chr(10) || coalesce(lang, '')], ['// [UNCERTAIN SOURCE]' || chr(10) || x for x in string_split(coalesce(text, ''), chr(10))])[1:5], '|') AS tagged FROM documents""")
def snippet_tagging(spark, d):
    """PJ11, WN5."""
    rows = table(spark, d, "documents").select("doc_id", F.array(T.text("source")).alias("s"), F.array(T.text("lang")).alias("b"), F.split(T.text("text"), "\n").alias("u"))
    return rows.select("doc_id", F.array_join(T.tagged_snippets("s", "b", "u"), "|").alias("tagged"))


@query("SELECT toxic::VARCHAR AS system, round(avg(round((quality * 9 + 1 - 1) / 9.0, 4)), 6) AS accuracy, round(avg(round((quality + 4 - 1) / 9.0, 4)), 6) AS coverage, round(avg(round((toxic + 1 - 1) / 9.0, 4)), 6) AS effectiveness FROM labels GROUP BY 1")
def judge_scores(spark, d):
    """PJ16, AG6, LM7's averages over stub scores."""
    rows = table(spark, d, "labels").select(F.col("toxic").cast("string").alias("system"), judge.normalise(F.col("quality") * 9 + 1).alias("accuracy"), judge.normalise(F.col("quality") + 4).alias("coverage"), judge.normalise(F.col("toxic") + 1).alias("effectiveness"))
    return judge.averages(rows).select("system", *(F.round(c, 6).alias(c) for c in judge.CRITERIA))


@query("SELECT toxic::BIGINT AS system, count(*) FILTER (WHERE quality = 1) / count(*) AS accurate_share, count(*) FILTER (WHERE quality = 1) AS gold, count(*) FILTER (WHERE quality = 0) AS fatal FROM labels GROUP BY 1")
def claim_accuracy(spark, d):
    """LM9."""
    claims = table(spark, d, "labels").select(F.col("toxic").cast("long").alias("system"), F.when(F.col("quality") == 1, "ACCURATE/GOLD").otherwise("INACCURATE/FATAL").alias("tag"))
    return judge.claim_accuracy(claims, ["system"]).select("system", "accurate_share", F.col("accurate_gold").alias("gold"), F.col("inaccurate_fatal").alias("fatal"))


@query("""SELECT conv_id, string_agg(text, '|' ORDER BY turn) FILTER (WHERE role = 'user') AS generated_summary_user, string_agg(text, '|' ORDER BY turn) FILTER (WHERE role = 'assistant') AS generated_summary_assistant FROM conversations GROUP BY 1""")
def metrics_pivot(spark, d):
    """JN7, PJ12, SF22: one row a sample, a column for each mode."""
    turns = table(spark, d, "conversations").groupBy("conv_id", F.col("role").alias("generation_mode")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "|").alias("generated_summary"))
    return metrics.pivot_modes(turns, "conv_id", ["user", "assistant"])


@query("SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def json_salvage(spark, d):
    """SF18: replies with prose around, or thinking before, their JSON."""
    wrapped = F.concat(F.lit("<think>{not json}</think> Here it is: "), F.col("props"), F.lit(" as asked."))
    return table(spark, d, "events").select("event_id", F.try_variant_get(T.salvage_json(wrapped), "$.k", "long").alias("k"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_missing(spark, d):
    """SK3, SK5, JN9."""
    from basalt.sources.sinks import missing

    return missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def key_alignment(spark, d):
    """JN8, JN13's set comparison."""
    return curation.key_differences(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber - 1 AS i FROM lineitem), n AS (SELECT o_orderkey, o_orderkey % 7 AS n FROM orders)
SELECT o_orderkey, (SELECT count(*) FROM range(n) r(k) WHERE k NOT IN (SELECT i FROM c WHERE c.l_orderkey = o_orderkey)) AS n_missing FROM n""")
def missing_labels(spark, d):
    """JN13, ST6, LM3's completeness check."""
    got = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct((F.col("l_linenumber") - 1).alias("index"))).alias("results"))
    rows = table(spark, d, "orders").select("o_orderkey").join(got, "o_orderkey", "left").withColumn("results", F.coalesce("results", F.array().cast("array<struct<index:int>>")))
    return rows.select("o_orderkey", F.size(denoise.complete_labels("results", (F.col("o_orderkey") % 7).cast("int"))).cast("long").alias("n_missing"))

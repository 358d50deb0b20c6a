"""Registered queries over code that is made of the driver's tables, with their SQL.

A customer is a function, their orders in order of key its blocks, the lines of an order the block's instructions: a line's
keys choose one of twelve forms of instruction and its registers. SQL has the forms' effects from a table, written down by hand. Suppliers are functions that forward to
others, documents are C files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import callgraph, dataflow, graphs
from basalt.plans.queries import _EDGES, _walks
from basalt.plans.registry import query, table
from basalt.sources import readers
from basalt.sources.shared import scratch_folder

WHOLE, HALF = ("rax", "rbx", "rcx", "rsi", "r8"), ("eax", "ebx", "ecx", "esi", "r8d")
#: Instructions with places for registers (A, B whole; a, b half) and a number, what they define and what they use.
FORMS = [
    ("mov {A}, {B}", ["{A}"], ["{B}"]),
    ("mov {a}, [rbp+var_{n}]", ["{A}"], ["[rbp+{n}]"]),
    ("mov dword ptr [{A}+8], {b}", ["[{A}+8]", "GLOBAL"], ["{A}", "{B}"]),
    ("add {a}, 5 ; step", ["EFLAGS", "{A}"], ["{A}", "CONST"]),
    ("cmp {A}, {B}", ["EFLAGS"], ["{A}", "{B}"]),
    ("jz short loc_40{n}", [], ["EFLAGS", "CONST"]),
    ("call fn_{n}", ["rax"], ["fn_{n}"]),
    ("push {A}", ["stack_{A}"], ["{A}"]),
    ("pop {A}", ["{A}"], ["stack_{A}"]),
    ("xor {a}, {a}", ["EFLAGS", "{A}"], []),
    ("test {A}, {A}", ["EFLAGS", "{A}"], ["{A}"]),
    ("retn", [], ["rax"]),
]


def _filled(template: Column, a: Column, b: Column, n: Column) -> Column:
    names = lambda xs: F.array(*map(F.lit, xs))
    for mark, value in (("{A}", F.get(names(WHOLE), a)), ("{a}", F.get(names(HALF), a)), ("{B}", F.get(names(WHOLE), b)), ("{b}", F.get(names(HALF), b)), ("{n}", n.cast("string"))):
        template = F.replace(template, F.lit(mark), value)
    return template


def _instructions(spark: SparkSession, d: str) -> DataFrame:
    """(fn, block, pos, asm)."""
    # Of keys only what chooses a line's form and registers is shuffled; the text is made behind the shuffles.
    small = {"form": (F.col("l_partkey") + F.col("l_linenumber")) % len(FORMS), "a": F.col("l_suppkey") % 5, "b": F.col("l_partkey") % 5, "n": F.col("l_quantity")}
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), *(x.cast("int").alias(c) for c, x in small.items()))
    lines = lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("fn")), "l_orderkey")
    block = F.dense_rank().over(Window.partitionBy("fn").orderBy("l_orderkey")).cast("long")
    placed = lines.withColumn("block", block)
    asm = _filled(F.get(F.array(*(F.lit(f) for f, _, _ in FORMS)), F.col("form")), F.col("a"), F.col("b"), F.col("n"))
    return placed.select("fn", "block", "pos", asm.alias("asm"))


def _flow(spark: SparkSession, d: str) -> DataFrame:
    """(fn, src, dst): each block goes on to the next; those of urgent orders also two back."""
    orders = table(spark, d, "orders").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey")
    own = Window.partitionBy("o_custkey")
    placed = orders.select(F.col("o_custkey").alias("fn"), F.dense_rank().over(own.orderBy("o_orderkey")).cast("long").alias("src"), F.count(F.lit(1)).over(own).alias("n"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    to = F.array(F.when(F.col("src") < F.col("n"), F.col("src") + 1), F.when(F.col("urgent") & (F.col("src") > 2), F.col("src") - 2))
    return placed.select("fn", "src", F.explode(F.array_compact(to)).alias("dst"))


def _sql_list(xs: list[str] | tuple[str, ...]) -> str:
    return "([" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[])"


_FILL = "replace(replace(replace(replace(replace(x, '{A}', ra), '{a}', ea), '{B}', rb), '{b}', eb), '{n}', n)"
_CODE = f"""t(k, form, d, u) AS (VALUES {", ".join(f"({k}, '{f}', {_sql_list(d)}, {_sql_list(u)})" for k, (f, d, u) in enumerate(FORMS))}),
raw AS (SELECT o_custkey AS fn, dense_rank() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) AS block, l_linenumber AS pos, (l_partkey + l_linenumber) % {len(FORMS)} AS k, l_quantity::INT::VARCHAR AS n,
        {_sql_list(WHOLE)}[l_suppkey % 5 + 1] AS ra, {_sql_list(HALF)}[l_suppkey % 5 + 1] AS ea, {_sql_list(WHOLE)}[l_partkey % 5 + 1] AS rb, {_sql_list(HALF)}[l_partkey % 5 + 1] AS eb FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
filled AS (SELECT fn, block, pos, k, list_transform([form], lambda x: {_FILL})[1] AS asm, list_distinct(list_transform(d, lambda x: {_FILL})) AS d, list_distinct(list_transform(u, lambda x: {_FILL})) AS u FROM raw JOIN t USING (k)),
code AS (SELECT *, row_number() OVER (PARTITION BY fn ORDER BY block, pos, asm) - 1 AS instr FROM filled)"""
_FACTS = f"""{_CODE}, defs AS MATERIALIZED (SELECT fn, instr AS i, block AS b, unnest(d) AS v FROM code), uses AS MATERIALIZED (SELECT fn, instr AS i, block AS b, unnest(u) AS v FROM code),
placed AS (SELECT o_custkey AS fn, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderpriority = '1-URGENT' AS urgent FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
flow AS MATERIALIZED (SELECT fn, s, s + 1 AS t FROM placed WHERE s < n UNION ALL SELECT fn, s, s - 2 FROM placed WHERE urgent AND s > 2),
own AS MATERIALIZED (SELECT DISTINCT fn, b, v FROM defs WHERE v <> 'GLOBAL'),
alive AS (SELECT fn, b, v, max(i) AS i FROM defs WHERE v <> 'GLOBAL' GROUP BY ALL UNION ALL SELECT fn, b, v, i FROM defs WHERE v = 'GLOBAL'),
into_block AS (SELECT a.fn, f.t AS b, a.v, a.i FROM alive a JOIN flow f ON f.fn = a.fn AND f.s = a.b
               UNION SELECT r.fn, f.t, r.v, r.i FROM into_block r JOIN flow f ON f.fn = r.fn AND f.s = r.b LEFT JOIN own o ON o.fn = r.fn AND o.b = r.b AND o.v = r.v WHERE o.v IS NULL)"""
_DEPS = """near AS (SELECT u.fn, u.i, u.v, u.b, max(d.i) AS d FROM {uses} u LEFT JOIN defs d ON d.fn = u.fn AND d.b = u.b AND d.v = u.v AND d.i < u.i GROUP BY ALL),
deps AS (SELECT fn, i, d AS j FROM near WHERE d IS NOT NULL UNION SELECT n.fn, n.i, r.i FROM near n JOIN into_block r ON r.fn = n.fn AND r.b = n.b AND r.v = n.v WHERE n.d IS NULL)"""


@query(f"WITH {_CODE} SELECT fn, instr::BIGINT AS instr, block::BIGINT AS block, split_part(asm, ' ', 1) AS operator, array_to_string(list_sort(d), ' ') AS defs, array_to_string(list_sort(u), ' ') AS uses FROM code")
def instruction_effects(spark, d):
    """SF8, SF9, SF11, GR9, WN8."""
    of = lambda c: F.array_join(F.array_sort(c), " ").alias(c)
    return dataflow.instruction_effects(_instructions(spark, d), "fn").select("fn", "instr", "block", "operator", of("defs"), of("uses"))


@query(f"""WITH {_CODE}, b AS (SELECT fn, block, count(*) AS n FROM code GROUP BY ALL), s AS (SELECT fn, block, coalesce(sum(n) OVER (PARTITION BY fn ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT code.fn, code.block::BIGINT AS block, instr::BIGINT AS instr FROM code JOIN s USING (fn, block) WHERE before <= 20""")
def instruction_numbers(spark, d):
    """WN8, WN9, FL15: running numbers, and no further blocks once a function has over twenty instructions."""
    return dataflow.numbered(_instructions(spark, d), "fn", ["block", "pos", "asm"], 20).select("fn", "block", "instr")


#: Operands with a place for a number: mnemonic, place, operand, then normal form, register of an address, what it is, whether its definition matters outside.
OPERANDS = [
    ("mov", 1, "eax", "rax", None, "register", False),
    ("mov", 2, "r10b", "r10", None, "register", False),
    ("mov", 2, "{n}", "CONST", None, "name", False),
    ("add", 2, "-{n}h", "CONST", None, "name", False),
    ("mov", 1, "qword ptr [rbx+rcx*4-{n}]", "[rbx+rcx*4+{n}]", "rbx", "global", True),
    ("mov", 1, "[rsp+arg_{n}]", "[rsp+{n}]", None, "address", False),
    ("mov", 2, "cs:total_{n}", "total_{n}", None, "name", True),
    ("mov", 2, "offset name_{n}", "CONST", None, "name", False),
    ("lea", 2, "sub_40{n}", "CONST", None, "name", False),
    ("lea", 2, "table_{n}", "table_{n}", None, "name", True),
    ("call", 1, "name_{n}", "name_{n}", None, "name", True),
    ("jmp", 1, "short loc_{n}", "CONST", None, "name", False),
    ("jmp", 1, "rdx", "rdx", None, "register", False),
    ("mov", 2, "fs:[28h]", "[28h]", None, "global", True),
    ("push", 1, "(st{n})", "st{n}", None, "name", True),
    ("inc", 1, "var_{n}", "{n}", None, "number", False),
]


@query(
    f"""WITH o(k, m, p, x, form, register, kind, important) AS (VALUES {", ".join(f"({k}, '{m}', {p}, '{x}', '{f}', {repr(r) if r else 'NULL'}, '{kind}', {str(i).lower()})" for k, (m, p, x, f, r, kind, i) in enumerate(OPERANDS))})
SELECT p_partkey, replace(form, '{{n}}', p_size::VARCHAR) AS form, register, kind, important FROM part JOIN o ON k = p_partkey % {len(OPERANDS)}"""
)
def operand_forms(spark, d):
    """SF9, SF10, SF12, SF13, FL16."""
    parts = table(spark, d, "part").select("p_partkey", "p_size", F.get(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(p).alias("p"), F.lit(x).alias("x")) for m, p, x, *_ in OPERANDS)), (F.col("p_partkey") % len(OPERANDS)).cast("int")).alias("o"))
    rows = parts.select("p_partkey", F.col("o.m").alias("m"), F.col("o.p").alias("p"), F.replace("o.x", F.lit("{n}"), F.col("p_size").cast("string")).alias("x"))
    return dataflow.operand_forms(rows, "p_partkey", "m", "p", "x")


@query(f"WITH RECURSIVE {_FACTS} SELECT fn, b::BIGINT AS block, v AS var, i::BIGINT AS def_instr FROM into_block")
def reaching_definitions(spark, d):
    """GR10."""
    return dataflow.reaching_definitions(_instructions(spark, d), _flow(spark, d), "fn")


@query(f"WITH RECURSIVE {_FACTS}, {_DEPS.format(uses='uses')} SELECT fn, i::BIGINT AS use_instr, j::BIGINT AS def_instr FROM deps")
def data_deps(spark, d):
    """GR14, JN14, ST7, WN11."""
    return dataflow.data_dependences(_instructions(spark, d), _flow(spark, d), "fn")


def _pdom(edges: str, nodes: str) -> str:
    """Post-dominance by what is left without a node: edges (fn, s, t), nodes (fn, x)."""
    return f"""reach AS (SELECT e.fn, d.x AS d, e.s AS a, e.t AS b FROM {edges} e JOIN {nodes} d ON d.fn = e.fn AND e.s <> d.x AND e.t <> d.x
          UNION SELECT r.fn, r.d, r.a, e.t FROM reach r JOIN {edges} e ON e.fn = r.fn AND e.s = r.b AND e.t <> r.d),
exits AS (SELECT fn, x FROM {nodes} WHERE (fn, x) NOT IN (SELECT (fn, s) FROM {edges})),
ends AS (SELECT fn, d, a AS x FROM reach WHERE a = b UNION SELECT x.fn, d.x, x.x FROM exits x JOIN {nodes} d ON d.fn = x.fn AND d.x <> x.x),
escapes AS (SELECT fn, d, x FROM ends UNION SELECT r.fn, r.d, r.a FROM reach r JOIN ends t ON t.fn = r.fn AND t.d = r.d AND t.x = r.b),
pdom AS (SELECT x.fn, x.x AS x, d.x AS p FROM {nodes} x JOIN {nodes} d ON d.fn = x.fn LEFT JOIN escapes e ON e.fn = x.fn AND e.d = d.x AND e.x = x.x WHERE e.x IS NULL),
control AS (SELECT DISTINCT m.fn, m.p AS x, e.s AS p FROM pdom m JOIN {edges} e ON e.fn = m.fn AND e.t = m.x LEFT JOIN pdom n ON n.fn = m.fn AND n.x = e.s AND n.p = m.p WHERE n.p IS NULL)"""


@query(f"""WITH RECURSIVE {_EDGES}, steps AS (SELECT fn, src AS s, dst AS t FROM edges), nodes AS (SELECT fn, s AS x FROM steps UNION SELECT fn, t FROM steps), {_pdom("steps", "nodes")}
SELECT fn, x AS node, p AS depends_on FROM control""")
def control_deps(spark, d):
    """GR13."""
    return graphs.control_dependences(_walks(spark, d), "fn")


@query(
    f"""WITH RECURSIVE {_FACTS}, uses2 AS (SELECT * FROM uses UNION SELECT fn, instr, block, unnest(['rdi', 'rsi', 'rdx', 'rcx', 'r8', 'r9']) FROM code WHERE k = 6), {_DEPS.format(uses="uses2")},
nodes AS (SELECT DISTINCT fn, block AS x FROM code), {_pdom("flow", "nodes")}, last AS (SELECT fn, block, max(instr) AS i FROM code GROUP BY ALL),
need AS MATERIALIZED (SELECT fn, i, j FROM deps UNION SELECT c.fn, c.instr, l.i FROM code c JOIN control q ON q.fn = c.fn AND q.x = c.block JOIN last l ON l.fn = c.fn AND l.block = q.p),
important AS (SELECT fn, instr AS i FROM code WHERE k IN (2, 6, 11)),
back AS (SELECT fn, i AS root, i AS j FROM important UNION SELECT r.fn, r.root, n.j FROM back r JOIN need n ON n.fn = r.fn AND n.i = r.j),
total AS (SELECT fn, count(*) AS n FROM important GROUP BY fn), hit AS (SELECT fn, j, count(*) AS n FROM back GROUP BY ALL)
SELECT c.fn, c.instr::BIGINT AS instr, coalesce(h.n, 0)::BIGINT AS affected, round(coalesce(h.n, 0) / (1e-5::DOUBLE + coalesce(t.n, 0)), 6) AS importance FROM code c LEFT JOIN hit h ON h.fn = c.fn AND h.j = c.instr LEFT JOIN total t ON t.fn = c.fn"""
)
def code_slices(spark, d):
    """GR16, AG16: backward slices over data and control."""
    return dataflow.importance(_instructions(spark, d), _flow(spark, d), "fn").withColumn("importance", F.round("importance", 6))


@query(
    f"""WITH RECURSIVE {_FACTS}, {_DEPS.format(uses="uses")}, e AS (SELECT fn, j AS s, i AS t, row_number() OVER (PARTITION BY fn ORDER BY j, i) AS r FROM deps),
first AS (SELECT fn, s AS x, min(r) AS r, 0 AS side FROM e GROUP BY ALL UNION ALL SELECT fn, t, min(r), 1 FROM e GROUP BY fn, t),
nodes AS (SELECT fn, x, row_number() OVER (PARTITION BY fn ORDER BY side, r) - 1 AS place FROM (SELECT fn, x, min(side) AS side, arg_min(r, side) AS r FROM first GROUP BY fn, x))
SELECT e.fn, a.place::BIGINT AS source_place, b.place::BIGINT AS target_place FROM e JOIN nodes a ON a.fn = e.fn AND a.x = e.s JOIN nodes b ON b.fn = e.fn AND b.x = e.t"""
)
def dependence_index(spark, d):
    """GR15: a dependence graph's edges as places in its list of nodes."""
    found = dataflow.dependence_graph(dataflow.data_dependences(_instructions(spark, d), _flow(spark, d), "fn"), "fn")
    return found.select("fn", F.explode("edge_index").alias("e")).select("fn", F.col("e")[0].alias("source_place"), F.col("e")[1].alias("target_place"))


@query(
    f"""WITH RECURSIVE {_FACTS}, {_DEPS.format(uses="uses")}, near12 AS MATERIALIZED (SELECT * FROM deps WHERE i < 12 AND j < 12), bfs AS (SELECT DISTINCT fn, r.k AS a, r.k AS b, 0 AS dist FROM deps, range(12) r(k)
UNION SELECT f.fn, f.a, e.j, f.dist + 1 FROM bfs f JOIN near12 e ON e.fn = f.fn AND e.i = f.b WHERE f.dist < 11)
SELECT fn, a::BIGINT AS a, b::BIGINT AS b, min(dist)::BIGINT AS dist FROM bfs GROUP BY ALL"""
)
def dependence_distances(spark, d):
    """GR17, FL14: distances among a function's first twelve instructions along its dependences."""
    found = dataflow.dependence_distances(dataflow.data_dependences(_instructions(spark, d), _flow(spark, d), "fn"), "fn", 12)
    rows = found.select("fn", F.posexplode("positions").alias("a", "row")).select("fn", F.col("a").cast("long").alias("a"), F.posexplode("row").alias("b", "dist"))
    return rows.filter("dist >= 0").select("fn", "a", F.col("b").cast("long").alias("b"), F.col("dist").cast("long").alias("dist"))


@query(
    f"""WITH {_CODE} SELECT fn, string_agg(asm, chr(10) ORDER BY block, pos, asm) AS flat, string_agg(asm, chr(10) ORDER BY pos, asm) FILTER (WHERE block = 2) AS second, md5(coalesce(string_agg(asm, chr(10) ORDER BY pos, asm) FILTER (WHERE block = 99), '')) AS missing FROM code GROUP BY fn"""
)
def asm_texts(spark, d):
    """PJ4, PJ5, SF7: block maps to text."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("pos", "asm"))), lambda s: F.struct(s["asm"].alias("disassembly")))
    blocks = _instructions(spark, d).groupBy("fn", "block").agg(lines.alias("instructions"))
    cfg = blocks.groupBy("fn").agg(F.map_from_entries(F.collect_list(F.struct("block", F.struct("instructions")))).alias("cfg"))
    text_of = lambda block: T.block_text("cfg", F.lit(block).cast("long"))
    return cfg.select("fn", F.array_join(T.flat_asm("cfg"), "\n").alias("flat"), F.nullif(text_of(2), F.lit("")).alias("second"), F.md5(text_of(99)).alias("missing"))


@query(
    f"""WITH {_CODE}, o AS (SELECT fn, list(string_split_regex(asm, '[ ,]+') ORDER BY block, pos, asm) AS o FROM code GROUP BY fn)
SELECT fn, array_to_string(flatten(list_transform(range(1, 5), lambda r: [coalesce(o[r][1], '<pad>'), coalesce(o[r][2], '<pad>'), coalesce(o[r][3], '<pad>')])) || ['<inst>', '<inst>', '<inst>', '<inst>', '<cls>'], ' ') AS tokens FROM o"""
)
def block_tokens(spark, d):
    """VC12: four instructions of three tokens each, longer ones cut and shorter ones padded, then node and global tokens."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block", "pos", "asm"))), lambda s: F.split(s["asm"], "[ ,]+"))
    rows = _instructions(spark, d).groupBy("fn").agg(ordered.alias("tokens"))
    return dataflow.block_tokens(rows, "tokens", 3, 4).select("fn", F.array_join("input_tokens", " ").alias("tokens"))


@query()
def cfg_back_edges(spark, d):
    """GR12. Depth-first order has no short SQL; tests hold it against the definition."""
    return graphs.back_edge_rows(_walks(spark, d), "fn")


@query("""WITH s AS (SELECT o_custkey AS fn, o_orderkey % 7 AS a, lead(o_orderkey % 7) OVER w AS b, lead(o_orderpriority) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT DISTINCT fn, a, b FROM s WHERE b IS NOT NULL AND p <> '5-LOW')
SELECT s.fn, count(*) FILTER (s.b IS NOT NULL AND e.fn IS NULL) AS broken FROM s LEFT JOIN e ON e.fn = s.fn AND e.a = s.a AND e.b = s.b GROUP BY s.fn""")
def cfg_path_steps(spark, d):
    """GR8: a customer's orders are a path through seven blocks; steps to an order of low priority are no edges, unless another order made the same step."""
    w = Window.partitionBy("fn").orderBy("o_orderkey")
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("fn"), "o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 7).alias("src"))
    steps = orders.select("fn", "src", F.lead("src").over(w).alias("dst"), F.lead("o_orderpriority").over(w).alias("p"))
    paths = orders.groupBy("fn").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "src"))), lambda x: x["src"]).alias("path"))
    return graphs.broken_steps(paths, steps.filter("dst IS NOT NULL AND p <> '5-LOW'").select("fn", "src", "dst").distinct(), "fn").select("fn", "broken")


#: A supplier's code: one in eight does something, the others forward to the supplier before; two of a hundred are four bytes long.
_BODY = "CASE WHEN s_suppkey % 8 = 0 THEN 'int fn_' || s_suppkey || '(int a)' || chr(10) || '{' || chr(10) || '  a = a + 1;' || chr(10) || '  return a;' || chr(10) || '}' WHEN s_suppkey % 3 = 0 THEN '' ELSE 'int fn_' || s_suppkey || '(int a)' || chr(10) || '{' || chr(10) || '  return fn_' || (s_suppkey - 1) || '(a); // on' || chr(10) || '}' END"


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("fn"), F.concat(F.lit("fn_"), F.col("s_suppkey").cast("string")).alias("name"), F.expr(_BODY.replace("chr(10)", "'\\n'")).alias("code"), "s_nationkey")


_HOPS = """hop AS (SELECT s_suppkey AS fn, CASE WHEN s_suppkey % 8 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey > (SELECT min(s_suppkey) FROM supplier) THEN s_suppkey - 1 END AS to_fn FROM supplier),
follow AS (SELECT fn, fn AS here, 0 AS depth FROM hop UNION ALL SELECT f.fn, h.to_fn, depth + 1 FROM follow f JOIN hop h ON h.fn = f.here WHERE h.to_fn IS NOT NULL AND depth < 5),
resolved AS (SELECT fn, arg_max(here, depth) AS "real" FROM follow GROUP BY fn)"""


@query(f'WITH RECURSIVE {_HOPS} SELECT fn, "real" FROM resolved')
def thunk_resolution(spark, d):
    """SC11: what a thunk forwards to, from its code; five steps at most."""
    return callgraph.resolve_thunks(callgraph.thunk_links(_suppliers(spark, d)))


@query(f"""WITH RECURSIVE {_HOPS}, calls AS (SELECT l_orderkey % 1000 AS caller, l_suppkey AS fn FROM lineitem WHERE l_linenumber % 3 < 2)
SELECT caller, "real" AS callee, count(*) AS n FROM calls JOIN resolved USING (fn) WHERE "real" NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) GROUP BY ALL""")
def call_graph(spark, d):
    """SC9: calls and branches with link, thunks followed, imports left out."""
    suppliers = _suppliers(spark, d)
    mnemonic = F.when(F.col("l_linenumber") % 3 == 0, "callq").when(F.col("l_linenumber") % 3 == 1, "bl").otherwise("mov")
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("fn"), mnemonic.alias("mnemonic"), F.col("l_suppkey").alias("target"))
    return callgraph.calls_in(lines, callgraph.thunk_links(suppliers), suppliers.filter("s_nationkey < 5").select("fn"))


@query("""SELECT s_suppkey AS fn FROM supplier WHERE s_nationkey % 6 NOT IN (1, 2) AND (s_suppkey % 8 = 0 OR s_suppkey % 3 <> 0) AND s_suppkey % 5 <> 0 AND s_nationkey <> 3""")
def external_functions(spark, d):
    """SC12: imports, import segments, functions without code, and jumps are left out."""
    segment = F.when(F.col("s_nationkey") % 6 == 1, ".PLT").when(F.col("s_nationkey") % 6 == 2, ".idata$5").otherwise(".text")
    suppliers = _suppliers(spark, d).withColumn("segment", segment).withColumn("mnemonic", F.when(F.col("fn") % 5 == 0, "JMP").otherwise("push"))
    return callgraph.without_external(suppliers, suppliers.filter("s_nationkey = 3").select("fn")).select("fn")


@query("SELECT s_suppkey AS fn, (s_suppkey % 8 <> 0 AND s_suppkey % 3 <> 0) OR s_suppkey % 50 = 8 AS noise FROM supplier")
def noise_functions(spark, d):
    """SC13: forwarders, and functions of four bytes that return."""
    suppliers = _suppliers(spark, d).withColumn("size", F.when(F.col("fn") % 50 == 8, 4).otherwise(40)).withColumn("mnemonic", F.when(F.col("fn") % 50 == 8, "retn"))
    return suppliers.select("fn", T.is_noise("code", "size", "mnemonic").alias("noise"))


@query(r"""WITH t AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}\p{M}\p{Pc}]+|[^\s\p{L}\p{N}\p{M}\p{Pc}]')) AS n FROM documents) SELECT doc_id FROM t WHERE doc_id % 7 <> 0 AND doc_id % 5 > 1 AND n + 12 > 30 AND n + 12 < 9192""")
def harvest_gate(spark, d):
    """SC7: decompiled, of medium size, no noise."""
    # What would make code of the text becomes another sign each: a blank in its place would take a token.
    docs = table(spark, d, "documents").select("doc_id", F.translate(T.text("text"), "{};/", "####").alias("text"))
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("int f(int a)\n{\n  return g("), "text", F.lit(");\n}"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("// attributes: thunk\nint f() "), "text"))
    code = F.when(F.col("doc_id") % 7 != 0, F.coalesce(body, F.concat(F.lit("f(){a;b;}c;;"), "text")))
    return docs.withColumn("code", code).filter(T.harvested("code")).select("doc_id")


_ABOUT = "coalesce(lang, 'none')"
_FILE = f"""CASE doc_id % 4 WHEN 0 THEN '/* Doc of ' || {_ABOUT} || '. More. */' || chr(10) || 'static int fn_' || doc_id || '(int a, int b)' || chr(10) || '{{' || chr(10) || '  if (a) {{ return b; }}' || chr(10) || '  return ' || n_chars || ';' || chr(10) || '}}' || chr(10)
WHEN 1 THEN '// First line' || chr(10) || '// about ' || {_ABOUT} || ' @x' || chr(10) || 'void fn_' || doc_id || '(void) {{ while (1) {{ }} }}' || chr(10)
WHEN 2 THEN 'int fn_' || doc_id || '(int a)' || chr(10) || '{{' || chr(10) || '  return a;' || chr(10)
ELSE 'int helper_' || doc_id || '(int a) {{ return a; }}' || chr(10) || 'int x = 3;' || chr(10) || chr(10) || 'char * fn_' || doc_id || '(char *s) {{ return s; }}' END"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    """(file_path, text): a C file for each document."""
    return table(spark, d, "documents").select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".c"))).alias("file_path"), F.expr(_FILE.replace("chr(10)", "'\\n'")).alias("text"))


@query(
    f"""WITH f AS (SELECT doc_id, coalesce(source, 'none') AS project_name, {_ABOUT} AS lang FROM documents)
SELECT project_name, 'fn_' || doc_id AS function_name, CASE doc_id % 4 WHEN 0 THEN 'Doc of ' || lang WHEN 1 THEN 'First line about ' || lang END AS comment, CASE doc_id % 4 WHEN 0 THEN '}}' WHEN 1 THEN 'void fn_' || doc_id || '(void) {{ while (1) {{ }} }}' ELSE 'char * fn_' || doc_id || '(char *s) {{ return s; }}' END AS tail FROM f WHERE doc_id % 4 <> 2
UNION ALL SELECT project_name, 'helper_' || doc_id, NULL, 'int helper_' || doc_id || '(int a) {{ return a; }}' FROM f WHERE doc_id % 4 = 3"""
)
def c_extraction(spark, d):
    """SC2-SC5: functions, balanced bodies, first sentences of comments; an unclosed body is no function."""
    files = _files(spark, d).select(T.first_path_part("file_path").alias("project_name"), "file_path", "text")
    return readers.c_functions(files).select("project_name", "function_name", "comment", F.substring_index("source_code", "\n", -1).alias("tail"))


@query(f"SELECT 'project=' || coalesce(source, 'none') AS project_name, sum(length({_FILE}) + 1)::BIGINT AS chars FROM documents GROUP BY 1")
def c_tree(spark, d):
    """SC1, SC5: files below a root, read whole, by project."""
    root = f"{scratch_folder(spark)}/c-tree"
    _files(spark, d).select(T.first_path_part("file_path").alias("project"), F.col("text").alias("value")).write.partitionBy("project").text(root)
    return readers.c_files(spark, root, "*.txt").groupBy("project_name").agg(F.sum(F.char_length("text")).alias("chars"))


@query("SELECT s_suppkey AS function_addr, 'fn_' || s_suppkey AS function_name, s_nationkey::BIGINT AS callee, (1 + s_suppkey % 5)::BIGINT AS n_blocks, (s_suppkey % 5)::BIGINT AS n_edges FROM supplier")
def disassembly_export(spark, d):
    """SC6: JSON objects keyed by address, a file for each binary."""
    root = f"{scratch_folder(spark)}/export"
    # A chain of one to five blocks.
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("s_suppkey") % 5), lambda k: F.struct(k.cast("string").alias("key"), F.struct(k.alias("start_ea"), F.when(k < F.col("s_suppkey") % 5, F.array(k + 1)).otherwise(F.array().cast("array<bigint>")).alias("successors")).alias("value")))
    fields = F.struct("function_name", F.col("s_suppkey").alias("start_ea"), F.col("s_name").alias("decompiled_code"), F.map_from_entries(blocks).alias("cfg"), F.create_map(F.col("s_nationkey").cast("string"), F.lit(1)).alias("callees"))
    rows = table(spark, d, "supplier").withColumn("function_name", F.concat(F.lit("fn_"), F.col("s_suppkey").cast("string")))
    objects = rows.groupBy(F.col("s_nationkey").alias("binary")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), fields)))).alias("value"))
    objects.write.partitionBy("binary").text(root)
    found = readers.disassembly(spark, root, "*.txt")
    return found.select("function_addr", "function_name", F.map_keys("callees")[0].cast("long").alias("callee"), F.size("cfg").cast("long").alias("n_blocks"),
                        F.aggregate(F.map_values("cfg"), F.lit(0).cast("long"), lambda n, b: n + F.size(b["successors"])).alias("n_edges"))

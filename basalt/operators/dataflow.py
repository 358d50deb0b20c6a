"""Def-use analysis of disassembled functions: reaching definitions, data dependences, importance slices.

Instructions are numbered through a function's blocks in address order. What they define and use, the last definitions of blocks, dependences within blocks and slices
are expressions, windows and joins; only the breadth-first searches over a function's blocks or instructions are Python (`graphs.walks`, `_meetings`).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import asm
from basalt.operators.graphs import control_dependences, onwards, walks
from basalt.sources.shared import kept

MOST_INSTRUCTIONS = 2000


def _block_sizes(instructions: DataFrame, fn: str, block: str) -> DataFrame:
    """(fn, block, n): how many instructions each block has."""
    return instructions.groupBy(fn, block).agg(F.count(F.lit(1)).alias("n"))


def _cuts(sizes: DataFrame, fn: str, block: str, most: int) -> DataFrame:
    """(cut_fn, cut): of functions that are too long, the first block that has over `most` instructions before it."""
    before = F.sum("n").over(Window.partitionBy(fn).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("before", before).filter(F.col("before") > most).groupBy(F.col(fn).alias("cut_fn")).agg(F.min(block).alias("cut"))


def instruction_effects(instructions: DataFrame, fn: str, strict_flags: bool = False, most: int | None = MOST_INSTRUCTIONS) -> DataFrame:
    """(fn, instr, block, asm, operator, defs, uses) of instructions (fn, block, pos, asm): numbered from 0 through the blocks, as by `numbered`. Null code is an empty instruction; rows without a block are left out."""
    rows = instructions.filter("block IS NOT NULL").select(fn, F.col("block").cast("long").alias("block"), "pos", F.coalesce("asm", F.lit("")).alias("asm"))
    found = numbered(rows, fn, ["block", "pos", "asm"], most).withColumn("effects", asm.effects(F.col("asm"), strict_flags))
    return found.select(fn, "instr", "block", "asm", "effects.operator", "effects.defs", "effects.uses")


def flow_within(instructions: DataFrame, edges: DataFrame, fn: str, most: int | None = MOST_INSTRUCTIONS) -> DataFrame:
    """(fn, src, dst): the distinct edges among blocks that `numbered` doesn't cut. Blocks without instructions stay."""
    links = edges.filter("dst IS NOT NULL").select(fn, F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    if most is None:
        return links
    cut = _cuts(kept(_block_sizes(instructions.filter("block IS NOT NULL").select(fn, F.col("block").cast("long").alias("block")), fn, "block")), fn, "block", most)
    return links.join(cut, F.col(fn) == F.col("cut_fn"), "left").filter("cut IS NULL OR src < cut AND dst < cut").select(fn, "src", "dst")


def _reaching(facts: DataFrame, flow: DataFrame, fn: str) -> DataFrame:
    """(fn, block, var, def_instr): the definitions that reach a block's start. GLOBAL is defined but never killed, CONST never defined.

    A block's last definition of a variable goes on until a block defines it again; one search for each such block.
    """
    defs = facts.select(fn, "block", "instr", F.explode("defs").alias("var")).filter(F.col("var") != asm.CONST)
    named = F.col("var") == asm.GLOBAL
    last = defs.groupBy(fn, "block", "var").agg(F.when(named, F.collect_list("instr")).otherwise(F.array(F.max("instr"))).alias("instrs"))
    asked = last.groupBy(fn, F.col("var").alias("label")).agg(F.collect_list("block").alias("starts"))
    asked = asked.withColumn("closed", F.when(F.col("label") == asm.GLOBAL, F.array().cast("array<bigint>")).otherwise(F.col("starts")))
    found = walks(flow, asked, fn).select(fn, F.col("label").alias("var"), F.col("start").alias("block"), "node")
    return found.join(last, [fn, "var", "block"]).select(fn, F.col("node").alias("block"), "var", F.explode("instrs").alias("def_instr"))


def _events(facts: DataFrame, fn: str, uses: Column) -> DataFrame:
    """(fn, block, var, instr, is_def, near): each use, with the latest definition before it in its block, and each block's last definition of a variable (all of GLOBAL, none of CONST). Partitions by function or block stay."""
    named = lambda vs, is_def: F.transform(vs, lambda v: F.struct(v.alias("var"), F.lit(is_def).alias("is_def")))
    events = facts.select(fn, "block", "instr", F.inline(F.concat(named(uses, False), named(F.col("defs"), True))))
    # In a block an instruction uses before it defines.
    own = Window.partitionBy(fn, "block", "var")
    so_far = own.orderBy("instr", "is_def").rowsBetween(Window.unboundedPreceding, -1)
    definition = F.when(F.col("is_def"), F.col("instr"))
    events = events.withColumn("near", F.last(definition, ignorenulls=True).over(so_far)).withColumn("last_def", F.max(definition).over(own))
    goes_on = (F.col("var") != asm.CONST) & ((F.col("instr") == F.col("last_def")) | (F.col("var") == asm.GLOBAL))
    return events.filter(~F.col("is_def") | goes_on).drop("last_def")


def _meetings(g: dict[int, list[int]], back: dict[int, list[int]], defs: dict[int, list[int]], uses: dict[int, list[int]], closed: frozenset) -> Iterator[tuple[list[int], list[int]]]:
    """(uses, definitions) of each two blocks of which the second's definitions reach the first. g, back: edges and the same backwards. Searches start on the side that has fewer blocks."""
    if len(defs) <= len(uses):
        for start, own in defs.items():
            yield from ((uses[node], own) for node in onwards(g, start, closed) if node in uses)
    else:
        for start, own in uses.items():
            yield from ((own, defs[node]) for node in onwards(back, start, closed) if node in defs)


def _definitions_met(events: DataFrame, flow: DataFrame, fn: str) -> DataFrame:
    """(fn, use_instr, def_instr), distinct: for each variable used, the latest definition before it in its block, else all that reach the block. events: of `_events`, written.

    Of what reaches a block only the variables that it uses before it defines them are asked for, and only blocks that use them are told.
    Functions may be of any size: their rows are sorted, not gathered, and of one function the edges and a variable's rows are held at a time.
    """
    near = events.filter("NOT is_def AND near IS NOT NULL").select(fn, F.col("instr").alias("use_instr"), F.col("near").alias("def_instr"))
    open_ = events.filter("is_def OR near IS NULL").select(fn, "var", "block", "instr", "is_def")
    # A function's edges come before its variables, as rows without one.
    links = flow.filter(F.col(fn).isNotNull()).select(fn, F.lit(None).cast("string").alias("var"), F.col("src").alias("block"), F.col("dst").alias("instr"), F.lit(False).alias("is_def"))
    placed = links.unionByName(open_).repartition(fn).sortWithinPartitions(fn, F.col("var").asc_nulls_first())
    ever, most = asm.GLOBAL, 50_000

    def met(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, own in groupby(rows, itemgetter(0)):
            g, back = defaultdict(list), defaultdict(list)
            for var, found in groupby(own, itemgetter(1)):
                defs, uses = defaultdict(list), defaultdict(list)
                for _, _, a, b, is_def in found:
                    if var is None:
                        g[a].append(b)
                        back[b].append(a)
                    else:
                        (defs if is_def else uses)[a].append(b)
                yield from ((key, *pair) for pair in _meetings(g, back, defs, uses, frozenset() if var == ever else frozenset(defs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, numbers = None, pa.list_(pa.int64())
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kind, numbers, numbers), strict=True)], names=[fn, "uses", "defs"])

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for b in batches:
                kind = b.schema.types[0]
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out, n = [], 0
        for row in met(rows()):
            out.append(row)
            n += len(row[1]) + len(row[2])
            if n >= most:
                yield batch(out)
                out, n = [], 0
        if out:
            yield batch(out)

    found = placed.mapInArrow(run, f"`{fn}` {events.schema[fn].dataType.simpleString()}, uses array<bigint>, defs array<bigint>").select(fn, F.explode("uses").alias("use_instr"), "defs")
    return near.unionByName(found.select(fn, "use_instr", F.explode("defs").alias("def_instr"))).distinct()


def numbered(instructions: DataFrame, fn: str, order: list[str], most: int | None = MOST_INSTRUCTIONS) -> DataFrame:
    """Add `instr`, an instruction's number in its function from 0 by order (the block first), natively. A block is left out if the blocks before it have over `most` instructions; none is if that is None.

    What is left of a function after that is numbered in one partition; instructions that are dealt by function already aren't shuffled."""
    block = order[0]
    placed = instructions.filter(F.col(fn).isNotNull() & F.col(block).isNotNull())
    if most is not None:
        cut = _cuts(_block_sizes(instructions, fn, block), fn, block, most)
        placed = placed.join(cut, F.col(fn) == F.col("cut_fn"), "left").filter(F.col("cut").isNull() | (F.col(block) < F.col("cut"))).drop("cut_fn", "cut")
    inside = F.row_number().over(Window.partitionBy(fn).orderBy(*order)) - 1
    return placed.withColumn("instr", inside.cast("long"))


def operand_forms(df: DataFrame, key: str, operator: str, place: str, operand: str) -> DataFrame:
    """(key, form, register, kind, important): an operand in normal form, the register that an address in it uses, and what it is: a register, number, hex number, address off the stack, another address, or another name; `important` if its definition matters outside the function. Nulls count as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = df.select(key, asm.operand_form(text(operator), F.col(place), text(operand)).alias("form"))
    return found.select(key, "form", F.when(asm.is_address(F.col("form")), asm.address_register(F.col("form"))).alias("register"), asm.operand_kind(F.col("form")).alias("kind"), asm.is_important(F.col("form")).alias("important"))


def reaching_definitions(instructions: DataFrame, edges: DataFrame, fn: str) -> DataFrame:
    """(fn, block, var, def_instr) of instructions (fn, block, pos, asm) and edges (fn, src, dst)."""
    return _reaching(kept(instruction_effects(instructions, fn)), flow_within(instructions, edges, fn), fn)


def data_dependences(instructions: DataFrame, edges: DataFrame, fn: str) -> DataFrame:
    """(fn, use_instr, def_instr), distinct, of whole functions: none is cut, however long."""
    events = kept(_events(instruction_effects(instructions, fn, most=None), fn, F.col("uses")))
    return _definitions_met(events, flow_within(instructions, edges, fn, most=None), fn)


def importance(instructions: DataFrame, edges: DataFrame, fn: str) -> DataFrame:
    """(fn, instr, affected, importance): how many important instructions (calls, returns, writes outside the frame) each one affects, and their share, by backward slices over data and control.

    A call is taken to use all registers of arguments; an instruction depends on the last one of each block that its block is controlled by.
    """
    facts, flow = kept(instruction_effects(instructions, fn)), kept(flow_within(instructions, edges, fn))
    arguments = F.array_distinct(F.concat("uses", F.when(F.col("operator").contains("call"), F.array(*map(F.lit, asm.ARGUMENTS))).otherwise(F.array().cast("array<string>"))))
    data = _definitions_met(kept(_events(facts, fn, arguments)), flow, fn)
    ends = facts.groupBy(fn, F.col("block").alias("depends_on")).agg(F.max("instr").alias("def_instr"))
    control = control_dependences(flow, fn).join(ends, [fn, "depends_on"]).select(fn, F.col("node").alias("block"), "def_instr")
    links = data.unionByName(facts.join(control, [fn, "block"]).select(fn, F.col("instr").alias("use_instr"), "def_instr"))
    is_root = F.exists("defs", asm.is_important) | F.col("operator").rlike("call|ret")
    roots = facts.filter(is_root).groupBy(fn).agg(F.collect_list("instr").alias("starts"))
    asked = roots.select(fn, F.lit("").alias("label"), "starts", F.array().cast("array<bigint>").alias("closed"))
    met = walks(links.select(fn, F.col("use_instr").alias("src"), F.col("def_instr").alias("dst")), asked, fn).filter("node <> start").groupBy(fn, F.col("node").alias("instr")).agg(F.count(F.lit(1)).alias("others"))
    own = facts.select(fn, "instr", is_root.cast("long").alias("own")).withColumn("roots", F.sum("own").over(Window.partitionBy(fn)))
    affected = F.col("own") + F.coalesce("others", F.lit(0))
    return own.join(met, [fn, "instr"], "left").select(fn, "instr", affected.alias("affected"), (affected / (F.col("roots") + F.lit(1e-5))).alias("importance"))


def code_features(instructions: DataFrame, edges: DataFrame, fn: str) -> DataFrame:
    """(fn, code, data_dep): a function's code and dependences as nested records, in order."""
    facts = kept(instruction_effects(instructions, fn))
    deps = _definitions_met(kept(_events(facts, fn, F.col("uses"))), flow_within(instructions, edges, fn), fn)
    number = lambda c, name: F.col(c).cast("int").alias(name)
    code = facts.groupBy(fn).agg(F.sort_array(F.collect_list(F.struct(number("instr", "id"), F.substring_index("asm", ";", 1).alias("asm")))).alias("code"))
    pairs = deps.groupBy(fn).agg(F.sort_array(F.collect_list(F.struct(number("use_instr", "use_id"), number("def_instr", "def_id")))).alias("data_dep"))
    return code.join(pairs, fn, "left").select(fn, "code", F.coalesce("data_dep", F.array().cast("array<struct<use_id:int,def_id:int>>")).alias("data_dep"))


def dependence_graph(deps: DataFrame, fn: str) -> DataFrame:
    """Nodes and index pairs of a function's dependence edges, natively: sources in order of first use, then targets. deps: (fn, use_instr, def_instr)."""
    pairs = deps.groupBy(fn).agg(F.sort_array(F.collect_list(F.struct(F.col("def_instr").alias("s"), F.col("use_instr").alias("t")))).alias("edges"))
    nodes = F.array_distinct(F.concat(F.transform("edges", lambda e: e["s"]), F.transform("edges", lambda e: e["t"])))
    placed = pairs.withColumn("nodes", nodes)
    return placed.select(fn, "nodes", F.transform("edges", lambda e: F.array(F.array_position("nodes", e["s"]) - 1, F.array_position("nodes", e["t"]) - 1)).alias("edge_index"))


def dependence_distances(deps: DataFrame, fn: str, max_blocks: int) -> DataFrame:
    """(fn, positions): shortest distances among the first max_blocks instructions along dependences; -1 where there is none. Edges beyond are cut."""
    deps = kept(deps.select(fn, F.col("use_instr").cast("long").alias("src"), F.col("def_instr").cast("long").alias("dst")))
    near = deps.filter((F.col("src") < max_blocks) & (F.col("dst") < max_blocks))
    asked = near.groupBy(fn).agg(F.collect_set("src").alias("starts")).select(fn, F.lit("").alias("label"), "starts", F.array().cast("array<bigint>").alias("closed"))
    far = walks(near, asked, fn).groupBy(fn).agg(F.map_from_entries(F.collect_list(F.struct(F.col("start") * max_blocks + F.col("node"), "steps"))).alias("far"))
    places = F.sequence(F.lit(0).cast("long"), F.lit(max_blocks - 1).cast("long")) if max_blocks > 0 else F.array().cast("array<bigint>")
    distance = lambda a, b: F.when(a == b, F.lit(0)).otherwise(F.coalesce(F.col("far")[a * max_blocks + b].cast("int"), F.lit(-1)))
    return deps.select(fn).distinct().join(far, fn, "left").select(fn, F.transform(places, lambda a: F.transform(places, lambda b: distance(a, b))).alias("positions"))


def block_tokens(code: DataFrame, tokens: str, block_size: int, max_blocks: int, pad: str = "<pad>", inst: str = "<inst>", cls: str = "<cls>", node_size: int = 1, global_size: int = 1) -> DataFrame:
    """Token rows of fixed length, natively: each instruction cut or padded to block_size, blocks padded to max_blocks, then node and global tokens. tokens: array<array<string>>."""
    rows = F.slice(tokens, 1, max_blocks)
    fixed = F.transform(rows, lambda r: F.slice(F.concat(F.slice(r, 1, block_size), F.array_repeat(F.lit(pad), block_size)), 1, block_size))
    flat = F.slice(F.concat(F.flatten(fixed), F.array_repeat(F.lit(pad), block_size * max_blocks)), 1, block_size * max_blocks)
    return code.withColumn("input_tokens", F.concat(flat, F.array_repeat(F.lit(inst), max_blocks * node_size), F.array_repeat(F.lit(cls), global_size)))

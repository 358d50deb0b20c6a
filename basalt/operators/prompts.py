"""Prompts: cheapest order of paths, rendering with references to repeated blocks, and prompt texts."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as T

REPEAT_COST = 10


def path_order(blocks: DataFrame, fn: str, path: str = "path", pos: str = "pos", content: str = "content", most: int = 3) -> DataFrame:
    """(fn, path_order, cost): the permutation of up to three paths in which showing each distinct block in full once and REPEAT_COST for every repeat costs least; of equals the first in order.

    Of a distinct block only the length at its first place in each path and the number of all its places matter. These are aggregated, and permutations are
    tried in a function's row, natively.
    """
    hashed = blocks.select(fn, F.col(path).alias("p"), F.col(pos).alias("i"), T.short_hash(content).alias("h"), F.char_length(content).cast("long").alias("n"))
    first = hashed.groupBy(fn, "h", "p").agg(F.min_by("n", "i").alias("n"), F.count(F.lit(1)).alias("c"))
    each = first.groupBy(fn, "h").agg(F.collect_list(F.struct("p", "n")).alias("at"), F.sum("c").alias("c"))
    whole = each.groupBy(fn).agg(F.collect_list(F.struct("at", "c")).alias("shown"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("at", lambda x: x["p"]))))).alias("ps"))
    orders = F.array(*(F.array(*(F.lit(i) for i in o)) for k in range(1, most + 1) for o in permutations(range(k))))
    tried = F.transform(F.filter(orders, lambda o: F.size(o) == F.size("ps")), lambda o: F.transform(o, lambda i: F.get("ps", i)))

    def length(at: Column, order: Column) -> Column:
        """Of a block, the length at the first path of the order that holds it."""
        here = F.filter(F.transform(order, lambda p: F.get(F.filter(at, lambda x: x["p"] == p), F.lit(0))["n"]), lambda n: n.isNotNull())
        return F.coalesce(F.get(here, F.lit(0)), F.lit(0).cast("long"))

    def cost(order: Column) -> Column:
        return F.aggregate("shown", F.lit(0).cast("long"), lambda total, b: total + length(b["at"], order) + (b["c"] - 1) * REPEAT_COST)

    best = F.array_min(F.transform(tried, lambda o: F.struct(cost(o).alias("cost"), o.alias("path_order"))))
    return whole.select(fn, best.alias("best")).filter("best IS NOT NULL").select(fn, "best.path_order", "best.cost")


def compressed(blocks: DataFrame, fn: str, path: str = "path", pos: str = "pos", content: str = "content", place: str | None = None) -> DataFrame:
    """(fn, path, pos, shown, and place if given): a block in full where it comes first in its function, `Same as REF_<path>_<pos>` where it repeats. place: a column with the place at which a path is shown; its own number if not given."""
    h = blocks.withColumn("block_hash", T.short_hash(content))
    w = Window.partitionBy(fn, "block_hash").orderBy(place or path, pos)
    first = F.first(F.struct(F.col(path).alias("p"), F.col(pos).alias("i"))).over(w)
    marked = h.withColumn("first_at", first)
    here = (F.col("first_at.p") == F.col(path)) & (F.col("first_at.i") == F.col(pos))
    return marked.withColumn("shown", F.when(here, F.col(content)).otherwise(F.concat(F.lit("Same as REF_"), F.col("first_at.p").cast("string"), F.lit("_"), F.col("first_at.i").cast("string")))).drop("first_at", "block_hash")


def rendered(shown: DataFrame, fn: str, path: str = "path", pos: str = "pos", place: str | None = None) -> DataFrame:
    """(fn, prompt_blocks): all paths' blocks as one text, paths by number or by place."""
    lines = shown.groupBy(fn, path).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, "shown"))), lambda s: s["shown"]), "\n").alias("t"), F.min(place or path).alias("shown_at"))
    whole = F.sort_array(F.collect_list(F.struct("shown_at", path, "t")))
    return lines.groupBy(fn).agg(F.array_join(F.transform(whole, lambda s: F.concat(F.lit("Path "), s[path].cast("string"), F.lit(":\n"), s["t"])), "\n\n").alias("prompt_blocks"))


def in_best_order(blocks: DataFrame, fn: str, path: str = "path", pos: str = "pos", content: str = "content", most: int = 4) -> DataFrame:
    """(fn, prompt_blocks): paths in their cheapest order (`path_order`), repeated blocks referring to where they stand first in that order. Functions with more than `most` paths keep the order of path numbers."""
    order = path_order(blocks, fn, path, pos, content, most).select(fn, "path_order")
    at = F.coalesce(F.array_position("path_order", F.col(path)).cast("long"), F.col(path).cast("long"))
    placed = blocks.join(order, fn, "left").withColumn("shown_place", at).drop("path_order")
    return rendered(compressed(placed, fn, path, pos, content, "shown_place"), fn, path, pos, "shown_place")


def reference_prompt(source: str | Column) -> Column:
    return F.concat(F.lit("In one sentence of at most 30 words, state what this C function is for.\n\n"), T.text(source))


def path_prompt(blocks: str | Column) -> Column:
    return F.concat(F.lit('Describe each execution path below, and what they do together. Reply in JSON: {"path_summaries": {"path_1": "..."}, "global_summary": "..."}\n\n'), T.text(blocks))


def synthesis_prompt(code: str | Column, paths: str | Column | None = None, snippets: str | Column | None = None) -> Column:
    """The summary prompt: code, then what context a mode has."""
    out = F.concat(F.lit("Summarise this decompiled function in one sentence.\n\nCode:\n"), T.text(code))
    if paths is not None:
        out = F.concat(out, F.lit("\n\nBehaviour along its paths:\n"), T.text(paths))
    if snippets is not None:
        out = F.concat(out, F.lit("\n\nSource fragments that may be related, tagged by confidence:\n"), T.numbered(F.coalesce(T.col(snippets), F.array().cast("array<string>"))))
    return out


def junk_prompt(snippets: str | Column) -> Column:
    return F.concat(F.lit('Label every fragment as junk or not. Reply in JSON: {"results": [{"index": 0, "is_junk": false, "reason": "..."}]}\n\n'), T.numbered(snippets))


def match_prompt(code: str | Column, snippets: str | Column) -> Column:
    return F.concat(F.lit('Name distinctive strings of the code, and say of each fragment whether it matches the source or the domain. Reply in JSON: {"has_strong_features": true, "extracted_features": [], "results": [{"index": 0, "is_source_match": false, "is_domain_match": false, "evidence": ""}]}\n\nCode:\n'), T.text(code), F.lit("\n\nFragments:\n"), T.numbered(snippets))


def semantics_prompt(source: str | Column) -> Column:
    return F.concat(F.lit('State the purpose and the critical semantics of this function. Reply in JSON: {"core_primary_purpose": "", "critical_semantics": []}\n\n'), T.text(source))


def claims_prompt(semantics: str | Column, summaries: str | Column) -> Column:
    return F.concat(F.lit("Split each labelled summary into claims and tag each ACCURATE/GOLD, ACCURATE/SAFE, INACCURATE/FATAL or INACCURATE/NOISE. Reply in JSON by label.\n\nSemantics:\n"), T.text(semantics), F.lit("\n\nSummaries:\n"), T.text(summaries))


def scores_prompt(claims: str | Column) -> Column:
    return F.concat(F.lit("From the tagged claims give each label accuracy, coverage and effectiveness from 1 to 10 with reasons. Reply in JSON by label.\n\n"), T.text(claims))

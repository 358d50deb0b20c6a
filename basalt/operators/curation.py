"""Matching binary functions with sources, quality gates, deduplication, references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.sources.shared import checkpointed


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: later rows win."""
    return first_seen(df, key, [F.desc(c) for c in order])


def first_seen(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key. Spark keeps one row of a key in each task before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("seen_rank", F.row_number().over(w)).filter("seen_rank = 1").drop("seen_rank")


def match_stripped(stripped: DataFrame, unstripped: DataFrame) -> DataFrame:
    """Functions of both builds by address, with the name and code that each has."""
    key = ["project_name", "binary_name", "function_addr"]
    u = unstripped.select(*key, "function_name", "decompiled_code")
    s = stripped.withColumnsRenamed({"function_name": "strip_function_name", "decompiled_code": "strip_decompiled_code"})
    return s.join(u, key)


def match_source(binaries: DataFrame, sources: DataFrame, order: Sequence[str], required: bool = True) -> DataFrame:
    """Binary functions with the source of the same project (up to its hyphen) and name; of several sources the last by `order`. required: unmatched ones go."""
    norm = T.project_of("project_name")
    build = latest(sources.withColumn("match_project", norm), ["match_project", "function_name"], order).select("match_project", "function_name", "source_code", "comment")
    return binaries.withColumn("match_project", norm).join(build, ["match_project", "function_name"], "inner" if required else "left").drop("match_project")


def quality_gates(df: DataFrame, source_required: bool = True) -> DataFrame:
    """Token bounds of code and source, a graph with an edge, a caller or callee."""
    keep = T.token_gate("strip_decompiled_code") & T.has_edges("cfg") & T.connected("callees", "callers")
    source = F.col("source_code").isNotNull() & T.token_gate("source_code") if source_required else F.col("source_code").isNull() | T.token_gate("source_code")
    return df.filter(keep & source)


def _short_key(c: str, order: str) -> Column:
    """128 bits of a key; a key of the row's own where it is null, so that nulls neither clash nor meet in one partition."""
    return F.unhex(F.coalesce(F.md5(F.col(c).cast("string")), F.md5(F.concat(F.lit("null "), F.col(order).cast("string")))))


def greedy_dedup(df: DataFrame, order: str, first: str, second: str) -> DataFrame:
    """In order, a row is kept unless a kept row has its `first` or its `second` key; null keys never clash. `order` is unique and not null.

    Keys are compared by 128-bit hashes, so that no text is shuffled. Rounds: a row that comes first for both keys among the undecided is kept, and all that share
    a key with a kept row go. Rows equal in both keys are settled beforehand, so large groups of copies are
    one aggregated row. Rounds end when nothing is undecided; they are few, for a chain of n clashes n at most.
    """
    narrow = df.select(F.col(order).alias("o"), _short_key(first, order).alias("a"), _short_key(second, order).alias("b"))
    todo = checkpointed(narrow.groupBy("a", "b").agg(F.min("o").alias("o")).select("o", "a", "b"))
    kept = None
    while True:
        a = todo.groupBy("a").agg(F.min("o").alias("a_first"))
        b = todo.groupBy("b").agg(F.min("o").alias("b_first"))
        now = checkpointed(todo.join(a, "a").join(b, "b").filter("o = a_first AND o = b_first").select("o", "a", "b"))
        kept = now if kept is None else kept.unionByName(now)
        todo = checkpointed(todo.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select("o", "a", "b"))
        if todo.isEmpty():
            break
    return df.join(kept.select(F.col("o").alias(order)), order, "left_semi")


def collect_references(df: DataFrame, project: str, source: str, order: Sequence[str], exact: bool = False) -> DataFrame:
    """One item for each reference key, first seen; blank sources are left out."""
    key = T.reference_key_exact(project, source) if exact else T.reference_key(project, source)
    return first_seen(df.filter(F.trim(T.text(source)) != "").withColumn("key", key), ["key"], order)


def apply_reference(df: DataFrame, references: DataFrame, project: str, source: str, exact: bool = False) -> DataFrame:
    """Add `reference` by key; null where there is none. references: (key, reference), a row for each key."""
    key = T.reference_key_exact(project, source) if exact else T.reference_key(project, source)
    return df.withColumn("key", key).join(references.select("key", "reference"), "key", "left")


def reference_counters(df: DataFrame, arch: str, project: str, source: str, order: Sequence[str], exact: bool = False) -> DataFrame:
    """(arch, items, added, total): rows, reference keys that no architecture before (in order of name) has, and keys so far. A row for each architecture is numbered in one task."""
    first = collect_references(df, project, source, [arch, *order], exact).groupBy(arch).agg(F.count(F.lit(1)).alias("added"))
    counted = df.groupBy(arch).agg(F.count(F.lit(1)).alias("items")).join(first, arch, "left").withColumn("added", F.coalesce("added", F.lit(0)).cast("long"))
    return counted.withColumn("total", F.sum("added").over(Window.orderBy(arch).rowsBetween(Window.unboundedPreceding, 0)))


def reference_totals(applied: DataFrame, by: str) -> DataFrame:
    """(by, applied, missing): rows with and without a reference."""
    return applied.groupBy(by).agg(F.count("reference").alias("applied"), F.count_if(F.col("reference").isNull()).alias("missing"))


def dataset_columns(df: DataFrame) -> DataFrame:
    """The dataset projection, with the counts of calls that the neighbour maps stand for."""
    calls = lambda c: F.coalesce(F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, n: a + F.coalesce(n.cast("long"), F.lit(0))), F.lit(0).cast("long")).alias(f"{c}_call_count")
    return df.select("project_name", "function_addr", "strip_function_name", "strip_decompiled_code", "source_code", "comment", "cfg", "codeart", "callers", "callees", calls("callers"), calls("callees"))


def baseline_columns(df: DataFrame) -> DataFrame:
    """Names that baseline systems expect, beside the original ones."""
    alias = {"function_name_in_strip": "strip_function_name", "function_body": "source_code", "pseudo_code": "strip_decompiled_code", "pseudo_code_non_strip": "decompiled_code", "pseudo_code_refined": "strip_decompiled_code", "meta": "project_name"}
    return df.select("*", *(F.col(c).alias(n) for n, c in alias.items()))


def require_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fail at run time on a row in which a field is null or blank."""
    for c in fields:
        df = df.withColumn(c, F.when(F.trim(T.text(c)) != "", F.col(c)).otherwise(F.raise_error(F.lit(f"empty field {c}")).cast("string")))
    return df


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("right")))

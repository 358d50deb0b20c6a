"""Call graphs: counting, inverting, thunks, enrichment with neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators import messages


def calls_in(instructions: DataFrame, functions: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(caller, callee, n) from instructions (fn, mnemonic, target): call* and bl*, thunks followed, imports and unknown targets left out. functions: (fn, thunk_of)."""
    calls = instructions.filter(F.col("mnemonic").startswith("call") | F.col("mnemonic").startswith("bl")).select(F.col("fn").alias("caller"), F.col("target").alias("fn"))
    real = resolve_thunks(functions)
    calls = calls.join(real, "fn").select("caller", F.col("real").alias("callee"))
    if imports is not None:
        calls = calls.join(imports.select(F.col("fn").alias("callee")), "callee", "left_anti")
    return call_counts(calls)


def resolve_thunks(functions: DataFrame, depth: int = 5) -> DataFrame:
    """(fn, real): thunk_of followed for `depth` steps at most; in a cycle it ends there."""
    hop = functions.select(F.col("fn").alias("hop"), F.col("thunk_of").alias("next"))
    out = functions.select("fn", F.col("fn").alias("real"))
    for _ in range(depth):
        out = out.join(hop, out.real == hop.hop, "left").select("fn", F.coalesce("next", "real").alias("real"))
    return out


def call_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n"))


def callers_of(counts: DataFrame) -> DataFrame:
    """The inverse graph, a row for each pair: (callee, caller, n)."""
    return counts.select("callee", "caller", "n")


def caller_maps(counts: DataFrame, most: int = 10_000) -> DataFrame:
    """(callee, n_callers, callers: map from caller to count). A callee with more than `most` callers has a null map, so that no row grows without bound: `callers_of` has its callers."""
    sizes = counts.groupBy("callee").agg(F.count(F.lit(1)).alias("n_callers"))
    maps = counts.join(sizes.filter(F.col("n_callers") <= most).select("callee"), "callee", "left_semi").groupBy("callee").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("caller", "n")))).alias("callers"))
    return sizes.join(maps, "callee", "left")


def thunk_links(functions: DataFrame) -> DataFrame:
    """(fn, thunk_of) of (fn, name, code): a noise function that returns the call of a function of that name forwards to it. Of equal names the smallest fn."""
    names = functions.groupBy(F.col("name").alias("target_name")).agg(F.min("fn").alias("thunk_of"))
    marked = functions.select("fn", F.when(T.is_noise("code"), T.thunk_target("code")).alias("target_name"))
    return marked.join(names, "target_name", "left").select("fn", "thunk_of")


def without_external(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """Functions (fn, segment, code, mnemonic, ...) that are neither imported nor stubs of imports."""
    return functions.filter(~T.is_external("segment", "code", "mnemonic")).join(imports.select("fn"), "fn", "left_anti")


def enrich(fns: DataFrame, edges: DataFrame, fn_key: str, value: str, source: str, target: str, name: str, most: int = 1000) -> DataFrame:
    """Add a map from neighbour to its `value`, for neighbours that are in the dataset themselves; an empty map else. edges: (source, target).

    A function with more than `most` such neighbours keeps the first by key, so that no row grows without bound; they are picked before any value moves, and by each task for itself before they meet."""
    known = fns.select(F.col(fn_key).alias(target), F.col(value).alias("neighbour_value"))
    picked = first_neighbours(edges.join(known.select(target), target, "left_semi"), source, target, most).select(source, target)
    maps = picked.join(known, target).groupBy(source).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(target, "neighbour_value")))).alias(name))
    kind = maps.schema[name].dataType
    empty = F.map_from_arrays(F.array().cast(f"array<{kind.keyType.simpleString()}>"), F.array().cast(f"array<{kind.valueType.simpleString()}>"))
    return fns.join(maps.withColumnRenamed(source, fn_key), fn_key, "left").withColumn(name, F.coalesce(name, empty))


def first_neighbours(edges: DataFrame, source: str, target: str, k: int = 5) -> DataFrame:
    """Each function's first k neighbours by key."""
    w = Window.partitionBy(source).orderBy(target)
    return edges.select(source, target).distinct().withColumn("neighbour_rank", F.row_number().over(w)).filter(F.col("neighbour_rank") <= k)


def star_edges(callers: DataFrame, callees: DataFrame, k: int = 5) -> DataFrame:
    """A target's star: (target, neighbour, edge_type), callers 0 and callees 1, k of each. callers, callees: (target, neighbour)."""
    part = lambda df, kind: first_neighbours(df, "target", "neighbour", k).select("target", "neighbour", F.lit(kind).alias("edge_type"))
    return part(callers, 0).unionByName(part(callees, 1))


def mean_neighbours(edges: DataFrame, vectors: DataFrame, source: str, target: str) -> DataFrame:
    """(source, embedding): the mean of the neighbours' vectors. vectors: (target, embedding)."""
    return messages.mean_messages(vectors, edges, target, "embedding", target, source).withColumnRenamed(target, source)

"""Training sets for encoder and prober models: splits, neighbour lists and fixed columns. Models themselves are trained elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.operators.splits import split_80_10_10
from basalt.sources.sinks import write_table


def neighbour_list(c: str, k: int = 5):
    """The first k neighbours' records by key, without the keys."""
    values = F.transform(F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: e["value"])
    return F.slice(values, 1, k)


def contrastive_set(dataset: DataFrame) -> DataFrame:
    """(fn_id, split, src, codeart, callers, callees): source text in every split, neighbours as nested records."""
    return split_80_10_10(dataset, ["fn_id"]).select("fn_id", "split", F.col("source_code").alias("src"), "codeart", neighbour_list("caller_code").alias("callers"), neighbour_list("callee_code").alias("callees"))


def signature_set(dataset: DataFrame) -> DataFrame:
    """The contrastive set with sources cut to signatures."""
    return contrastive_set(dataset).withColumn("src", T.signature("src"))


def probing_set(dataset: DataFrame) -> DataFrame:
    """Test functions to probe, with code and comment."""
    return split_80_10_10(dataset, ["fn_id"]).filter("split = 'test'").select("fn_id", "strip_decompiled_code", "comment", "codeart", neighbour_list("caller_code").alias("callers"), neighbour_list("callee_code").alias("callees"))


def save(rows: DataFrame, path: str) -> None:
    """A training set as a table, a folder for each split where it has splits."""
    write_table(rows, path, "split")

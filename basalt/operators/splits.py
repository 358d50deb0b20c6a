"""Positions in a total order, and splits, limits and top-k by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.sources.shared import checkpointed


def positions(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Number rows from 1 in a total order, without bringing them to one task: range partitions are numbered each, and shifted by the rows before them (a row for each partition)."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = checkpointed(ranged.withColumn("split_part", F.spark_partition_id()).withColumn("split_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = marked.groupBy("split_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("split_part", (F.sum("n").over(Window.orderBy("split_part")) - F.col("n")).alias("before"))
    # One row for each partition of the range shuffle.
    return marked.join(F.broadcast(before), "split_part").withColumn(name, F.col("before") + F.col("split_at") + 1).drop("split_part", "split_at", "before")


def split_80_10_10(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Add `split`: train up to n*8 div 10 rows in order, valid up to n*9 div 10, then test. Exact, by integer arithmetic."""
    placed = positions(df, order, "split_position")
    n = placed.agg(F.count(F.lit(1)).alias("split_n"))
    at = F.col("split_position")
    out = placed.join(F.broadcast(n))
    return out.withColumn("split", F.when(at <= F.expr("split_n * 8 div 10"), "train").when(at <= F.expr("split_n * 9 div 10"), "valid").otherwise("test")).drop("split_n")


def first_rows(df: DataFrame, order: Sequence[str | Column], n: int = 200) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first n rows of each group in order, ranked from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def zip_by_position(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str], same_length: bool = False) -> DataFrame:
    """Pair rows by place in order: for checks against positional tools; joins by key are the rule here. same_length: tables of different lengths are an error."""
    left, right = positions(a, order_a, "zip_position"), positions(b, order_b, "zip_position")
    if same_length and (sizes := (left.count(), right.count()))[0] != sizes[1]:
        raise ValueError(f"tables of {sizes[0]} and {sizes[1]} rows can't be paired")
    return left.join(right, "zip_position", "left")

"""Sinks: partitioned tables, JSON reports, resumable appends, versioned rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: str | None = "arch") -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by in df.columns else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One file with one JSON array, for reports: the rows of each partition are put together where they are, and one task writes them one after another."""
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    numbered = lines.withColumn("at", F.monotonically_increasing_id())
    first = numbered.agg(F.min("at").alias("first"))
    comma = F.when(F.col("at") == F.col("first"), F.concat(F.lit("["), F.col("value"))).otherwise(F.concat(F.lit(","), F.col("value")))
    body = numbered.join(F.broadcast(first)).select("at", comma.alias("value"))
    end = df.sparkSession.range(1).select(F.lit((1 << 63) - 1).alias("at"), F.lit("]" if not df.isEmpty() else "[]").alias("value"))
    body.unionByName(end).repartition(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def missing(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return df.join(done.select(key), key, "left_anti")


def append_missing(df: DataFrame, path: str, key: str, compute, commits: int = 1) -> None:
    """Compute what a table at path lacks, and append it: a later call goes on from there. With several commits, classes of the key's hash are computed and appended one after another, so that less is lost if the run ends."""
    spark = df.sparkSession
    for k in range(commits):
        part = df if commits == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(commits)) == k)
        try:
            todo = missing(part, spark.read.parquet(path), key)
        except Exception as e:  # the first call finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            todo = part
        compute(todo).write.mode("append").parquet(path)


def next_version(df: DataFrame, root: str, version: int) -> str:
    """Write an enriched table beside the one it was read from, never over it."""
    path = f"{root}/v{version:06d}"
    df.write.mode("error").parquet(path)
    return path


def shards(df: DataFrame, n: int, order: str) -> DataFrame:
    """Contiguous shards of equal size (the last may be smaller) by a position column that counts from 1."""
    total = df.agg(F.max(order)).first()[0] or 0
    return df.withColumn("shard", F.floor((F.col(order) - 1) / F.lit(max(1, -(-total // n)))).cast("int"))


def latest_checkpoint(spark: SparkSession, names: DataFrame, name_col: str = "name") -> DataFrame:
    """checkpoint-<n> with the largest n."""
    n = F.regexp_extract(name_col, r"^checkpoint-(\d+)$", 1).try_cast("long")
    return names.filter(n.isNotNull()).agg(F.max_by(name_col, n).alias("checkpoint"))

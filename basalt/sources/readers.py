"""Readers: C source trees, disassembler exports, JSON and Parquet tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions import c_source
from basalt.functions.text import first_path_part
from basalt.sources import schemas


def c_files(spark: SparkSession, root: str, pattern: str = "*.c") -> DataFrame:
    """(project_name, file_path, text) of all files below root whose names fit; the project is the first folder of the path below it."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    tail = F.substring_index(F.col("_metadata.file_path"), root.rstrip("/").split("://")[-1] + "/", -1)
    return files.select(first_path_part(tail).alias("project_name"), tail.alias("file_path"), F.col("value").alias("text"))


def c_functions(files: DataFrame, with_comment: bool = True) -> DataFrame:
    """Functions of (project_name, file_path, text) rows: a row for each, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.project_name, r.file_path, *f) for r in b.itertuples(index=False) for f in c_source.functions(r.text or "", with_comment)]
            yield pd.DataFrame(rows, columns=["project_name", "file_path", "function_name", "source_code", "comment"])

    return files.select("project_name", "file_path", "text").mapInPandas(run, schemas.SOURCE_FUNCTION)


def disassembly(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Functions of disassembler exports, one JSON object keyed by address per file: project_name, binary_name and the function's fields, addresses as numbers."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    parsed = files.select(F.col("_metadata.file_path").alias("file_path"), F.explode(F.from_json("value", f"map<string, {schemas.DISASSEMBLED}>")).alias("ea", "f"))
    parts = F.split("file_path", "/")
    return parsed.select(
        F.element_at(parts, -2).alias("project_name"), F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("binary_name"), F.coalesce("f.start_ea", F.col("ea").try_cast("bigint")).alias("function_addr"),
        "f.function_name", "f.decompiled_code", F.transform_keys("f.cfg", lambda k, _: k.try_cast("bigint")).alias("cfg"), "f.callees", "f.callers",
    )


def records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table by its extension: .jsonl a record a line, .json an array, else Parquet."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith(".jsonl"):
        return reader.json(path)
    return reader.option("multiLine", True).json(path) if path.endswith(".json") else reader.parquet(path)


def arrow_records(files: DataFrame, schema: str, content: str = "content") -> DataFrame:
    """Records of Arrow stream files, as datasets saved to disk hold them: files has their bytes, a row each (`arrow_files` reads them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield from pa.ipc.open_stream(data.as_buffer())

    return files.select(content).mapInArrow(run, schema)


def arrow_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of all *.arrow files below path."""
    return arrow_records(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.arrow").load(path), schema)


def binary_pairs(stripped: DataFrame, unstripped: DataFrame) -> DataFrame:
    """Binaries that both exports have: (project_name, binary_name)."""
    key = ["project_name", "binary_name"]
    return stripped.select(*key).distinct().join(unstripped.select(*key).distinct(), key)


def architectures(df: DataFrame, arch_col: str = "arch") -> DataFrame:
    """Architectures of a partitioned table: names with an underscore, in order."""
    return df.select(arch_col).distinct().filter(F.contains(F.col(arch_col), F.lit("_"))).orderBy(arch_col)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """A saved key table (key, embedding)."""
    return spark.read.parquet(path)

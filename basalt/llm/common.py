"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII white space, the separators of words and the characters stripped from lines.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes Spark's byte-wise path; only other texts pay for translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or a folder of our own where it is unset and all run in one process (tests); elsewhere an unset one is an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="basalt-checkpoint-")
        sc.setCheckpointDir(configured)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


#: Rows of an intermediate table that one file holds where the number of rows is known.
FILE_ROWS = 250_000


def _files(df: DataFrame, rows: int | None) -> DataFrame:
    return df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder. rows: about how many there are, so that few rows aren't spread over many files."""
    shared_dir(df.sparkSession)
    return _files(df, rows).checkpoint(eager=True)


def scratch_table(df: DataFrame, name: str, partition_by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Write a columnar intermediate once into the shared folder and read it back, so that it survives lost executors and isn't computed twice. rows as for `cut`."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = _files(df, rows).write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_key(c: str | Column) -> Column:
    """A column as a join key of its own. Rows that are already dealt by the column are dealt anew by this key, so that Spark may split a partition in which one key has very many rows."""
    return F.hex(c)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediates in whatever store it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def process_memo(owner: str) -> dict:
    """What a Python worker keeps from task to task for one operator (loaded models, word tables), however this code has reached it. Workers outlive operators, so what another operator has left goes first."""
    memo = sys.modules.setdefault("basalt_process_memo", types.ModuleType("basalt_process_memo")).__dict__
    if memo.get("owner") != owner:
        memo.pop("tables", None)
        gc.collect()
        pa.default_memory_pool().release_unused()
        # glibc keeps what was freed unless it is asked; other C libraries lack the call.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
        memo["owner"] = owner
    return memo.setdefault("tables", {})

"""Dropping lines that many documents share, with levelled sorted runs of line hashes.

The store keeps, for every line key seen so far, its 128-bit hash and the number of
documents that hold it, in sorted runs (tables bucketed and sorted by hash).
Documents come in batches. A new batch is dealt to the buckets, merge-anti-joined with
the decided keys of all runs (those that have reached the threshold: they need no
further counting), and what is left of it is added as a run of level 0. When a
level holds `fan_in` runs they are merged, counts of a key added up, into one run of
the next level, and go: n batches leave at most fan_in - 1 runs on each of some log n levels, and no more are anti-joined. All runs have the
same buckets, so merging two and anti-joining them needs no shuffle (Spark sorts each bucket's rows once more); the batch itself is shuffled, once, and in the end the few runs that are left.
Runs are files below the session's checkpoint folder, and are deleted with their tables whether the job ends well or not.

Counts of a batch are added up in each Arrow batch and again by Spark's partial aggregation
before the shuffle, so a line that every document holds is a few rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import process_memo, remove, scratch_table, shared_dir

_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_keys(text: str) -> list[bytes]:
    """Lines of a text, each stripped of ASCII white space and with A-Z lower-cased."""
    return [line.strip(_WHITE).lower() for line in text.encode().split(b"\n")]


def key_hash(key: bytes) -> tuple[int, int]:
    """128 bits as two signed 64-bit numbers."""
    n = xxhash.xxh3_128_intdigest(key)
    high, low = n >> 64, n & 0xFFFFFFFFFFFFFFFF
    return high - (high >> 63 << 64), low - (low >> 63 << 64)


def count_lines(df: DataFrame, id_col: str, text_col: str, batches: int) -> DataFrame:
    """(batch, h1, h2, docs): in how many documents of a batch a line key stands, by hash, partly added up. Empty keys are left out. A batch is a hash class of the id."""
    batch_of = F.pmod(F.xxhash64(id_col), F.lit(batches))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            counts: Counter = Counter()
            for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys = set(line_keys(text.as_py() or ""))
                keys.discard(b"")
                counts.update((k, key) for key in keys)
            hashes = [key_hash(key) for _, key in counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in counts], pa.int64()), pa.array([h for h, _ in hashes], pa.int64()), pa.array([h for _, h in hashes], pa.int64()), pa.array(counts.values(), pa.int64())],
                names=["batch", "h1", "h2", "docs"],
            )

    counted = df.select(batch_of.alias("batch"), F.col(text_col)).mapInArrow(run, "batch long, h1 long, h2 long, docs long")
    return counted.groupBy("batch", "h1", "h2").agg(F.sum("docs").alias("docs"))


class LineRuns:
    """Levelled sorted runs of (h1, h2, docs). A run is a table of two parts, `decided` or not, with the same buckets, in a folder of the store."""

    def __init__(self, spark: SparkSession, threshold: int, fan_in: int = 2, buckets: int | None = None):
        self.spark, self.threshold, self.fan_in = spark, threshold, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.folder = f"{shared_dir(spark)}/{self.name}"
        self.levels: list[list[str]] = []
        self.made = 0

    @property
    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, rows: DataFrame) -> str:
        """rows are dealt by bucket already: each task writes its own bucket's file."""
        self.made += 1
        table = f"{self.name}_{self.made}"
        marked = rows.select("h1", "h2", "docs", (F.col("docs") >= self.threshold).alias("decided"))
        marked.write.partitionBy("decided").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", f"{self.folder}/{table}").saveAsTable(table)
        return table

    def _decided(self, table: str) -> DataFrame:
        return self.spark.table(table).filter("decided").select("h1", "h2")

    def _drop(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            remove(self.spark, f"{self.folder}/{t}")

    def append(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, docs), a row for each key: dealt to the buckets once, merge-anti-joined with the decided keys of every run, and written as a run."""
        batch = batch.select("h1", "h2", "docs").repartition(self.buckets, "h1", "h2")
        for t in self.runs:
            batch = batch.join(self._decided(t).hint("merge"), ["h1", "h2"], "left_anti")
        self._add(0, self._write(batch))

    def _add(self, level: int, table: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fan_in:
            old = self.levels[level]
            merged = self._write(self._merged(old))
            self.levels[level] = []
            self._drop(old)
            self._add(level + 1, merged)

    def _merged(self, tables: list[str]) -> DataFrame:
        """The rows of runs, counts of a key added up: a merge of buckets; of two runs without a shuffle."""
        rows = lambda t: self.spark.table(t).select("h1", "h2", "docs")
        out = rows(tables[0])
        for t in tables[1:]:
            other = rows(t).withColumnRenamed("docs", "more").hint("merge")
            out = out.join(other, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"))
        return out

    def frequent(self) -> DataFrame:
        """(h1, h2) of every key that has reached the threshold over all runs, written outside the store."""
        if not self.runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        rows = [self.spark.table(t).select("h1", "h2", "docs") for t in self.runs]
        whole = rows[0] if len(rows) == 1 else reduce(DataFrame.unionByName, rows).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))
        return scratch_table(whole.filter(F.col("docs") >= self.threshold).select("h1", "h2"), "line-frequent")

    def close(self) -> None:
        """Delete all tables and files of the store, those of a write that failed, too."""
        self._drop([f"{self.name}_{k + 1}" for k in range(self.made)])
        remove(self.spark, self.folder)
        self.levels = []


def frequent_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """(h1, h2) of line keys that stand in min_docs documents or more. The text is read once; each batch's counts are then appended to the store in turn."""
    store = LineRuns(df.sparkSession, min_docs, fan_in)
    try:
        counted = scratch_table(count_lines(df, id_col, text_col, batches), "line-counts", ["batch"])
        for k in range(batches):
            store.append(counted.filter(F.col("batch") == k))
        return store.frequent()
    finally:
        store.close()


def _cut(text: str, drop) -> tuple[str, int, int]:
    lines = text.split("\n")
    kept = [line for line, key in zip(lines, line_keys(text), strict=True) if not key or not drop(key)]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def drop_frequent_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    batches: int = 4,
    fan_in: int = 2,
    broadcast_keys: int = 500_000,
) -> DataFrame:
    """One row per document: the id, the text without its frequent lines, n_lines, n_dropped.

    Null and empty texts are one empty line, and come back empty. Empty keys
    are never dropped. A line that a document repeats counts once for it; rows that share an id are documents of their own.
    An empty input gives an empty result. Only the id and the text are read.

    Up to `broadcast_keys` frequent keys (16 bytes each) are broadcast; beyond that the lines are
    joined with the keys by hash, and each document gets its line numbers to drop.
    """
    spark = df.sparkSession
    frequent = frequent_lines(df, id_col, text_col, min_docs, batches, fan_in)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{text_col}` string, n_lines long, n_dropped long"
    names = [id_col, text_col, "n_lines", "n_dropped"]

    def batch_of(ids, rows):
        return pa.RecordBatch.from_arrays([ids, pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2))], names=names)

    if frequent.count() <= broadcast_keys:
        rows = frequent.toArrow()
        keys = spark.sparkContext.broadcast(np.stack([rows["h1"].to_numpy(), rows["h2"].to_numpy()], axis=1))

        own = uuid.uuid4().hex

        def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = process_memo("lines")
            if memo.get("keys", (None,))[0] != own:
                memo["keys"] = (own, {(a << 64) + b for a, b in keys.value.tolist()})
            known = memo["keys"][1]

            def drop(key: bytes) -> bool:
                a, b = key_hash(key)
                return (a << 64) + b in known

            for b in arrow:
                for lo in range(0, len(b), 512):
                    part = b.slice(lo, 512)
                    yield batch_of(part.column(0), [_cut(t or "", drop) for t in part.column(1).to_pylist()])

        return df.select(id_col, text_col).mapInArrow(run, schema)

    def explode(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            found = [(r, p, *key_hash(key)) for r, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for p, key in enumerate(line_keys(t.as_py() or "")) if key]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], names=["line_row", "line_at", "h1", "h2"])

    def cut(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            rows = []
            for text, dropped in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines, gone = (text or "").split("\n"), set(dropped or ())
                rows.append(("\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone)))
            yield batch_of(b.column(0), rows)

    placed = df.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("line_row"))
    marks = placed.select("line_row", text_col).mapInArrow(explode, "line_row long, line_at long, h1 long, h2 long").join(frequent, ["h1", "h2"])
    marks = marks.groupBy("line_row").agg(F.collect_set("line_at").alias("line_drop"))
    return placed.join(marks, "line_row", "left").select(id_col, text_col, "line_drop").mapInArrow(cut, schema)

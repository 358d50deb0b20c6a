"""Records of gzipped pickles and of JSON files, read without running anything that a file holds.

A pickle may name any importable function and have it called. This reader builds plain containers and values only: a file that names a
global of any kind is refused, and is an error row. Spark reads the files (so they may lie in any store that it reaches) and spreads them over tasks;
a file is decompressed and read in one task, up to a stated size.
"""

from __future__ import annotations

import base64
import io
import json
import pickle
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GZIP = b"\x1f\x8b"
#: Bytes that a file may have unpacked, values that its records may have, and records put out at a time.
MOST_BYTES, MOST_VALUES, ROWS = 1 << 30, 50_000_000, 1000


class Refused(Exception):
    """A file that asks for more than plain values."""


class _Plain(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        raise Refused(f"refused: {module}.{name}")

    def persistent_load(self, pid):
        raise Refused("refused: a persistent id")


def unpacked(data: bytes, most: int = MOST_BYTES) -> bytes:
    """The bytes of a file that may be gzipped, several members too."""
    if not data.startswith(GZIP):
        return data
    out, size = [], 0
    while data.startswith(GZIP):
        reader = zlib.decompressobj(31)
        part = reader.decompress(data, most - size + 1)
        size += len(part)
        if size > most:
            raise Refused(f"refused: over {most} bytes unpacked")
        if not reader.eof:
            raise ValueError("the file ends early")
        out.append(part)
        data = reader.unused_data
    return b"".join(out)


class _Budget:
    def __init__(self, left: int):
        self.left = left

    def plain(self, x: Any, depth: int = 0) -> Any:
        """A value that JSON has: keys are strings, bytes base64, sets in order of their text. Values that a file names again and again count each time."""
        self.left -= 1
        if self.left < 0 or depth > 200:
            raise Refused("refused: too many or too deep values")
        if isinstance(x, dict):
            return {k if isinstance(k, str) else json.dumps(self.plain(k, depth + 1)) if isinstance(k, tuple | frozenset) else str(k): self.plain(v, depth + 1) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [self.plain(v, depth + 1) for v in x]
        if isinstance(x, set | frozenset):
            return sorted((self.plain(v, depth + 1) for v in x), key=lambda v: json.dumps(v, sort_keys=True))
        if isinstance(x, bytes | bytearray):
            return base64.b64encode(bytes(x)).decode()
        return x


def loaded(data: bytes, most: int = MOST_BYTES) -> Any:
    """What a file holds: a pickle's value, or else that of its JSON."""
    data = unpacked(data, most)
    try:
        return _Plain(io.BytesIO(data)).load()
    except Refused:
        raise
    except Exception as first:  # pickle raises many kinds for bytes that are none
        try:
            return json.loads(data)
        except (ValueError, RecursionError):
            raise ValueError(f"neither a pickle ({type(first).__name__}) nor JSON") from None


def pickled_records(files: DataFrame, schema: str, path: str = "path", content: str = "content", most: int = MOST_BYTES) -> DataFrame:
    """(path, position, record, error): a row for each record of each file. A list's or tuple's elements are its records, any other value is one. record: a struct of `schema`, fields that a record lacks null.

    A file that can't be read, is refused, or has over `most` bytes unpacked is one row with an error and no position; null contents too. An empty file list gives an empty result. Records that aren't objects have null fields.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(name, positions, texts, error=None):
            return pa.RecordBatch.from_arrays([pa.array([name] * len(positions), pa.string()), pa.array(positions, pa.int64()), pa.array(texts, pa.string()), pa.array([error] * len(positions), pa.string())], names=["path", "position", "json", "error"])

        for batch in batches:
            for k in range(len(batch)):
                name, data = batch.column(0)[k].as_py(), batch.column(1)[k]
                try:
                    found = loaded(data.as_py(), most) if data.is_valid else None
                    if found is None:
                        raise ValueError("nothing in it")
                    budget = _Budget(MOST_VALUES)
                    rows = found if isinstance(found, list | tuple) else [found]
                    texts = (json.dumps(budget.plain(r)) for r in rows)
                    # A file is read as a whole before any of its records goes on, so that an error leaves no half of it.
                    ready = [list(range(len(rows))), list(texts)]
                except (Refused, ValueError, RecursionError, MemoryError, zlib.error, TypeError) as e:
                    yield out(name, [None], [None], str(e)[:200])
                    continue
                for lo in range(0, len(rows), ROWS):
                    yield out(name, ready[0][lo : lo + ROWS], ready[1][lo : lo + ROWS])

    rows = files.select(F.col(path).cast("string"), content).mapInArrow(run, "path string, position long, json string, error string")
    return rows.select("path", "position", F.from_json("json", schema).alias("record"), "error")


def pickle_files(spark: SparkSession, path: str, schema: str, pattern: str = "*.{pkl,pkl.gz,gz,json}") -> DataFrame:
    """`pickled_records` of all files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return pickled_records(files, schema)

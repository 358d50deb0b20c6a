"""Exact top-k by Hamming distance with incremental multi-index hashing.

Vectors become sign codes (a bit for each dimension, set where positive) of as many 64-bit words as the longest needs.
Equal codes are collapsed, each with its k smallest ids, which is all that a
result can need. Distinct codes are dealt to shards of a bounded expected size, which is what a task indexes; queries go to every shard in blocks. A search takes
a small power of a shard's codes, so shards are large, and the number of (shard, block) pairs is queries times codes over both sizes.
In a shard, codes are cut into segments of about log2(shard) bits, and each segment has
a table from value to codes. A query looks at segment values within radius 0, then 1, then 2, of its
own, one segment after another. With all segments searched to radius r - 1 and the first j of m to r, every
code within m r + j - 1 bits has been seen; when the kth verified distance is at
most that, the query is done. Shards' results are merged by distance and id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import scratch_table

BITS = 64


def code_of(vector: str, words: int = 1) -> F.Column:
    """The sign code of a vector column, as so many 64-bit words: bit i set where element i is over 0; missing, null and NaN elements count as not positive. Native."""
    v = F.col(vector)

    def word(first: int) -> F.Column:
        out = None
        for i in range(BITS):
            x = F.get(v, F.lit(first + i))
            b = F.when((x > 0) & ~F.isnan(x), F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
            out = b if out is None else out.bitwiseOR(b)
        return out

    return F.when(v.isNotNull(), F.array(*(word(BITS * k) for k in range(words))))


def _packed(code: str) -> F.Column:
    """An array of words as bytes, which come to Python in one piece."""
    return F.unhex(F.array_join(F.transform(code, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def _codes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u8").astype(np.uint64).reshape(len(column), -1)


class SegmentIndex:
    """Tables from segment value to codes, of one shard. codes: a row of 64-bit words for each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = BITS * codes.shape[1]
        self.m = max(1, round(self.bits / max(1.0, np.log2(max(2, len(codes))))))
        edges = [self.bits * j // self.m for j in range(self.m + 1)]
        # A table of 2**width entries: segments stay at 20 bits at most.
        while max(b - a for a, b in zip(edges, edges[1:], strict=False)) > 20:
            self.m += 1
            edges = [self.bits * j // self.m for j in range(self.m + 1)]
        self.shift, self.width, self.order, self.first = edges[:-1], [b - a for a, b in zip(edges, edges[1:], strict=False)], [], []
        for j in range(self.m):
            values = self.values(codes, j)
            self.order.append(np.argsort(values, kind="stable"))
            self.first.append(np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << self.width[j]))]))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def values(self, codes: np.ndarray, j: int) -> np.ndarray:
        word, off = divmod(self.shift[j], BITS)
        out = codes[..., word] >> np.uint64(off)
        if off + self.width[j] > BITS:
            out = out | codes[..., word + 1] << np.uint64(BITS - off)
        return (out & np.uint64((1 << self.width[j]) - 1)).astype(np.int64)

    def flips(self, width: int, radius: int) -> np.ndarray:
        if (width, radius) not in self.masks:
            self.masks[width, radius] = np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], np.int64)
        return self.masks[width, radius]

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices and distances of all codes that are no farther than the kth; distances in rising order."""
        seen = np.zeros(len(self.codes), bool)
        at_distance = np.zeros(self.bits + 1, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        own = [int(self.values(query, j)) for j in range(self.m)]
        k = min(k, len(self.codes))
        for radius in range(max(self.width) + 1):
            for j in range(self.m):
                if radius <= self.width[j]:
                    probe = own[j] ^ self.flips(self.width[j], radius)
                    first, n = self.first[j][probe], self.first[j][probe + 1] - self.first[j][probe]
                    held = n > 0
                    first, n = first[held], n[held]
                    rows = self.order[j][np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    rows = rows[~seen[rows]]
                    seen[rows] = True
                    distance = np.bitwise_count(self.codes[rows] ^ query).sum(axis=1, dtype=np.int64)
                    at_distance += np.bincount(distance, minlength=self.bits + 1)
                    found.append((rows, distance))
                covered = self.m * radius + j
                if at_distance[: covered + 1].sum() >= k:
                    rows, distance = (np.concatenate(x) for x in zip(*found, strict=True))
                    kth = int(np.searchsorted(np.cumsum(at_distance), k))
                    near = np.flatnonzero(distance <= kth)
                    near = near[np.argsort(distance[near], kind="stable")]
                    return rows[near], distance[near]
        raise AssertionError("all radii cover all codes")


def top_k(
    df: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    shard_codes: int = 65_536,
) -> DataFrame:
    """The k nearest rows of df for each row of queries, itself included if it is in df: query_id, id_col's neighbour_id, distance, rank from 1.

    Ties in distance go to the smaller id. A null vector has no code: it is neither found nor searched for;
    vectors shorter than the longest of both tables are filled with zeros. Null ids sort first. Rows that repeat an id are rows of
    their own. With fewer than k rows all are returned. Empty tables give an empty result. Only the id and the vector are read.

    Every shard answers exactly, whatever its size; shard_codes only sets how many there are.
    """
    longest = F.max(F.size(vector_col))
    words = max(1, *(-(-(t.agg(longest).first()[0] or 0) // BITS) for t in (df, queries)))
    coded = df.select(F.col(id_col).alias("id"), code_of(vector_col, words).alias("code")).filter("code IS NOT NULL")
    asked = queries.select(F.col(id_col).alias("query_id"), code_of(vector_col, words).alias("code")).filter("code IS NOT NULL")
    # Spark keeps k rows of a code in each task before the shuffle.
    best = coded.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("n") <= k)
    index = scratch_table(best.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("place", F.monotonically_increasing_id()), "codes")
    # Equal query codes are searched once.
    distinct = scratch_table(asked.select("code").distinct().withColumn("q", F.monotonically_increasing_id()), "query-codes")
    n, wanted = index.count(), distinct.count()
    shards = max(1, -(-n // shard_codes))
    # Blocks of queries as large as shards; smaller ones, of 256 at least, where there would be fewer tasks than cores.
    cores = df.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(-(-wanted // 256), max(-(-wanted // shard_codes), -(-cores // shards))))
    pairs = lambda own, step, others, stride: F.explode(F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda o: own * step + o * stride)).alias("pair")
    block_of, shard_of = F.pmod(F.xxhash64("code"), F.lit(blocks)), F.pmod(F.xxhash64("code"), F.lit(shards))
    asks = distinct.select("q", _packed("code").alias("bits"), pairs(block_of, shards, shards, 1))
    holds = index.select("place", _packed("code").alias("bits"), pairs(shard_of, 1, blocks, shards))

    def run(codes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(queries):
            return pd.DataFrame({"q": [], "place": [], "distance": []}).astype({"q": "int64", "place": "int64", "distance": "int32"})
        table = SegmentIndex(_codes(codes["bits"]))
        found = [table.search(q, k) for q in _codes(queries["bits"])]
        rows = np.concatenate([r for r, _ in found])
        return pd.DataFrame({"q": np.repeat(queries["q"].to_numpy(), [len(r) for r, _ in found]), "place": codes["place"].to_numpy()[rows], "distance": np.concatenate([x for _, x in found]).astype(np.int32)})

    # As many partitions as pairs: they are small to move but long to search, so Spark mustn't put them together by size.
    holds, asks = holds.repartition(shards * blocks, "pair"), asks.repartition(shards * blocks, "pair")
    near = holds.groupBy("pair").cogroup(asks.groupBy("pair")).applyInPandas(run, "q long, place long, distance int")
    ids = near.join(index.select("place", "ids"), "place").select("q", "distance", F.explode("ids").alias("id"))
    ranked = ids.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))).filter(F.col("rank") <= k)
    return asked.join(distinct, "code").join(ranked, "q").select("query_id", F.col("id").alias("neighbour_id"), "distance", "rank")

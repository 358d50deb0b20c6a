"""Vector search: exact inner-product top-k in blocks, thresholds, re-ranking of own candidates, encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions import text as T


def normalised_keys(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The index: (key, embedding) with unit vectors; write it as Parquet to keep it."""
    return df.select(F.col(key).alias("key"), T.unit(vector).alias("embedding"))


def encode(df: DataFrame, c: str, encoder: Callable[[list[str]], np.ndarray], batch: int = 64, out: str = "embedding") -> DataFrame:
    """Add vectors of a text column by any encoder from a list of texts to an array, in batches."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            rows = [v for lo in range(0, len(texts), batch) for v in np.asarray(encoder(texts.iloc[lo : lo + batch].fillna("").tolist()), float).tolist()]
            yield pd.Series(rows)

    return df.withColumn(out, run(F.col(c)))


def search(queries: DataFrame, keys: DataFrame, query_key: str, key: str, vector: str, k: int = 5, threshold: float | None = None, block: int = 8192) -> DataFrame:
    """(query_key, key, score, rank): each query's k best keys by inner product, at least `threshold` if given; ties by key.

    Exact search: work is queries times keys. Keys are dealt to blocks; a set of queries meets every block, one matrix product each, and
    only the k best of a block go on. Scores are rounded to nine decimals, so the order doesn't depend on how sums were made.
    """
    n = max(1, -(-keys.count() // block))
    k_rows = keys.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).alias("b"))
    q_rows = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("b"))
    kinds = queries.schema[query_key].dataType.simpleString(), keys.schema[key].dataType.simpleString()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            names, right = a["k"].to_numpy(), np.array(a["v"].tolist(), float)
            order = np.argsort(names, kind="stable")
            names, right = names[order], right[order]
            for lo in range(0, len(b), 1024):
                part = b.iloc[lo : lo + 1024]
                scores = np.round(np.array(part["v"].tolist(), float) @ right.T, 9)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"q": np.repeat(part["q"].to_numpy(), best.shape[1]), "k": names[best].ravel(), "score": np.take_along_axis(scores, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "k": [], "score": []})

    found = k_rows.groupBy("b").cogroup(q_rows.groupBy("b")).applyInPandas(run, f"q {kinds[0]}, k {kinds[1]}, score double")
    if threshold is not None:
        found = found.filter(F.col("score") >= threshold)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "k"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("k").alias(key) if key != query_key else F.col("k").alias(f"found_{key}"), "score", "rank")


def retrieve_from_files(spark: SparkSession, queries: str, keys: str, k: int = 5, threshold: float | None = None, pool_size: int | None = None) -> DataFrame:
    """(query_id, key, score, rank) of saved (key, embedding) tables. pool_size: search only the first keys in order, as a caller may ask for."""
    pool = spark.read.parquet(keys)
    if pool_size is not None:
        pool = pool.orderBy("key").limit(pool_size)
    return search(spark.read.parquet(queries).withColumnRenamed("key", "query_id"), pool, "query_id", "key", "embedding", k, threshold)


def rerank(candidates: DataFrame, query: str, index: str, query_vector: str, candidate_vector: str, n: int = 3) -> DataFrame:
    """Each query's own candidates by inner product: the n best, ties by candidate index. Native."""
    scored = candidates.withColumn("score", F.round(T.dot(query_vector, candidate_vector), 9))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), index))).filter(F.col("rank") <= n)


def filter_signatures(candidates: DataFrame, query: str, index: str, source: str, query_vector: str, candidate_vector: str, n: int = 3) -> DataFrame:
    """Candidates cut to their signatures and re-ranked."""
    return rerank(candidates.withColumn("signature", T.signature(source)), query, index, query_vector, candidate_vector, n)


def cosine(df: DataFrame, a: str, b: str, out: str = "side") -> DataFrame:
    """SIDE's score for given summary and code vectors."""
    return df.withColumn(out, T.dot(T.unit(a), T.unit(b)))

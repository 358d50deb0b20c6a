"""Denoising of candidate snippets: the decision table over two stages' labels, and its totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import text as T

STRONG, BACKUP, UNCERTAIN, JUNK = "strong", "backup", "uncertain", "junk"


def decide(is_junk: Column, features: Column, source_match: Column, domain_match: Column) -> Column:
    """First-stage junk goes; without grounded features all others are uncertain; else a source match is strong, a domain match backup, the rest junk. Null labels count as no."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(is_junk), JUNK).when(F.coalesce(F.size(features), F.lit(0)) <= 0, UNCERTAIN).when(yes(source_match), STRONG).when(yes(domain_match), BACKUP).otherwise(JUNK)


def denoise(candidates: DataFrame, code: DataFrame, second: DataFrame, fn: str = "fn_id") -> DataFrame:
    """Add `tag` to (fn, idx, is_junk) rows. code: (fn, code). second: (fn, features, results: array of (index, is_source_match, is_domain_match)); a candidate without a result has neither match."""
    stage = second.join(code, fn).select(fn, T.grounded("features", "code").alias("features"), F.explode_outer("results").alias("r"))
    labels = stage.filter("r IS NOT NULL").select(fn, F.col("r.index").alias("idx"), F.col("r.is_source_match").alias("source_match"), F.col("r.is_domain_match").alias("domain_match"))
    features = stage.groupBy(fn).agg(F.max("features").alias("features"))
    return candidates.join(labels, [fn, "idx"], "left").join(features, fn, "left").withColumn("tag", decide(F.col("is_junk"), F.col("features"), F.col("source_match"), F.col("domain_match")))


def buckets(tagged: DataFrame, fn: str = "fn_id", fragment: str = "fragment") -> DataFrame:
    """One row a function: its fragments by tag, in order."""
    of = lambda t: F.transform(F.sort_array(F.collect_list(F.when(F.col("tag") == t, F.struct("idx", fragment)))), lambda s: s[fragment]).alias(f"filter_{t}")
    return tagged.groupBy(fn).agg(of(STRONG), of(BACKUP), of(UNCERTAIN))


def totals(tagged: DataFrame) -> DataFrame:
    """Counts by tag and in all; they add up by construction, which `checks` states."""
    count = lambda t: F.count_if(F.col("tag") == t).alias(f"n_{t}")
    out = tagged.agg(count(STRONG), count(BACKUP), count(UNCERTAIN), count(JUNK), F.count(F.lit(1)).alias("n_total"))
    return out.withColumn("checks", F.col("n_strong") + F.col("n_backup") + F.col("n_uncertain") + F.col("n_junk") == F.col("n_total"))


def averages(bucketed: DataFrame) -> DataFrame:
    """Mean number of fragments of each tag in a function's row; null buckets count as empty."""
    mean = lambda t: F.avg(F.coalesce(F.array_size(f"filter_{t}"), F.lit(0))).alias(f"avg_{t}")
    return bucketed.agg(mean(STRONG), mean(BACKUP), mean(UNCERTAIN))


def mean_candidates(df: DataFrame, candidates: str) -> DataFrame:
    """(mean_candidates): all candidates over all rows, whole number; 0 without rows."""
    n = F.count(F.lit(1))
    return df.agg(F.when(n > 0, F.floor(F.sum(F.coalesce(F.array_size(candidates), F.lit(0))) / n)).otherwise(0).cast("long").alias("mean_candidates"))


def complete_labels(results: str | Column, n: Column) -> Column:
    """Indices from 0 to n - 1 that a reply has left out."""
    have = F.transform(F.col(results) if isinstance(results, str) else results, lambda r: r["index"].cast("int"))
    return F.array_except(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), have)

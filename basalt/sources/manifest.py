"""Cached results that follow their input: what is new or has changed is computed again, what is gone goes.

A store is a folder of versions. Version n has `results/version=n`, what was computed then, and `manifest/version=n`, the entries that
changed then: an entry (the key's hash), the row's hash, and whether it was deleted. A manifest is written after its results, so a run that ends in between
leaves a version that nobody sees, and that the next run writes over. A refresh reads the manifest (two hashes a row) and writes changes only; `compact` puts all versions into one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.sources.shared import kept

_MANIFEST = "entry string, row_hash string, deleted boolean, version long"


def _hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """(entry, row_hash, version) of what is in the store now: the last word on each entry, unless it was deleted."""
    if not _exists(spark, f"{store}/manifest"):
        return spark.createDataFrame([], _MANIFEST).drop("deleted")
    words = spark.read.schema(_MANIFEST).parquet(f"{store}/manifest")
    last = words.groupBy("entry").agg(F.max(F.struct("version", "deleted", "row_hash")).alias("last"))
    return last.filter("NOT last.deleted").select("entry", "last.row_hash", "last.version")


def _versions(spark: SparkSession, store: str) -> list[int]:
    """Committed versions. A folder listing: one name a version."""
    if not _exists(spark, f"{store}/manifest"):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    names = [f.getPath().getName() for f in found if _exists(spark, f"{store}/manifest/{f.getPath().getName()}/_SUCCESS")]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def changes(current: DataFrame, store: str, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of current with entry, row_hash and state (new, changed, same), and for what is gone a row with state deleted and null columns. columns: what a change is looked for in; all if not given.

    Of rows that repeat a key the one with the least hash counts. Nulls in keys and columns are values like others; no row is lost for them.
    """
    watched = list(columns or current.columns)
    hashed = current.withColumn("entry", _hash(key)).withColumn("row_hash", _hash(watched))
    one = hashed.groupBy("entry").agg(F.min_by(F.struct(*hashed.columns), F.struct("row_hash", F.to_json(F.struct(*current.columns)))).alias("row")).select("row.*")
    known = manifest(current.sparkSession, store).select(F.col("entry").alias("known_entry"), F.col("row_hash").alias("known_hash"))
    both = one.join(known, F.col("entry") == F.col("known_entry"), "full")
    state = F.when(F.col("entry").isNull(), "deleted").when(F.col("known_entry").isNull(), "new").when(F.col("row_hash") != F.col("known_hash"), "changed").otherwise("same")
    return both.select(*current.columns, F.coalesce("entry", "known_entry").alias("entry"), F.coalesce("row_hash", "known_hash").alias("row_hash"), state.alias("state"))


def refresh(current: DataFrame, store: str, key: Sequence[str], compute: Callable[[DataFrame], DataFrame], columns: Sequence[str] | None = None) -> int:
    """Bring a store up to date with current, and give its version. compute: from rows with an `entry` column to results with it; it gets new and changed rows only, once. Without a change nothing is written."""
    spark = current.sparkSession
    done = _versions(spark, store)
    found = kept(changes(current, store, key, columns).filter("state <> 'same'"))
    if found.isEmpty():
        return done[-1] if done else 0
    version = (done[-1] if done else 0) + 1
    todo = found.filter("state IN ('new', 'changed')").drop("row_hash", "state")
    compute(todo).write.mode("overwrite").parquet(f"{store}/results/version={version}")
    entries = found.select("entry", "row_hash", (F.col("state") == "deleted").alias("deleted"))
    entries.write.mode("overwrite").parquet(f"{store}/manifest/version={version}")
    return version


def results(spark: SparkSession, store: str) -> DataFrame:
    """The store's results as they are now: entry, the computed columns, and the version that computed them. A store without a committed version is an error, as it has no columns."""
    if not _versions(spark, store):
        raise AnalysisException(f"no version in {store}")
    now = manifest(spark, store).select("entry", "version")
    return spark.read.parquet(f"{store}/results").join(now, ["entry", "version"])


def compact(spark: SparkSession, store: str, target: str) -> None:
    """All that is in the store now as version 1 of a new one."""
    now = manifest(spark, store)
    results(spark, store).drop("version").write.mode("overwrite").parquet(f"{target}/results/version=1")
    now.select("entry", "row_hash", F.lit(False).alias("deleted")).write.mode("overwrite").parquet(f"{target}/manifest/version=1")

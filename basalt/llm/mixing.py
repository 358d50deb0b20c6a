"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: a line from
(1 + s) w to (1 - s) w, whose integral is its weight w. Targets are the shares of
the token budget by integrated weight, filled like water under each source's cap
(max_epochs times its size). The cumulative demand of a source,
D(t) = target * (integral of its schedule up to t) / w, is inverted in closed
form: the copy of a document that starts at word c of its source's stream is
trained on at the t where D(t) = c. Documents are then range-sorted by t.

A source's stream order is that of a hash of each document, which doesn't depend on
how the input is partitioned. Offsets in the stream are prefix sums in two
levels, over 4096 hash buckets of each source and inside (source, bucket), so that a
source with a third of all rows is spread over 4096 groups.

Everything is DataFrame code inside the JVM. The list of sources has one row for
each source, ranked in one window (one task for all sources: some tens of millions at most); nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import SPACE, WORD, scratch_table, text_or_empty

_P = "__mx_"


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], slopes: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """sizes: (key, source_size). Adds weight, slope and target. Keys are ranked by code point and get weights and slopes in turn."""
    turn = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), (F.col("rank") % len(xs) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("key")) - 1)
    ranked = ranked.withColumn("weight", turn(weights)).withColumn("slope", turn(slopes)).withColumn("cap", F.col("source_size") * float(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    whole = Window.partitionBy()
    filled = (
        ranked.withColumn("budget", F.sum("source_size").over(whole) * float(share))
        .withColumn("level", (F.col("budget") - F.sum("cap").over(order) + F.col("cap")) / (F.sum("weight").over(whole) - F.sum("weight").over(order) + F.col("weight")))
        .withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "key", "level"))).over(whole)["level"])
    )
    return filled.select("key", "source_size", "weight", "slope", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def curriculum_time(words: Column, target: Column, slope: Column) -> Column:
    """The t in [0, 1] by which a source is asked for so many of its words: D(t) = target ((1 + s) t - s t^2) inverted."""
    q = F.least(F.greatest(words / target, F.lit(0.0)), F.lit(1.0))
    a = slope + 1
    return 2 * q / (a + F.sqrt(F.greatest(a * a - 4 * slope * q, F.lit(0.0))))


def plan_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (5, 2, 1),
    slopes: Sequence[float] = (0.25, 0.0, -0.25),
    share: float = 1.5,
    max_epochs: float = 2.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: its id, size (words), source_size, target (its source's), taken (words, repeats counted), and what places it in training: start, epochs, partial, slope.

    A source gives `epochs` whole passes over its documents and the first
    words of one more, so its taken words equal its rounded target; the document at
    the end is cut. Null text has size 0; null source is a source of its own, ranked last; a source
    without words has target 0. Rows that share an id are separate documents;
    rows equal in id and text tie, and as they are alike the result is the same whichever
    comes first. An empty input gives an empty result. `carry` names input columns to keep; other columns are never read.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    mark = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("#"), F.md5(text_or_empty(text_col))))
    docs = df.select(
        F.col(id_col).alias(f"{_P}id"), key.alias("key"), mark.alias(f"{_P}mark"), word_count(text_col).alias("size"), *(F.col(c).alias(f"{_P}c_{c}") for c in carry)
    ).withColumn("bucket", F.substring(f"{_P}mark", 1, 3))
    # Words are counted once: what follows reads the narrow rows. Carried columns come from one more pass over the input.
    narrow = scratch_table(docs.drop(*(f"{_P}c_{c}" for c in carry)), "mixing")
    if not carry:
        docs = narrow

    buckets = narrow.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    sources = source_targets(buckets.groupBy("key").agg(F.sum("words").alias("source_size")), weights, slopes, share, max_epochs)
    before = F.sum("words").over(Window.partitionBy("key").orderBy("bucket")) - F.col("words")
    buckets = buckets.select("key", "bucket", before.alias("before")).join(sources, "key")

    inside = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy(f"{_P}mark", f"{_P}id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    goal = F.round("target").cast("long")
    out = docs.withColumn("inside", inside).join(buckets, ["key", "bucket"])
    out = out.withColumn("start", F.col("before") + F.col("inside")).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("partial", F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("epochs") * F.col("source_size") - F.col("start"))).cast("long"))
    out = out.withColumn("taken", F.col("size") * F.col("epochs") + F.col("partial"))
    return out.select(F.col(f"{_P}id").alias(id_col), "size", "source_size", "target", "taken", "start", "epochs", "partial", "slope", f"{_P}mark", *(F.col(f"{_P}c_{c}").alias(f"{_P}c_{c}") for c in carry))


def first_time(plan: DataFrame) -> Column:
    """When a planned document is first trained on; null if never."""
    return F.when(F.col("taken") > 0, curriculum_time(F.col("start").cast("double"), F.col("target"), F.col("slope")))


def ordered_plan(plan: DataFrame) -> DataFrame:
    """The plan range-sorted by first training time, documents that aren't taken last; the hash order breaks ties and spreads nulls."""
    timed = plan.withColumn("position", first_time(plan))
    order = [F.coalesce("position", F.lit(2.0)), F.col(f"{_P}mark")]
    return timed.repartitionByRange(*order).sortWithinPartitions(*order).drop(f"{_P}mark")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its nth word."""
    parts = F.split(text, rf"(?<=[^\x20\x09-\x0D])(?={SPACE})")
    return F.when(n <= 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(n, F.lit(1)).cast("int")), ""))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The training stream: the input's columns, a row for each copy of a document, range-sorted by training position (added as `mix_position`).

    Whole passes repeat documents; the document at the end of a source's last pass has its text cut after the words that are taken. Documents without words are in no stream.
    """
    plan = plan_mix(df, id_col, source_col, text_col, carry=df.columns, **how)
    copies = plan.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("epochs") - F.when(F.col("partial") > 0, 0).otherwise(1))))
    words = F.when(F.col("copy") < F.col("epochs"), F.col("size")).otherwise(F.col("partial"))
    at = curriculum_time((F.col("copy") * F.col("source_size") + F.col("start")).cast("double"), F.col("target"), F.col("slope"))
    text = F.col(f"{_P}c_{text_col}")
    shown = {c: F.col(f"{_P}c_{c}") for c in df.columns} | {text_col: F.when(words < F.col("size"), first_words(text, words)).otherwise(text)}
    stream = copies.select(*(v.alias(c) for c, v in shown.items() if c != "mix_position"), at.alias("mix_position"), F.col(f"{_P}mark"), F.col("copy").alias(f"{_P}copy"))
    order = [F.col("mix_position"), F.col(f"{_P}mark"), F.col(f"{_P}copy")]
    return stream.repartitionByRange(*order).sortWithinPartitions(*order).drop(f"{_P}mark", f"{_P}copy")

"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Three passes over the input, each of them a map with a small aggregate behind
it; only rows that collided in one pass are looked at more closely in the next:

1. byte lengths that two or more rows have;
2. (length, hash of the first characters) pairs that two or more of those rows have;
3. SHA-256 of the whole text, for the rows that are still left, and groups by it.

What one pass hands to the next is a collision sketch: one bit for each of
2**bits hash slots, sixteen to a row of the input, at most 2**27 slots: 16 MB, so that broadcasting it is
safe whatever the input. A slot that two
different keys share only sends rows on to the next pass: no copy is missed,
and the last pass compares SHA-256. Up to some 10**8 rows few rows are sent on in vain; beyond, ever more are
hashed in full, which costs time, but neither memory nor results.

The third pass writes narrow rows (id, place, hash, carried expressions), from which groups are made: no text is shuffled but
the columns that the caller asks to carry.

Everything is DataFrame code inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import ascii_lower, own_key, scratch_table, text_or_empty

_P = "__xd_"


def normalised(text: str | Column) -> Column:
    """The form in which texts are compared: null as empty, A-Z lower-cased."""
    return ascii_lower(text_or_empty(text))


#: Slots of a sketch, as powers of two, and the 64-bit words in one of its rows.
LEAST_BITS, MOST_BITS, CHUNK = 16, 27, 1024


def sketch_bits(rows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, rows))) + 4))


def _collisions(slots: DataFrame, bits: int) -> DataFrame:
    """(chunk, words) of the slots that hold two rows or more: all bits of the sketch, in rows of CHUNK words."""
    slot = F.col(f"{_P}slot")
    words = (
        slots.groupBy(f"{_P}slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .groupBy(F.shiftright(slot, 6).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits"))
    )
    every = slots.sparkSession.range(0, max(1, (1 << bits) // 64), 1, max(1, (1 << bits) // 64 // 65536)).withColumnRenamed("id", "word")
    dense = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    chunks = dense.groupBy(F.floor(F.col("word") / CHUNK).alias(f"{_P}chunk")).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("own"))
    return chunks.select(f"{_P}chunk", F.transform("own", lambda x: x["bits"]).alias(f"{_P}words"))


def _collided(df: DataFrame, key: Column, sketch: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add a boolean: whether the key's slot is in the sketch."""
    slot = F.col(f"{_P}slot")
    out = df.withColumn(f"{_P}slot", _slot(key, bits)).withColumn(f"{_P}chunk", F.shiftright(slot, 6 + CHUNK.bit_length() - 1))
    out = out.join(F.broadcast(sketch), f"{_P}chunk", "left")
    word = F.get(f"{_P}words", F.shiftright(slot, 6).bitwiseAND(CHUNK - 1).cast("int"))
    hit = F.coalesce(F.getbit(word, slot.bitwiseAND(63).cast("int")), F.lit(0)) == 1
    return out.withColumn(flag, hit).drop(f"{_P}slot", f"{_P}chunk", f"{_P}words")


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(1 << bits))


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, prefix_chars: int = 256, bits: int | None = None) -> DataFrame:
    """One row per input row: its id, place in the input, carried expressions, keep_id, group_size and kept, all behind a prefix; see exact_dedup and distinct_texts."""
    bits = sketch_bits(df.count()) if bits is None else bits
    text = text_or_empty(text_col)
    length = F.octet_length(text).cast("long")
    length_key = F.xxhash64(length)
    prefix_key = F.xxhash64(length, normalised(F.substring(text, 1, prefix_chars)))

    lengths = _collisions(df.select(_slot(length_key, bits).alias(f"{_P}slot")), bits)
    second = _collided(df.select(F.col(text_col)), length_key, lengths, bits, f"{_P}same_length").filter(f"{_P}same_length")
    prefixes = _collisions(second.select(_slot(prefix_key, bits).alias(f"{_P}slot")), bits)

    rows = df.select(F.col(id_col).alias(f"{_P}id"), F.monotonically_increasing_id().alias(f"{_P}row"), text.alias(f"{_P}text"), *(v.alias(f"{_P}c_{k}") for k, v in (carry or {}).items()))
    text = F.col(f"{_P}text")
    rows = _collided(rows, F.xxhash64(F.octet_length(text).cast("long"), normalised(F.substring(text, 1, prefix_chars))), prefixes, bits, f"{_P}open")
    # A slot holds every row of its key, so a row of a slot without collision is alone: its text isn't hashed.
    rows = scratch_table(rows.withColumn(f"{_P}full", F.when(F.col(f"{_P}open"), F.unhex(F.sha2(normalised(text), 256)))).drop(f"{_P}text", f"{_P}open"), "exact-dedup")

    alone = rows.filter(f"{_P}full IS NULL").drop(f"{_P}full").select("*", F.col(f"{_P}id").alias(f"{_P}keep_id"), F.lit(1).cast("long").alias(f"{_P}group_size"), F.lit(True).alias(f"{_P}kept"))
    survivors = rows.filter(f"{_P}full IS NOT NULL")
    groups = (
        survivors.groupBy(f"{_P}full")
        .agg(F.count(F.lit(1)).alias(f"{_P}group_size"), F.max(F.struct(f"{_P}id", f"{_P}row")).alias(f"{_P}keep"))
        # A key of its own makes both sides of the join below fresh exchanges: then Spark can split the partition of a large group of copies.
        .select(own_key(f"{_P}full").alias(f"{_P}key"), f"{_P}group_size", F.col(f"{_P}keep.{_P}id").alias(f"{_P}keep_id"), F.col(f"{_P}keep.{_P}row").alias(f"{_P}keep_row"))
    )
    grouped = survivors.withColumn(f"{_P}key", own_key(f"{_P}full")).join(groups, f"{_P}key").withColumn(f"{_P}kept", F.col(f"{_P}row") == F.col(f"{_P}keep_row"))
    return alone.unionByName(grouped.drop(f"{_P}full", f"{_P}key", f"{_P}keep_row"))


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict[str, Column] | None = None,
    prefix_chars: int = 256,
    bits: int | None = None,
) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, and `carry` (name: expression over the input's columns).

    Texts are equal when identical after lower-casing A-Z; a null text counts
    as empty, so that null and empty texts form one group. Of equal texts the row with
    the largest id stays; null ids sort below all others. Rows that repeat both
    id and text are one group of which the last in the input stays, exactly one. An empty input gives
    an empty result. Only the id, the text and carried expressions are read, so
    that other columns may have any name; the output's own names
    (keep_id, group_size, kept) win over carried ones. `bits` sizes the sketches, by the number of rows if it isn't given.

    """
    carry = {k: v for k, v in (carry or {}).items() if k not in (id_col, "keep_id", "group_size", "kept")}
    made = decisions(df, id_col, text_col, carry, prefix_chars, bits)
    return made.select(F.col(f"{_P}id").alias(id_col), *(F.col(f"{_P}{c}").alias(c) for c in ("keep_id", "group_size", "kept")), *(F.col(f"{_P}c_{k}").alias(k) for k in carry))


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000, **how) -> DataFrame:
    """The rows of df that exact_dedup keeps, all columns as they were. The input must be read in the same order each time, as from files.

    Only the places of rows that go are joined with the input: broadcast up to `broadcast_rows` of them (8 bytes each), shuffled beyond.
    """
    mark = f"{_P}row"
    goes = scratch_table(decisions(df, id_col, text_col, **how).filter(~F.col(f"{_P}kept")).select(mark), "exact-dedup-goes")
    placed = df.withColumn(mark, F.monotonically_increasing_id())
    few = goes.count() <= broadcast_rows
    return placed.join(F.broadcast(goes) if few else goes, mark, "left_anti").select(*df.columns)

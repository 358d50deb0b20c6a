"""METEOR with exact, stem, synonym and paraphrase matches.

Synonyms and paraphrases are tables: what a sample needs of them comes to its row by joins on words and on runs of words, so that the tables
may be of any size. In the row, an alignment is searched: matches that share no word, covering most words, then with fewest chunks, then with least distance between
starts. The search goes along the hypothesis and keeps the `beam` best partial alignments. It gives counts, from which the scores of samples and of
a corpus are native expressions.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import text as T
from basalt.functions.stems import stem
from basalt.sources.shared import kept

#: Weights of the matches' kinds, of precision against recall, of fragmentation, and of content words against function words. Fixed values.
EXACT, STEM, SYNONYM, PARAPHRASE = range(4)
WEIGHTS = (1.0, 0.6, 0.8, 0.6)
ALPHA, BETA, GAMMA, DELTA = 0.85, 0.2, 0.6, 0.75
#: Words of a paraphrase at most.
PHRASE = 4
#: Bits of the bitmap of paraphrases, as a power of two.
MOST_BITS = 27
SIDES = ("hypothesis", "reference")


def tokens(c: str | Column) -> Column:
    """Words (with what an apostrophe joins to them) and single signs, in lower case."""
    return F.regexp_extract_all(F.lower(T.meteor_clean(c)), F.lit(r"((?U)\w+(?:'\w+)*|[^\w\s])"), F.lit(1))


class Match(NamedTuple):
    h: int
    h_len: int
    r: int
    r_len: int
    kind: int


KINDS = (EXACT, STEM, SYNONYM, PARAPHRASE)


def matches(h: Sequence[str], r: Sequence[str], classes: dict[str, Sequence[str]], phrases: dict[str, Sequence[str]], kinds: Sequence[int] = KINDS) -> list[list[Match]]:
    """The matches that start at each word of the hypothesis; of several kinds between the same words the first counts. classes: of a word; phrases: of a run of words, those that say the same."""
    found: list[dict] = [{} for _ in h]
    for kind, of in ((EXACT, lambda w: (w,)), (STEM, lambda w: (stem(w),)), (SYNONYM, lambda w: classes.get(w) or ())):
        if kind not in kinds:
            continue
        at = defaultdict(list)
        for j, w in enumerate(r):
            for c in of(w):
                at[c].append(j)
        for i, w in enumerate(h):
            for c in of(w):
                for j in at.get(c, ()):
                    found[i].setdefault((1, j, 1), kind)
    if phrases and PARAPHRASE in kinds:
        runs = defaultdict(list)
        for n in range(1, PHRASE + 1):
            for j in range(len(r) - n + 1):
                runs[" ".join(r[j : j + n])].append((j, n))
        for i in range(len(h)):
            for n in range(1, min(PHRASE, len(h) - i) + 1):
                for other in phrases.get(" ".join(h[i : i + n]), ()):
                    for j, m in runs.get(other, ()):
                        found[i].setdefault((n, j, m), PARAPHRASE)
    return [[Match(i, n, j, m, kind) for (n, j, m), kind in sorted(x.items())] for i, x in enumerate(found)]


def align(starting: list[list[Match]], beam: int = 40) -> tuple[list[Match], int]:
    """(matches, chunks) of the best alignment found: most words covered on both sides, then fewest chunks, then least distance between starts, then the first in order."""
    n = len(starting)
    # Partial alignments by the place they have come to: value (smaller is better), words of the reference that are taken, end of the last match on both sides, matches.
    at: list[dict] = [{} for _ in range(n + 1)]
    at[0][0, -1] = ((0, 0, 0, ()), -1)
    for i in range(n):
        states = heapq.nsmallest(beam, ((value, key, end) for key, (value, end) in at[i].items()))
        at[i] = {}
        for (covered, chunks, distance, taken), (mask, last), end in states:
            ways = [(i + 1, covered, chunks, distance, taken, mask, last, end)]
            for m in starting[i]:
                own = (1 << m.r_len) - 1 << m.r
                if not mask & own:
                    more = not (end == i and last == m.r)
                    ways.append((i + m.h_len, covered - m.h_len - m.r_len, chunks + more, distance + abs(m.h - m.r), (*taken, m), mask | own, m.r + m.r_len, i + m.h_len))
            for to, c, k, d, t, mk, la, en in ways:
                # What a later match may go on from matters only if it ends here.
                key = (mk, la if en == to else -1)
                value = (c, k, d, t)
                if key not in at[to] or value < at[to][key][0]:
                    at[to][key] = (value, en)
    value, _ = min(at[n].values())
    return list(value[3]), value[1]


COUNTS = [f"{side}_{what}" for side in SIDES for what in ("content", "function", *(f"{kind}_{k}" for kind in ("content", "function") for k in range(len(WEIGHTS))))] + ["chunks"]


def count(h: Sequence[str], r: Sequence[str], classes: dict, phrases: dict, function_words: frozenset[str], beam: int, kinds: Sequence[int] = KINDS) -> list[int]:
    """The counts of a sample, in the order of COUNTS: content and function words of each side, those matched by each kind, and chunks."""
    found, chunks = align(matches(h, r, classes, phrases, kinds), beam)
    out = []
    for words, start, length in ((h, "h", "h_len"), (r, "r", "r_len")):
        is_function = [w in function_words for w in words]
        matched = [[0] * len(WEIGHTS), [0] * len(WEIGHTS)]
        for m in found:
            for k in range(getattr(m, start), getattr(m, start) + getattr(m, length)):
                matched[is_function[k]][m.kind] += 1
        out += [len(words) - sum(is_function), sum(is_function), *matched[0], *matched[1]]
    return [*out, chunks]


def _needed(pairs: DataFrame, key: str, side: str, sizes: Sequence[int], table: DataFrame, name: str) -> DataFrame:
    """(key, name): a map from those runs of a sample's words that the table (run, value) has to their values."""
    runs = F.flatten(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.transform(F.when(F.size(side) >= n, F.sequence(F.lit(1), F.size(side) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(side, i, n), " "))))
    asked = pairs.select(key, F.explode(F.array_distinct(runs)).alias("run"))
    # Only what meets the table goes on to the samples.
    return _mapped(asked.join(table, "run"), key, name)


def _mapped(found: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): a map from each run of (key, run, value) to its values. One shuffle, by sample."""
    return found.repartition(key).groupBy(key, "run").agg(F.sort_array(F.collect_set("value")).alias("values")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("run", "values"))).alias(name))


def _said(rows: DataFrame, key: str, table: DataFrame, name: str) -> DataFrame:
    """(key, name): as `_needed`, of a table (run, value) only what has its run in the sample's hypothesis and its value in its reference, as a frequent run may have as many values as there are samples.

    A bitmap of the table's hashes, of MOST_BITS bits at most (16 MB broadcast), tells which pairs of runs may be there; those are joined with the table. A larger table fills it more: more pairs are joined, none is lost.
    """
    spark = rows.sparkSession
    table = kept(table.distinct())
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(32 * max(1, table.count())))))
    words = lambda c: F.size(F.split(c, " "))
    sizes = [tuple(x) for x in table.select(words("run"), words("value")).distinct().filter(F.greatest(words("run"), words("value")) <= PHRASE).collect()]
    run_hash, value_hash = F.xxhash64("run"), F.shiftleft(F.xxhash64("value"), 1)
    places = lambda h: (h.bitwiseAND((1 << bits) - 1), F.shiftrightunsigned(h, 32).bitwiseAND((1 << bits) - 1))
    at = table.select(F.explode(F.array(*(p for h in (run_hash, value_hash, run_hash.bitwiseXOR(value_hash)) for p in places(h)))).alias("at"))
    parts = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    filled = np.zeros(1 << bits - 6, np.uint64)
    filled[parts["word"].to_numpy()] = parts["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(filled)

    def may_be(h: np.ndarray) -> np.ndarray:
        hit = np.ones(h.shape, bool)
        for p in (h & np.uint64((1 << bits) - 1), h >> np.uint64(32) & np.uint64((1 << bits) - 1)):
            hit &= (shared.value[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return hit

    def runs_of(tokens_of: Sequence[str], n: int, shift: int) -> tuple[list[str], np.ndarray]:
        runs = list({" ".join(tokens_of[i : i + n]) for i in range(len(tokens_of) - n + 1)})
        hashes = np.array([xxhash.xxh64_intdigest(r.encode(), 42) for r in runs], np.uint64) << np.uint64(shift)
        near = np.flatnonzero(may_be(hashes))
        return [runs[k] for k in near], hashes[near]

    def pairs_of(h: Sequence[str], r: Sequence[str]) -> list[dict]:
        left, right = {n: runs_of(h, n, 0) for n in {a for a, _ in sizes}}, {n: runs_of(r, n, 1) for n in {b for _, b in sizes}}
        found = []
        for a, b in sizes:
            (xs, x), (ys, y) = left[a], right[b]
            found += [{"run": xs[i], "value": ys[j]} for i, j in zip(*np.nonzero(may_be(x[:, None] ^ y[None])), strict=True)]
        return found

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hs, rs in batches:
            yield pd.Series([pairs_of(h, r) for h, r in zip(hs, rs, strict=True)])

    asked = rows.select(key, F.inline(F.pandas_udf(run, "array<struct<run:string,value:string>>")("hypothesis", "reference")))
    return _mapped(asked.join(table, ["run", "value"]), key, name)


def meteor_counts(pairs: DataFrame, key: str, hypothesis: str, reference: str, synonyms: DataFrame | None = None, paraphrases: DataFrame | None = None, function_words: Sequence[str] = (), beam: int = 40, kinds: Sequence[int] = KINDS) -> DataFrame:
    """(key, COUNTS) of each sample, by matches of the given kinds. synonyms: (word, class); two words match if they have a class in common. paraphrases: (a, b) runs of up to PHRASE words, of the hypothesis and of the reference.

    Keys: distinct, none null. Null texts are empty. function_words: a short list, such as the most frequent words of a language. Nulls in the tables match nothing.
    """
    rows = pairs.select(key, tokens(hypothesis).alias("hypothesis"), tokens(reference).alias("reference"))
    # Texts are shorter than their lists of words: these are made anew behind the joins.
    whole = pairs.select(key, F.col(hypothesis).alias("hypothesis"), F.col(reference).alias("reference"))
    if synonyms is not None:
        table = synonyms.select(F.lower("word").alias("run"), F.col("class").cast("string").alias("value")).dropna()
        both = rows.select(key, F.concat("hypothesis", "reference").alias("both"))
        whole = whole.join(_needed(both, key, "both", [1], table, "classes"), key, "left")
    else:
        whole = whole.withColumn("classes", F.lit(None).cast("map<string,array<string>>"))
    if paraphrases is not None:
        table = paraphrases.select(F.lower("a").alias("run"), F.lower("b").alias("value")).dropna()
        whole = whole.join(_said(rows, key, table, "phrases"), key, "left")
    else:
        whole = whole.withColumn("phrases", F.lit(None).cast("map<string,array<string>>"))
    rows = whole.withColumn("hypothesis", tokens("hypothesis")).withColumn("reference", tokens("reference"))
    known = frozenset(w.lower() for w in function_words)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series([count(list(h), list(r), dict(c) if c is not None else {}, dict(p) if p is not None else {}, known, beam, kinds) for h, r, c, p in zip(*parts, strict=True)])

    counts = F.pandas_udf(run, "array<bigint>")
    return rows.select(key, counts("hypothesis", "reference", "classes", "phrases").alias("counts")).select(key, *(F.get("counts", F.lit(k)).alias(c) for k, c in enumerate(COUNTS)))


def score(total=F.col) -> Column:
    """The score of counts; total: from a count's name to its column, as F.sum for a corpus."""
    number = lambda name: total(name).cast("double")

    def share(side: str) -> Column:
        matched = sum((w * (DELTA * number(f"{side}_content_{k}") + (1 - DELTA) * number(f"{side}_function_{k}")) for k, w in enumerate(WEIGHTS)), F.lit(0.0))
        whole = DELTA * number(f"{side}_content") + (1 - DELTA) * number(f"{side}_function")
        return F.when(whole > 0, matched / whole).otherwise(0.0)

    hits = lambda side: sum((number(f"{side}_{kind}_{k}") for kind in ("content", "function") for k in range(len(WEIGHTS))), F.lit(0.0))
    length = lambda side: number(f"{side}_content") + number(f"{side}_function")
    p, r = (share(s) for s in SIDES)
    mean = p * r / (ALPHA * p + (1 - ALPHA) * r)
    both = hits("hypothesis") + hits("reference")
    # One chunk of all words isn't fragmented.
    whole = (number("chunks") == 1) & (both == length("hypothesis") + length("reference"))
    fragmented = F.when(whole, 0.0).otherwise(number("chunks") / (both / 2))
    return F.when((p > 0) & (r > 0), mean * (1 - GAMMA * F.pow(fragmented, F.lit(BETA)))).otherwise(0.0)


def meteor(pairs: DataFrame, key: str, hypothesis: str, reference: str, **tables) -> DataFrame:
    """(key, meteor) of each sample; tables as for `meteor_counts`."""
    return meteor_counts(pairs, key, hypothesis, reference, **tables).select(key, score().alias("meteor"))


def corpus_meteor(counts: DataFrame) -> DataFrame:
    """One row: the score of all samples' counts together, 100 at most."""
    return counts.agg(F.coalesce(100 * score(F.sum), F.lit(0.0)).alias("meteor"))

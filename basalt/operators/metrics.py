"""Text metrics of summaries: BLEU, ROUGE-L, METEOR (exact and stem matches), and their dispatch.

A sample is one row and is scored in it: n-gram counts, longest common subsequences and METEOR's alignment run in Arrow
UDFs without a shuffle; what follows from the counts are native expressions and aggregates.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from basalt.functions import text as T
from basalt.sources.shared import checkpointed

TINY, SMALL = 1e-15, 1e-9
ORDERS = 4


def ngram_counts(df: DataFrame, key: str, c: str) -> DataFrame:
    """(key, n, gram, count) for n = 1..4 over white-space tokens."""
    w = df.select(key, T.words(c).alias("w"))
    grams = lambda n: F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, n), " ").alias("gram")))
    return w.select(key, F.inline(F.concat(*(grams(n) for n in range(1, ORDERS + 1))))).groupBy(key, "n", "gram").agg(F.count(F.lit(1)).alias("count"))


def _bleu_counts(hyp: list[str], refs: list[list[str]]) -> tuple:
    """(test_len, ref_len, correct_1..4) of one sample: matches clipped by the most that a reference has, the length of the reference closest in length, the shorter of two."""
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, ORDERS + 1) for i in range(len(w) - n + 1))
    most: Counter = Counter()
    for r in refs:
        most |= grams(r)
    matched = grams(hyp) & most
    correct = [0] * ORDERS
    for g, n in matched.items():
        correct[len(g) - 1] += n
    return (len(hyp), min((abs(len(r) - len(hyp)), len(r)) for r in refs)[1] if refs else 0, *correct)


BLEU_COUNTS = ["test_len", "ref_len", *(f"correct_{n}" for n in range(1, ORDERS + 1))]


@F.pandas_udf(StructType([StructField(c, LongType()) for c in BLEU_COUNTS]))
def bleu_counts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Counts in the row: words of the hypothesis, and an array of the references' words."""
    for h, rs in batches:
        yield pd.DataFrame([_bleu_counts(list(a), [list(r) for r in b]) for a, b in zip(h, rs, strict=True)], columns=BLEU_COUNTS)


def bleu_statistics(pairs: DataFrame, key: str, hypothesis: str, reference: str) -> DataFrame:
    """(key, test_len, ref_len, correct_1..4, guess_1..4) of each sample, without a shuffle. reference: a text, or an array of texts."""
    several = isinstance(pairs.schema[reference].dataType, ArrayType)
    refs = F.transform(F.coalesce(reference, F.array().cast("array<string>")), T.words) if several else F.array(T.words(reference))
    out = pairs.select(key, bleu_counts(T.words(hypothesis), refs).alias("counts")).select(key, "counts.*")
    return out.select("*", *(F.greatest(F.lit(0), F.col("test_len") - (n - 1)).cast("long").alias(f"guess_{n}") for n in range(1, ORDERS + 1)))


def bleu_columns(scale: float = 1.0) -> list[Column]:
    """bleu_1..bleu_4 from statistics: geometric means of smoothed precisions, with the brevity penalty."""
    ratio = (F.col("test_len") + TINY) / (F.col("ref_len") + SMALL)
    penalty = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(F.lit(1.0))
    out, product = [], F.lit(1.0)
    for n in range(1, ORDERS + 1):
        product = product * (F.col(f"correct_{n}") + TINY) / (F.col(f"guess_{n}") + SMALL)
        out.append((F.pow(product, F.lit(1.0 / n)) * penalty * scale).alias(f"bleu_{n}"))
    return out


def sentence_bleu(pairs: DataFrame, key: str, hypothesis: str, reference: str) -> DataFrame:
    return bleu_statistics(pairs, key, hypothesis, reference).select(key, *bleu_columns())


def corpus_bleu(pairs: DataFrame, key: str, hypothesis: str, reference: str) -> DataFrame:
    """One row, on a scale of 100: statistics summed first."""
    stats = bleu_statistics(pairs, key, hypothesis, reference)
    return stats.agg(*(F.sum(c).alias(c) for c in stats.columns if c != key)).select(*bleu_columns(100.0))


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    if not a or not b:
        return 0
    other = np.array(b, object)
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        # Matches extend the diagonal; the running maximum carries the best on.
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(other == x, row[:-1] + 1, 0)))
    return int(row[-1])


@F.pandas_udf(IntegerType())
def lcs_length(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([_lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(pairs: DataFrame, key: str, hypothesis: str, reference: str, beta: float = 1.2) -> DataFrame:
    """(key, rouge_l): F-score of the longest common subsequence; 0 where either text is empty."""
    h, r = T.words(hypothesis), T.words(reference)
    rows = pairs.select(key, lcs_length(h, r).alias("lcs"), F.size(h).alias("h"), F.size(r).alias("r"))
    p, q, b = F.col("lcs") / F.col("h"), F.col("lcs") / F.col("r"), beta**2
    return rows.select(key, F.when((F.col("h") == 0) | (F.col("r") == 0) | (F.col("lcs") == 0), F.lit(0.0)).otherwise((1 + b) * p * q / (q + b * p)).alias("rouge_l"))


def mean_scores(scored: DataFrame, columns: list[str], scale: float = 100.0) -> DataFrame:
    """One row: means of scores over all samples, scaled; NaN without samples."""
    return scored.agg(*(F.coalesce(F.avg(c) * scale, F.lit(float("nan"))).alias(c) for c in columns))


def _stem(w: str) -> str:
    """A word without a common English ending."""
    for s in ("ingly", "edly", "ings", "ing", "ies", "ed", "es", "ly", "s"):
        if w.endswith(s) and len(w) - len(s) >= 3:
            return w[: -len(s)]
    return w


def _meteor(hyp: list[str], ref: list[str], alpha: float = 0.85, beta: float = 0.2, gamma: float = 0.6, stem_weight: float = 0.6) -> float:
    """Exact, then stem matches, each to the nearest free word in order; weighted F-mean less a penalty for chunks."""
    if not hyp or not ref:
        return 0.0
    match: dict[int, int] = {}
    weight, free = 0.0, set(range(len(ref)))
    for form, w in ((str.lower, 1.0), (lambda x: _stem(x.lower()), stem_weight)):
        at: dict[str, list[int]] = {}
        for j in sorted(free):
            at.setdefault(form(ref[j]), []).append(j)
        for i, x in enumerate(hyp):
            if i not in match and (js := [j for j in at.get(form(x), ()) if j in free]):
                j = min(js, key=lambda j: abs(j - match.get(i - 1, i - 1) - 1))
                match[i] = j
                free.discard(j)
                weight += w
    if not match:
        return 0.0
    p, r = weight / len(hyp), weight / len(ref)
    chunks = sum(1 for i in match if match.get(i - 1) != match[i] - 1)
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (chunks / len(match)) ** beta) if len(match) > 1 or chunks > 1 else p * r / (alpha * p + (1 - alpha) * r)


@F.pandas_udf(DoubleType())
def meteor_score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([_meteor(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def meteor(pairs: DataFrame, key: str, hypothesis: str, reference: str) -> DataFrame:
    """(key, meteor_approx): METEOR without synonyms and paraphrases, which need data that isn't here."""
    return pairs.select(key, meteor_score(T.words(T.meteor_clean(hypothesis)), T.words(T.meteor_clean(reference))).alias("meteor_approx"))


Scorer = Callable[[DataFrame, str, str, str], DataFrame]
#: The metrics by name: each gives (key, columns...).
SCORERS: dict[str, Scorer] = {"bleu": sentence_bleu, "rouge_l": rouge_l, "meteor": meteor}


def score_all(pairs: DataFrame, key: str, hypothesis: str, reference: str, scorers: dict[str, Scorer] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """All metrics of each sample, and the errors of those that failed, which are left out. Each metric is computed at once, so that one that fails at run time costs itself alone."""
    out, errors = pairs.select(key), {}
    for name, scorer in (SCORERS if scorers is None else scorers).items():
        try:
            out = out.join(checkpointed(scorer(pairs, key, hypothesis, reference)), key, "left")
        except Exception as e:
            errors[name] = str(e)
    return out, errors


def scorable(df: DataFrame, code: str, summaries: list[str]) -> DataFrame:
    """Rows with code and at least one summary that isn't blank."""
    some = F.lit(False)
    for c in summaries:
        some |= F.trim(T.text(c)) != ""
    return df.filter((F.trim(T.text(code)) != "") & some)


def averages_over_all(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: means over all rows, a missing value counting as 0; 0 without rows."""
    return df.agg(*(F.coalesce(F.avg(F.coalesce(c, F.lit(0))), F.lit(0.0)).alias(f"avg_{c}") for c in columns))


def present_systems(df: DataFrame, systems: list[str]) -> list[str]:
    """Systems whose column exists and isn't null throughout."""
    there = [s for s in systems if s in df.columns]
    row = df.agg(*(F.max(F.col(s).isNotNull()).alias(s) for s in there)).first() if there else {}
    return [s for s in there if row[s]]


def metric_averages(long: DataFrame) -> DataFrame:
    """(system, metric, average) of (sample_id, system, metric, score): NaN where no score is there, and a total over all systems in the rollup's null rows."""
    return long.rollup("metric", "system").agg(F.coalesce(F.avg("score"), F.lit(float("nan"))).alias("average")).filter("metric IS NOT NULL")


def pivot_modes(summaries: DataFrame, key: str, modes: list[str]) -> DataFrame:
    """One row a sample, a generated_summary_<mode> column for each mode: joined by key."""
    return summaries.groupBy(key).pivot("generation_mode", modes).agg(F.first("generated_summary")).select(key, *(F.col(m).alias(f"generated_summary_{m}") for m in modes))


def greedy_token_f1(tokens: DataFrame, key: str) -> DataFrame:
    """BERTScore's greedy matching for given unit token vectors: (key, side 'h' or 'r', pos, vec) to (key, f1). Runs in each sample's group."""

    def group(k, rows):
        h, r = (np.array(rows[rows["side"] == s].sort_values("pos")["vec"].tolist(), float) for s in ("h", "r"))
        f1 = 0.0
        if len(h) and len(r):
            sim = h @ r.T
            p, q = sim.max(axis=1).mean(), sim.max(axis=0).mean()
            f1 = 2 * p * q / (p + q) if p + q else 0.0
        return pd.DataFrame({key: [k[0]], "f1": [f1]})

    return tokens.groupBy(key).applyInPandas(group, f"`{key}` {tokens.schema[key].dataType.simpleString()}, f1 double")

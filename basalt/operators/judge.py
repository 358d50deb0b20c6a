"""Scores of a model judge: normalisation, expectation over log-probabilities, claims, averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.functions import text as T

CRITERIA = ("accuracy", "coverage", "effectiveness")
#: A reply's tokens, each with its alternatives.
TOKENS = "array<struct<token: string, top_logprobs: array<struct<token: string, logprob: double>>>>"


def normalise(score: Column) -> Column:
    """1..10 to 0..1 with its fraction, four decimals; null stays null, so that a missing score shows."""
    return F.round((score.cast("double") - 1) / 9, 4)


def scores_from_reply(reply: str | Column, label: str) -> list[Column]:
    """A label's three scores from a judge's reply (JSON, or JSON somewhere in prose); null where the reply has none."""
    v = T.salvage_json(reply)
    return [normalise(F.try_variant_get(v, f"$.{label}.{c}", "double")).alias(c) for c in CRITERIA]


def weighted_scores(tokens: str | Column, labels: int) -> Column:
    """Expected scores of the digit tokens of a reply, if there are three for each label; else null."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    digits = F.filter(c, lambda t: F.trim(t["token"]).rlike(r"^(?:[1-9]|10)$"))
    return F.when(F.size(digits) == 3 * labels, F.transform(digits, lambda t: T.expected_score(t["top_logprobs"])))


def claim_accuracy(claims: DataFrame, key: list[str], tag: str = "tag") -> DataFrame:
    """Share of claims tagged ACCURATE/..., and counts by tag."""
    tags = ("ACCURATE/GOLD", "ACCURATE/SAFE", "INACCURATE/FATAL", "INACCURATE/NOISE")
    return claims.groupBy(*key).agg((F.count_if(F.col(tag).startswith("ACCURATE")) / F.count(F.lit(1))).alias("accurate_share"), *(F.count_if(F.col(tag) == t).alias(t.lower().replace("/", "_")) for t in tags))


def averages(scores: DataFrame, system: str = "system") -> DataFrame:
    """Means by system; NaN where a system has no score."""
    return scores.groupBy(system).agg(*(F.coalesce(F.avg(c), F.lit(float("nan"))).alias(c) for c in CRITERIA))

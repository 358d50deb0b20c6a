"""Toxicity by subword-bag embeddings and a linear softmax.

A text's features are its words and their character 3- to 5-grams (with word
boundaries), hashed to buckets. Embeddings of the features are averaged over the text and go into a linear softmax
of two classes; both are trained jointly in numpy. Misspellings that training hasn't seen share n-grams, and so
vectors, with words that it has.

Training rows are a bounded sample: the `max_per_class` labelled documents of each class that
come first by a hash of their id. The executors hash their texts to features; the driver gets these, which for a text of any length
are 2**18 buckets with counts at most.

As averaging and the softmax are linear in the embeddings, a trained model is one number for each
bucket. A word's sum over its features is remembered, in a table of bounded size, so scoring a text adds up its words.
"""

from __future__ import annotations

import string
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import process_memo

BUCKETS = 1 << 18
#: Tokens of more characters aren't remembered.
LONG = 200


def word_of(token: str) -> str:
    return token.strip(string.punctuation).lower()


def features_of(word: str) -> Iterable[int]:
    """Buckets of a word and its 3- to 5-grams; those of a long word one by one, as there can be millions."""
    if not word:
        return []
    padded = f"<{word}>"
    grams = (padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1))
    found = (zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in chain((word,), grams))
    return found if len(word) > LONG else list(found)


@dataclass
class Model:
    slope: np.ndarray  # of each bucket: what its embedding adds to the log-odds of class 1
    bias: float

    def score(self, total: float, features: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / max(1, features), -30, 30))))


def matrices(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int, steps: int, rate: float, batch: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings of all buckets, weights and biases of the softmax, trained jointly: passes over the sample go on until `steps` batches are done."""
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    squares = [np.full_like(x, 1e-8) for x in (embedding, weight, bias)]
    full = np.flatnonzero([len(b) > 0 for b, _ in bags])
    for _ in range(-(-steps * batch // max(1, len(full))) if len(full) else 0):
        order = rng.permutation(full)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            buckets = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] / bags[r][1].sum() for r in rows]).astype(np.float32)
            first = np.cumsum([0, *(len(bags[r][0]) for r in rows[:-1])])
            mean = np.add.reduceat(embedding[buckets] * share[:, None], first, axis=0)
            logits = mean @ weight + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            error = p
            error[np.arange(len(rows)), labels[rows]] -= 1
            back = error @ weight.T
            step = np.repeat(back, np.diff([*first, len(buckets)]), axis=0) * share[:, None]
            used, inverse = np.unique(buckets, return_inverse=True)
            grad = np.stack([np.bincount(inverse, step[:, d], len(used)) for d in range(dim)], axis=1).astype(np.float32)
            squares[0][used] += grad**2
            embedding[used] -= rate * grad / np.sqrt(squares[0][used])
            for k, (x, g) in enumerate(((weight, mean.T @ error), (bias, error.sum(axis=0))), 1):
                squares[k] += g**2
                x -= 0.1 * rate * g / np.sqrt(squares[k])
    return embedding, weight, bias


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, dim: int = 8, steps: int = 800, rate: float = 0.5, batch: int = 32, seed: int = 7) -> Model:
    """bags: (buckets, counts) of each text. prior: share of class 1 among all labelled rows, which the sample needn't have."""
    p = min(max(prior, 1e-6), 1 - 1e-6)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    embedding, weight, bias = matrices(bags, labels, dim, steps, rate, batch, seed)
    sampled = min(max(labels.mean(), 1e-6), 1 - 1e-6)
    shift = np.log(p / (1 - p)) - np.log(sampled / (1 - sampled))
    return Model((embedding @ (weight[:, 1] - weight[:, 0])).astype(np.float64), float(bias[1] - bias[0] + shift))


def bags(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(label, buckets, counts) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text in b.column(1):
                bag: Counter = Counter()
                for token, n in Counter((text.as_py() or "").split()).items():
                    for f in features_of(word_of(token)):
                        bag[f] += n
                found.append(bag)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))], names=["label", "buckets", "counts"])

    return df.select(F.col(label_col).alias("label"), text_col).mapInArrow(run, "label int, buckets array<int>, counts array<int>")


def first_by_hash(df: DataFrame, hashed: str, id_col: str, n: int, most: int) -> DataFrame:
    """The `most` first of n rows by hash. Only rows below a threshold that lets somewhat more through are sorted, so that neither a task nor the merge of all tasks' rows grows with the input."""
    share = min(1.0, (1.5 * most + 100) / max(1, n))
    while True:
        low = df if share >= 1 else df.filter(F.col(hashed) < int(2**64 * share) - 2**63)
        if share >= 1 or low.count() >= most:
            return low.orderBy(hashed, id_col).limit(most)
        share *= 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = 1500) -> Model:
    """Fit on the documents that labels name. A label is 1 or 0; null labels and ids are left out; of several labels of an id the largest counts. Without labels every score is that of the prior."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxicity_label"))
    marked = marked.withColumn("toxicity_hash", F.xxhash64(id_col))
    sizes = {r[0]: r[1] for r in marked.groupBy("toxicity_label").agg(F.count(F.lit(1))).collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    # 2 * max_per_class rows at most.
    sample = None
    for label, n in sizes.items():
        one = first_by_hash(marked.filter(F.col("toxicity_label") == label), "toxicity_hash", id_col, n, max_per_class).drop("toxicity_hash")
        sample = one if sample is None else sample.unionByName(one)
    sample = marked.drop("toxicity_hash") if sample is None else sample
    rows = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)
    found = bags(rows, text_col, "toxicity_label").toArrow()
    labels_of = found["label"].to_numpy()
    packed = [(b.values.to_numpy(), c.values.to_numpy().astype(np.float32)) for b, c in zip(found["buckets"], found["counts"], strict=True)]
    # The order of rows is that of their content, so that a model doesn't depend on how the input is partitioned.
    order = sorted(range(len(packed)), key=lambda k: (labels_of[k], len(packed[k][0]), zlib.crc32(packed[k][0].tobytes())))
    return train([packed[k] for k in order], labels_of[order].astype(np.int64), float(prior))


class WordTotals(dict):
    """A token's sum of slopes and number of features."""

    def __init__(self, slope: np.ndarray, most: int):
        self.slope, self.most = slope.tolist(), most

    def __missing__(self, token: str) -> complex:
        if len(token) > LONG:
            total, n = 0.0, 0
            for n, f in enumerate(features_of(word_of(token)), 1):
                total += self.slope[f]
            return complex(total, n)
        if len(self) >= self.most:
            self.clear()
        found = features_of(word_of(token))
        # One complex number carries both sums through one addition.
        value = self[token] = complex(sum(map(self.slope.__getitem__, found)), len(found))
        return value


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cache_words: int = 300_000) -> DataFrame:
    """One row per document: the id, score (0 to 1) and predicted (1 if score >= 0.5).

    Null and empty texts have no feature and get the score of the bias alone. Texts are scored whole, whatever
    their length; rows that share an id each; an empty input gives an empty result. Only the id and the text are read.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = process_memo("toxicity")
        if memo.get("toxicity", (None,))[0] != key:
            memo["toxicity"] = (key, WordTotals(shipped.value.slope, cache_words))
        words, model = memo["toxicity"][1], shipped.value
        for b in batches:
            scores = []
            for text in b.column(1):
                total = sum(map(words.__getitem__, (text.as_py() or "").split()), 0j)
                scores.append(model.score(total.real, int(total.imag)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[id_col, "score", "predicted"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double, predicted int")

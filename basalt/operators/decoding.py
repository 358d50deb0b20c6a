"""Seeded decoding of continuations in batches, with a feature vector put in at a marker.

A prompt is a row of token ids; where the marker stands, a projection of the row's feature vector takes the place of the token's own vector. Any model that
keeps a state for a batch of rows will do (`Model`); `Recurrent` is one from given weights. A draw depends on the seed, the row's
key, the sample and the position alone, so that any partitioning and any batch gives the same continuations.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    """start: the state of so many rows before any token. feed: the state after one more token each (-1: none, the state stays), where `features` has vectors for rows that are at their marker. logits: (rows, vocabulary) of a state."""

    def start(self, rows: int) -> Any: ...
    def feed(self, state: Any, tokens: np.ndarray, at_marker: np.ndarray, features: np.ndarray) -> Any: ...
    def logits(self, state: Any) -> np.ndarray: ...


class Recurrent(NamedTuple):
    """h = tanh(vector of the token + recurrent @ h), logits = output @ h. embeddings, output: (vocabulary, width); recurrent: (width, width); features: (width, inputs)."""

    embeddings: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    features: np.ndarray

    def start(self, rows: int) -> np.ndarray:
        return np.zeros((rows, len(self.recurrent)))

    def feed(self, state: np.ndarray, tokens: np.ndarray, at_marker: np.ndarray, features: np.ndarray) -> np.ndarray:
        x = np.where(at_marker[:, None], features @ self.features.T, self.embeddings[np.maximum(tokens, 0)])
        return np.where(tokens[:, None] < 0, state, np.tanh(x + state @ self.recurrent.T))

    def logits(self, state: np.ndarray) -> np.ndarray:
        return state @ self.output.T


def allowed(logits: np.ndarray, temperature: float, top_k: int | None, top_p: float | None) -> np.ndarray:
    """Probabilities of the tokens that may be drawn: the top_k likeliest, of these the fewest whose probabilities come to top_p, the likeliest at least. Of equals the smaller id comes first. Without temperature it is the likeliest alone."""
    order = np.argsort(-logits, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(logits.shape[1]), order.shape), axis=1)
    if temperature == 0:
        return (rank == 0).astype(float)
    z = np.where(rank < (top_k or logits.shape[1]), logits / temperature, -np.inf)
    z = np.exp(z - z.max(1, keepdims=True))
    p = z / z.sum(1, keepdims=True)
    if top_p is not None:
        sorted_p = np.take_along_axis(p, order, axis=1)
        before = np.take_along_axis(np.cumsum(sorted_p, axis=1) - sorted_p, rank, axis=1)
        p = np.where((before < top_p) | (rank == 0), p, 0.0)
        p /= p.sum(1, keepdims=True)
    return p


def uniform(key: Any, sample: int, position: int, seed: int) -> float:
    return xxhash.xxh64_intdigest(f"{key!r}/{sample}/{position}", seed) / 2.0**64


def continuations(tokens: list[list[int]], features: np.ndarray, keys: list, samples: list[int], model: Model, marker: int, length: int, end: int | None, temperature: float, top_k: int | None, top_p: float | None, seed: int) -> list[list[int]]:
    """Of each row up to `length` new tokens, the end token left out. Prompts of different lengths are fed side by side, the shorter ones later, so that all end together."""
    n, longest = len(tokens), max(map(len, tokens), default=0)
    state = model.start(n)
    for k in range(longest):
        now = np.array([t[k - (longest - len(t))] if k >= longest - len(t) else -1 for t in tokens])
        state = model.feed(state, now, now == marker, features)
    out: list[list[int]] = [[] for _ in range(n)]
    going = np.ones(n, bool)
    for position in range(length):
        if not going.any():
            break
        p = allowed(model.logits(state), temperature, top_k, top_p)
        u = np.array([uniform(k, s, position, seed) for k, s in zip(keys, samples, strict=True)])
        total = np.cumsum(p, axis=1)
        # The first token whose sum is above the draw; one that may not be drawn adds nothing.
        now = (total <= (u * total[:, -1])[:, None]).sum(axis=1)
        now = np.minimum(now, p.shape[1] - 1 - np.argmax(p[:, ::-1] > 0, axis=1))
        going &= now != (-1 if end is None else end)
        for i in np.flatnonzero(going):
            out[i].append(int(now[i]))
        state = model.feed(state, np.where(going, now, -1), np.zeros(n, bool), features)
    return out


def decode(
    rows: DataFrame, model: Model, key: str, prompt: str, feature: str, marker: int, samples: int = 1, length: int = 16, end: int | None = None, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None, seed: int = 1, batch: int = 256
) -> DataFrame:
    """(key, sample, tokens): `samples` continuations of each prompt (an array of token ids) with the row's feature vector at its markers.

    The model goes to every task with its weights, so it should be of bounded size. Null prompts are empty, null features zeros of the other rows' length. Rows that repeat a key get the same draws. An empty input gives an empty result.
    """
    kind = rows.schema[key].dataType.simpleString()
    asked = rows.select(F.col(key).alias("key"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"), F.col(prompt).cast("array<int>").alias("prompt"), F.col(feature).cast("array<double>").alias("feature"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), batch):
                part = whole.slice(lo, batch)
                keys, sample, tokens, features = (c.to_pylist() for c in part.columns)
                width = max((len(f) for f in features if f is not None), default=0)
                if not width and hasattr(model, "features"):
                    width = model.features.shape[1]
                x = np.array([f if f is not None else [0.0] * width for f in features], float).reshape(len(part), width)
                found = continuations([t or [] for t in tokens], x, keys, sample, model, marker, length, end, temperature, top_k, top_p, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], names=["key", "sample", "tokens"])

    return asked.mapInArrow(run, f"key {kind}, sample int, tokens array<int>").withColumnRenamed("key", key)

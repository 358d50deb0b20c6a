"""An encoder layer with block-sparse attention over instruction blocks, and the samples it is trained on.

A row is laid out as `dataflow.block_tokens` makes it: blocks of local tokens, then each block's node tokens, then global tokens. A local token attends to its own block, its block's nodes and
all global tokens; a node to its own block, all global tokens, and those nodes that a dependence graph links it to (itself always), with a bias by their distance in
blocks; a global token to everything. Padding is attended to by nobody. Scores are computed block by block, so the work of a row
grows with its length times the block's size (and with the square of its nodes alone), not with the square of its length. Batches of rows go through numpy; weights go to every task, up to a stated size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that a layer's weights may have: 128 MB.
MOST_WEIGHTS = 1 << 24
NEVER = -1e30


class Layout(NamedTuple):
    """Blocks of a row, local tokens and node tokens of a block, global tokens of a row."""

    blocks: int
    block_size: int
    node_size: int = 1
    global_size: int = 1

    @property
    def length(self) -> int:
        return self.blocks * (self.block_size + self.node_size) + self.global_size


class Weights(NamedTuple):
    """embeddings: (vocabulary, width); query, key, value: (width, width), heads side by side; bias: (heads, 2 * most + 1), by distance from -most to most, farther ones as the farthest."""

    embeddings: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    bias: np.ndarray

    @property
    def heads(self) -> int:
        return len(self.bias)


def checked(weights: Weights) -> Weights:
    if (n := sum(x.size for x in weights)) > MOST_WEIGHTS:
        raise ValueError(f"a layer of {n} numbers; {MOST_WEIGHTS} are the most")
    return weights


def _attend(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Softmax over the scores of all parts side by side, applied to their values. parts: (scores (..., queries, keys), values (..., keys, width))."""
    top = np.max([s.max(-1) for s, _ in parts], axis=0)[..., None]
    weights = [np.exp(s - top) for s, _ in parts]
    total = sum(w.sum(-1) for w in weights)[..., None]
    return sum(w @ v for w, (_, v) in zip(weights, parts, strict=True)) / total


def forward(ids: np.ndarray, linked: np.ndarray, pad: int, layout: Layout, w: Weights) -> np.ndarray:
    """Hidden vectors (rows, length, width). ids: (rows, length); linked: (rows, nodes, nodes), whether a node attends to another."""
    rows, heads = len(ids), w.heads
    width = w.query.shape[1] // heads
    locals_, nodes = layout.blocks * layout.block_size, layout.blocks * layout.node_size
    x = w.embeddings[ids]
    split = lambda m: (x @ m).reshape(rows, layout.length, heads, width).transpose(0, 2, 1, 3)
    q, k, v = split(w.query) / np.sqrt(width), split(w.key), split(w.value)
    block = lambda t: t[:, :, :locals_].reshape(rows, heads, layout.blocks, layout.block_size, width)
    node = lambda t: t[:, :, locals_ : locals_ + nodes].reshape(rows, heads, layout.blocks, layout.node_size, width)
    glob = lambda t: t[:, :, None, locals_ + nodes :]
    turned = lambda t: np.swapaxes(t, -1, -2)
    unseen = np.where(ids[:, :locals_] == pad, NEVER, 0.0)
    in_block = unseen.reshape(rows, 1, layout.blocks, 1, layout.block_size)
    local = _attend([(block(q) @ turned(block(k)) + in_block, block(v)), (block(q) @ turned(node(k)), node(v)), (block(q) @ turned(glob(k)), glob(v))])
    # Nodes meet each other by the graph; their own block and the global tokens block by block.
    at = np.repeat(np.arange(layout.blocks), layout.node_size)
    most = w.bias.shape[1] // 2
    distance = np.clip(at[None, :] - at[:, None], -most, most) + most
    flat = lambda t: t[:, :, locals_ : locals_ + nodes]
    may = linked | np.eye(nodes, dtype=bool)[None]
    among = flat(q) @ turned(flat(k)) + w.bias[:, distance][None] + np.where(may, 0.0, NEVER)[:, None]
    among = among.reshape(rows, heads, layout.blocks, layout.node_size, nodes)
    every = flat(v)[:, :, None]
    middle = _attend([(among, every), (node(q) @ turned(block(k)) + in_block, block(v)), (node(q) @ turned(glob(k)), glob(v))])
    unseen_by_global = np.concatenate([unseen, np.zeros((rows, layout.length - locals_))], axis=1)[:, None, None]
    top = _attend([(q[:, :, locals_ + nodes :] @ turned(k) + unseen_by_global, v)])
    out = np.concatenate([local.reshape(rows, heads, locals_, width), middle.reshape(rows, heads, nodes, width), top], axis=2)
    return out.transpose(0, 2, 1, 3).reshape(rows, layout.length, heads * width)


def encode(rows: DataFrame, key: str, ids: str, links: str, layout: Layout, weights: Weights, pad: int = 0, batch: int = 64) -> DataFrame:
    """(key, hidden): the hidden vectors of each row's tokens in order. ids: token ids, of the layout's length; links: pairs (u, v) of blocks whose nodes attend to each other's, in both directions. Null links are none; rows whose ids have another length have a null result."""
    w = checked(weights)
    kind = rows.schema[key].dataType.simpleString()
    nodes = layout.blocks * layout.node_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), batch):
                part = whole.slice(lo, batch)
                tokens, pairs = part.column(1).to_pylist(), part.column(2).to_pylist()
                fit = [i for i, t in enumerate(tokens) if t is not None and len(t) == layout.length]
                linked = np.zeros((len(fit), nodes, nodes), bool)
                for i, k in enumerate(fit):
                    for p in pairs[k] or ():
                        u, v = (slice(b * layout.node_size, (b + 1) * layout.node_size) for b in (p["u"], p["v"]))
                        linked[i, u, v] = linked[i, v, u] = True
                found: list = [None] * len(part)
                if fit:
                    for k, h in zip(fit, forward(np.array([tokens[k] for k in fit]), linked, pad, layout, w), strict=True):
                        found[k] = h.tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["key", "hidden"])

    asked = rows.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"), F.transform(links, lambda p: F.struct(p["u"].cast("int").alias("u"), p["v"].cast("int").alias("v"))).alias("links"))
    return asked.mapInArrow(run, f"key {kind}, hidden array<array<double>>").withColumnRenamed("key", key)


def _chance(seed: int, *what: Column) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 30)) / float(1 << 30)


def masked_tokens(rows: DataFrame, key: str, ids: str, layout: Layout, mask: int, vocabulary: int, pad: int = 0, rate: float = 0.15, seed: int = 1) -> DataFrame:
    """(key, ids, masked, labels): the training samples of masked tokens. Each local token but padding is chosen with a chance of `rate`; of those chosen eight of ten become the mask, one any token, one stays. masked: their places, from 0; labels: what stood there. By hash of key and place, so always the same."""
    tokens = F.col(ids).cast("array<int>")
    last = layout.blocks * layout.block_size
    drawn = lambda what, i: _chance(seed, F.col(key), F.lit(what), i)
    chosen = F.filter(F.transform(tokens, lambda t, i: F.when((i < last) & (t != pad) & (drawn("pick", i) < rate), i)), lambda i: i.isNotNull())
    other = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.lit("any"), i), F.lit(vocabulary)).cast("int")
    shown = F.transform(tokens, lambda t, i: F.when(~F.array_contains("masked", i), t).when(drawn("how", i) < 0.8, F.lit(mask)).when(drawn("how", i) < 0.9, other(i)).otherwise(t))
    marked = rows.select(key, F.col(ids), chosen.alias("masked")).withColumn("labels", F.transform("masked", lambda i: F.get(tokens, i)))
    return marked.select(key, shown.alias("shown"), "masked", "labels").withColumnRenamed("shown", "ids")


def linked_pairs(rows: DataFrame, key: str, links: str, blocks: str, seed: int = 1) -> DataFrame:
    """(key, u, v, linked): the training samples of edges: each link, and as many pairs of blocks that aren't linked (fewer where hashes meet links, the same pair or a block twice). blocks: how many blocks a row has."""
    own = F.transform(links, lambda p: F.struct(F.least(p["u"], p["v"]).cast("int").alias("u"), F.greatest(p["u"], p["v"]).cast("int").alias("v")))
    own = F.array_distinct(F.filter(own, lambda p: p["u"] != p["v"]))
    pick = lambda i, what: F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.lit(what), i), F.greatest(F.col(blocks).cast("long"), F.lit(1))).cast("int")
    drawn = F.transform("own", lambda _, i: F.struct(F.least(pick(i, "u"), pick(i, "v")).alias("u"), F.greatest(pick(i, "u"), pick(i, "v")).alias("v")))
    free = F.array_except(F.filter(drawn, lambda p: p["u"] != p["v"]), "own")
    known = rows.select(key, blocks, own.alias("own"))
    samples = F.concat(F.transform("own", lambda p: F.struct(p["u"].alias("u"), p["v"].alias("v"), F.lit(True).alias("linked"))), F.transform(free, lambda p: F.struct(p["u"].alias("u"), p["v"].alias("v"), F.lit(False).alias("linked"))))
    return known.select(key, F.inline(samples))


def token_scores(encoded: DataFrame, places: str, weights: Weights, key: str) -> DataFrame:
    """(key, place, token): the masked-token head, the likeliest token at each place of encoded rows (key, hidden, places), by the embeddings that the tokens come in with."""
    table = weights.embeddings
    width = weights.value.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.argmax(x @ table.T, axis=1), pa.int32())], names=["key", "place", "token"])

    each = encoded.select(F.col(key).alias("key"), F.explode(places).alias("place"), "hidden").select("key", F.col("place").cast("int"), F.get("hidden", F.col("place")).alias("x")).filter("x IS NOT NULL")
    return each.mapInArrow(run, f"key {encoded.schema[key].dataType.simpleString()}, place int, token int").withColumnRenamed("key", key)


def link_scores(encoded: DataFrame, pairs: DataFrame, key: str, layout: Layout) -> DataFrame:
    """pairs (key, u, v, ...) with `score`: the edge head, the inner product of both blocks' first nodes. A pair of a row without hidden vectors is left out."""
    node = lambda c: F.get("hidden", layout.blocks * layout.block_size + F.col(c) * layout.node_size)
    product = F.aggregate(F.zip_with(node("u"), node("v"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(encoded.select(key, "hidden"), key).select(*pairs.columns, product.alias("score")).filter("score IS NOT NULL")

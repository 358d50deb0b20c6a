"""Message passing over call graphs: attention layers (dynamic as in GATv2, static as in GAT) and mean aggregation (GraphSAGE), from given weights.

Nodes are projected in Arrow batches, edges meet their ends in two joins. The softmax over a node's incoming edges is a segment softmax of
states (largest logit, sum of exponentials, weighted sum of messages) that can be merged in any order: a task merges what it reads
before anything is shuffled, so that a node with very many edges sends one state a batch, and states of a node are merged as a
sorted stream with one state in memory. No edge's vector is exploded, and none is shuffled after the joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.sources.shared import kept

GATV2, GAT, SAGE = "gatv2", "gat", "sage"
#: Numbers that a layer may have, as its weights go to every task: 128 MB.
MOST_WEIGHTS = 1 << 24
SLOPE = 0.2


class Layer(NamedTuple):
    """Weights of a layer. left, right: projections of an edge's source and target, (input, heads * width). attention: (heads, width), of GAT for sources; attention_right: of GAT for targets. edge: a row for each
    edge type, (types, heads * width), the type's embedding already projected; attention_edge: of GAT for them. Missing parts are zero; GAT has one projection, left."""

    kind: str
    left: np.ndarray
    heads: int = 1
    right: np.ndarray | None = None
    left_bias: np.ndarray | None = None
    right_bias: np.ndarray | None = None
    attention: np.ndarray | None = None
    attention_right: np.ndarray | None = None
    edge: np.ndarray | None = None
    attention_edge: np.ndarray | None = None
    bias: np.ndarray | None = None


def layer_of(weights: DataFrame, kind: str, heads: int = 1) -> Layer:
    """A layer from a table (part, at, values): the rows of each part in order. A layer's size doesn't depend on the graph; one of over MOST_WEIGHTS numbers is an error."""
    size = weights.agg(F.sum(F.size("values"))).first()[0] or 0
    if size > MOST_WEIGHTS:
        raise ValueError(f"a layer of {size} numbers; {MOST_WEIGHTS} are the most")
    found: dict[str, list] = {}
    for r in weights.orderBy("part", "at").collect():
        found.setdefault(r.part, []).append(list(r["values"]))
    parts = {k: np.array(v, float) for k, v in found.items()}
    for k in ("bias", "left_bias", "right_bias"):
        if k in parts:
            parts[k] = parts[k].ravel()
    return Layer(kind=kind, heads=heads, **parts)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of an array as a column of lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel(), pa.float64()))


def merged(codes: np.ndarray, top: np.ndarray, total: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """States of equal code merged into one. top, total: (rows, heads); value: (rows, heads, width)."""
    order = np.argsort(codes, kind="stable")
    codes, top, total, value = codes[order], top[order], total[order], value[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
    high = np.maximum.reduceat(top, first)
    scale = np.exp(top - np.repeat(high, np.diff(np.append(first, len(codes))), axis=0))
    return codes[first], high, np.add.reduceat(total * scale, first), np.add.reduceat(value * scale[:, :, None], first)


def _segment_softmax(edges: DataFrame, target: str, kind: str, heads: int, logits, message: str) -> DataFrame:
    """(target, value): messages weighted by the softmax of `logits` over each target's edges. logits: from a record batch to an array (rows, heads). kind: the target's type."""

    def out(keys: pa.Array, top: np.ndarray, total: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, _lists(top), _lists(total), _lists(value.reshape(len(value), -1))], names=["target", "top", "total", "value"])

    def state(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        top, total = _vectors(batch.column(1), heads), _vectors(batch.column(2), heads)
        value = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        return batch.column(0), top, total, value.reshape(len(batch), heads, -1)

    def shrink(keys: pa.Array, top: np.ndarray, total: np.ndarray, value: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        coded = keys.dictionary_encode()
        codes, *rest = merged(coded.indices.to_numpy(), top, total, value)
        return coded.dictionary.take(pa.array(codes)), *rest

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = batch.schema.get_field_index
                values = batch.column(at(message)).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), heads, -1)
                top = logits(batch)
                yield out(*shrink(batch.column(at(target)), top, np.ones_like(top), values))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the state of the last target, which may go on
        for batch in chain(batches, (None,)):
            if batch is not None and len(batch):
                new = state(batch)
                if held is not None:
                    new = pa.concat_arrays([held[0], new[0]]), *(np.concatenate(x) for x in zip(held[1:], new[1:], strict=True))
                new = shrink(*new)
                ready, held = tuple(x[:-1] for x in new), tuple(x[-1:] for x in new)
            elif batch is None and held is not None:
                ready, held = held, None
            else:
                continue
            if len(ready[0]):
                yield pa.RecordBatch.from_arrays([ready[0], _lists((ready[3] / ready[2][:, :, None]).reshape(len(ready[0]), -1))], names=["target", "value"])

    states = edges.mapInArrow(partial, f"target {kind}, top array<double>, total array<double>, value array<double>")
    return states.repartition("target").sortWithinPartitions("target").mapInArrow(finish, f"target {kind}, value array<double>")


def _projected(nodes: DataFrame, node: str, vector: str, kind: str, layer: Layer) -> DataFrame:
    """(node, message, source, right): what an edge takes from its source (message, and for GAT its share of the logits) and from its target."""
    zero = lambda x: 0.0 if x is None else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), layer.left.shape[0])
            message = x @ layer.left + zero(layer.left_bias)
            if layer.kind == GATV2:
                source, right = np.zeros((len(x), 0)), x @ layer.right + zero(layer.right_bias)
            else:
                by_head = message.reshape(len(x), layer.heads, -1)
                source, right = (by_head * layer.attention).sum(-1), (by_head * layer.attention_right).sum(-1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(message), _lists(source), _lists(right)], names=["node", "message", "source", "right"])

    return nodes.select(node, vector).mapInArrow(run, f"node {kind}, message array<double>, source array<double>, right array<double>")


def attention(nodes: DataFrame, edges: DataFrame, layer: Layer, node: str = "node", vector: str = "x", source: str = "src", target: str = "dst", edge_type: str | None = None) -> DataFrame:
    """(node, vector): each node's messages from its incoming edges and itself, weighted by attention, heads side by side.

    An edge from a node to itself is replaced by the node's own, whose type is the mean of the types of its other edges. Edges that repeat count each; edges with an end that is no node, or null, count nothing.
    Nodes: distinct, none null, vectors without nulls. An empty table gives an empty result.
    """
    kind = nodes.schema[node].dataType.simpleString()
    projected = kept(_projected(nodes, node, vector, kind, layer))
    types = 0 if edge_type is None or layer.edge is None else len(layer.edge)
    empty = F.array().cast("array<double>")
    share = F.array(*(F.when(F.col(edge_type) == t, 1.0).otherwise(0.0) for t in range(types))) if types else empty
    own = edges.filter(F.col(source) != F.col(target)).select(F.col(source).alias("src"), F.col(target).alias("dst"), share.alias("share"))
    loops = projected.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    if types:
        known = own.join(projected.select(F.col("node").alias("src")), "src", "left_semi")
        mean = known.groupBy("dst").agg(F.array(*(F.avg(F.get("share", F.lit(t))) for t in range(types))).alias("share"))
        loops = loops.join(mean, "dst", "left").select("src", "dst", F.coalesce("share", F.array(*(F.lit(0.0) for _ in range(types)))).alias("share"))
    else:
        loops = loops.withColumn("share", empty)
    heads = layer.heads
    table = layer.edge if types else np.zeros((0, layer.left.shape[1]))

    def logits(batch: pa.RecordBatch) -> np.ndarray:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        share, right = _vectors(column("share"), types), column("right")
        if layer.kind == GATV2:
            width = layer.left.shape[1]
            z = _vectors(column("message"), width) + _vectors(right, width) + share @ table
            z = np.where(z > 0, z, SLOPE * z)
            return (z.reshape(len(z), heads, -1) * layer.attention).sum(-1)
        z = _vectors(column("source"), heads) + _vectors(right, heads)
        if types:
            z = z + share @ (table.reshape(types, heads, -1) * layer.attention_edge).sum(-1)
        return np.where(z > 0, z, SLOPE * z)

    met = own.unionByName(loops).join(projected.select(F.col("node").alias("src"), "message", "source"), "src")
    met = met.select("dst", "share", "message", "source").join(projected.select(F.col("node").alias("dst"), "right"), "dst")
    found = _segment_softmax(met.select("dst", "share", "message", "source", "right"), "dst", kind, heads, logits, "message")
    value = F.col("value") if layer.bias is None else F.zip_with("value", F.array(*map(F.lit, layer.bias.tolist())), lambda a, b: a + b)
    return found.select(F.col("target").alias(node), value.alias(vector))


def mean_messages(nodes: DataFrame, edges: DataFrame, node: str = "node", vector: str = "x", source: str = "src", target: str = "dst") -> DataFrame:
    """(node, vector) of the nodes that an edge leads to: the mean of its sources' vectors. Edges that repeat count each."""
    kind = edges.schema[target].dataType.simpleString()
    sources = nodes.select(F.col(node).alias("src"), F.transform(vector, lambda x: x.cast("double")).alias("message"))
    met = edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).filter("dst IS NOT NULL").join(sources, "src").select("dst", "message")
    found = _segment_softmax(met, "dst", kind, 1, lambda batch: np.zeros((len(batch), 1)), "message")
    return found.select(F.col("target").alias(node), F.col("value").alias(vector))


def sage(nodes: DataFrame, edges: DataFrame, layer: Layer, node: str = "node", vector: str = "x", source: str = "src", target: str = "dst") -> DataFrame:
    """(node, vector): the projected mean of a node's neighbours (zero without any), plus its own projection."""
    means = mean_messages(nodes, edges, node, vector, source, target).withColumnRenamed(vector, "mean").withColumnRenamed(node, "target")
    kind = nodes.schema[node].dataType.simpleString()
    inputs = layer.left.shape[0]
    none = F.array(*(F.lit(0.0) for _ in range(inputs)))
    both = nodes.select(node, vector).join(means, F.col(node) == F.col("target"), "left").select(node, vector, F.coalesce("mean", none).alias("mean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, mean = _vectors(batch.column(1), inputs), _vectors(batch.column(2), inputs)
            value = mean @ layer.left + own @ layer.right + (0.0 if layer.left_bias is None else layer.left_bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(value)], names=[node, vector])

    return both.mapInArrow(run, f"`{node}` {kind}, `{vector}` array<double>")


def encode_graph(nodes: DataFrame, edges: DataFrame, layers: list[Layer], node: str = "node", vector: str = "x", source: str = "src", target: str = "dst", edge_type: str | None = None) -> DataFrame:
    """(node, vector) after all layers, with the exponential linear unit between them. What a layer gives is written to the shared folder for the next."""
    now = nodes.select(node, vector)
    for k, layer in enumerate(layers):
        if k:
            now = kept(now.select(node, F.transform(vector, lambda x: F.when(x > 0, x).otherwise(F.expm1(x))).alias(vector)))
        now = sage(now, edges, layer, node, vector, source, target) if layer.kind == SAGE else attention(now, edges, layer, node, vector, source, target, edge_type)
    return now

"""Training on executors: a dual encoder with contrastive loss, a ranker that learns from a teacher's scores, and the runs that train them.

A run goes through its table epoch by epoch. Rows are dealt to groups (random batches, or each query's list of candidates), groups to steps; an epoch is written once, a folder for each step. In a
step each group's loss and gradient are computed where its rows are, and summed level by level on executors. The driver holds the
weights, and gets one gradient a step. Sums are of fixed-point numbers, so they don't depend on the order of adding: any
partitioning gives the same weights. After an epoch the state is written to a checkpoint table; a run that was ended goes on from the last one and ends with the same weights as one that was not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators.messages import _vectors
from basalt.sources.shared import remove, scratch_folder
from basalt.sources.sinks import latest_checkpoint

State = dict[str, np.ndarray]
#: Gradients are summed in units of 2**-UNIT.
UNIT = 36
#: Gradients that one task adds up.
FAN = 16
#: Numbers that a state may have, as it goes to every task: 128 MB.
MOST_WEIGHTS = 1 << 24
#: Adam's decay rates and its guard against division by zero. Fixed values.
DECAY, DECAY_SQUARE, GUARD = 0.9, 0.999, 1e-8


def normed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one (a zero row stays), and their lengths."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return x / n, n


def through_norm(grad: np.ndarray, unit: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (grad - unit * (grad * unit).sum(1, keepdims=True)) / length


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


class Objective(Protocol):
    """What is learned: the state to begin with, and a group's loss and gradient (for the names in `weights`)."""

    columns: tuple[str, ...]
    weights: tuple[str, ...]

    def start(self, seed: int) -> State: ...
    def group(self, rows: int, epoch: int, seed: int) -> Column: ...
    def gradient(self, state: State, columns: list[pa.Array]) -> tuple[float, State]: ...
    def after(self, state: State, step: DataFrame) -> None: ...


class Contrastive(NamedTuple):
    """Rows (id, left, right): two vectors of a pair, each projected and brought to length one. Of a batch each left vector has to find its own right one among all of the batch and of a queue, and the other way round.

    The queue has the projections of the last rows, by weights that follow slowly (momentum): `queue` rows of a step, those first by a hash of their id, go to the driver for it.
    """

    inputs: tuple[int, int]
    width: int = 32
    batch: int = 128
    queue: int = 128
    momentum: float = 0.9
    scale: float = 10.0
    most_scale: float = 100.0
    columns: tuple[str, ...] = ("left", "right")
    weights: tuple[str, ...] = ("left", "right", "scale")

    def start(self, seed: int) -> State:
        rng = np.random.default_rng(seed)
        left, right = (rng.normal(size=(n, self.width)) / math.sqrt(n) for n in self.inputs)
        none = np.zeros((0, self.width))
        return {"left": left, "right": right, "scale": np.array([math.log(self.scale)]), "slow_left": left, "slow_right": right, "queue_left": none, "queue_right": none}

    def group(self, rows: int, epoch: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(epoch), F.lit(seed)), F.lit(max(1, -(-rows // self.batch))))

    def gradient(self, state: State, columns: list[pa.Array]) -> tuple[float, State]:
        x = [_vectors(c, n) for c, n in zip(columns, self.inputs, strict=True)]
        (a, na), (b, nb) = (normed(v @ state[w]) for v, w in zip(x, ("left", "right"), strict=True))
        s, n = math.exp(float(state["scale"][0])), len(a)
        loss, grad_a, grad_b, grad_s = 0.0, np.zeros_like(a), np.zeros_like(b), 0.0
        for own, other, queue, go, to in ((a, b, state["queue_right"], grad_a, grad_b), (b, a, state["queue_left"], grad_b, grad_a)):
            keys = np.concatenate([other, queue])
            cosines = own @ keys.T
            logs = log_softmax(s * cosines)
            loss -= float(np.trace(logs[:, :n])) / (2 * n)
            error = np.exp(logs)
            error[np.arange(n), np.arange(n)] -= 1
            error /= 2 * n
            go += s * error @ keys
            to += s * error[:, :n].T @ own
            grad_s += s * float((error * cosines).sum())
        return loss, {"left": x[0].T @ through_norm(grad_a, a, na), "right": x[1].T @ through_norm(grad_b, b, nb), "scale": np.array([grad_s])}

    def after(self, state: State, step: DataFrame) -> None:
        state["scale"] = np.minimum(state["scale"], math.log(self.most_scale))
        for side in ("left", "right"):
            state[f"slow_{side}"] = self.momentum * state[f"slow_{side}"] + (1 - self.momentum) * state[side]
        if self.queue:
            last = step.select("left", "right").orderBy(F.xxhash64("id"), "id").limit(self.queue).toArrow()
            for side, n in zip(("left", "right"), self.inputs, strict=True):
                state[f"queue_{side}"] = normed(_vectors(last[side].combine_chunks(), n) @ state[f"slow_{side}"])[0]


class Distilled(NamedTuple):
    """Rows (id, left, right, teacher): a query, one of its candidates, and a teacher's score of it; the id is the query's. The softmax of the projections' scaled cosines over a query's candidates has to come near the teacher's (Kullback-Leibler divergence)."""

    inputs: tuple[int, int]
    width: int = 32
    scale: float = 10.0
    temperature: float = 1.0
    columns: tuple[str, ...] = ("left", "right", "teacher")
    weights: tuple[str, ...] = ("left", "right")

    def start(self, seed: int) -> State:
        rng = np.random.default_rng(seed)
        left, right = (rng.normal(size=(n, self.width)) / math.sqrt(n) for n in self.inputs)
        return {"left": left, "right": right}

    def group(self, rows: int, epoch: int, seed: int) -> Column:
        return F.col("id")

    def gradient(self, state: State, columns: list[pa.Array]) -> tuple[float, State]:
        x = [_vectors(c, n) for c, n in zip(columns, self.inputs, strict=False)]
        teacher = log_softmax(columns[2].to_numpy(zero_copy_only=False)[None, :] / self.temperature)[0]
        (a, na), (b, nb) = (normed(v @ state[w]) for v, w in zip(x, ("left", "right"), strict=True))
        own = log_softmax(self.scale * (a * b).sum(1)[None, :])[0]
        loss = float((np.exp(teacher) * (teacher - own)).sum())
        error = self.scale * (np.exp(own) - np.exp(teacher))[:, None]
        return loss, {"left": x[0].T @ through_norm(error * b, a, na), "right": x[1].T @ through_norm(error * a, b, nb)}

    def after(self, state: State, step: DataFrame) -> None:
        pass


def _fixed(x: np.ndarray) -> np.ndarray:
    return np.rint(x * 2.0**UNIT).astype(np.int64)


def summed(rows: DataFrame, groups: int) -> np.ndarray | None:
    """The sum of all rows' arrays `value` (longs of equal length): each task adds up what it has, and so on with FAN times fewer rows until one row comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = batch.column(0).flatten().to_numpy().reshape(len(batch), -1).sum(axis=0)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["value"])

    now, tasks = rows.select("value").mapInArrow(run, "value array<bigint>"), groups
    while tasks > 1:
        tasks = -(-tasks // FAN)
        now = now.repartition(tasks).mapInArrow(run, "value array<bigint>")
    found = now.collect()  # one row
    return np.array(found[0].value, np.int64) if found else None


def step_gradient(step: DataFrame, objective: Objective, state: State) -> tuple[float, int, State] | None:
    """(sum of losses, groups, sum of gradients) over a step's rows (group, the objective's columns); None without any."""
    names = objective.weights

    def run(table: pa.Table) -> pa.Table:
        # The order of adding within a group is that of its rows' ids and values.
        table = table.combine_chunks().sort_by([("id", "ascending"), ("place", "ascending")])
        loss, grads = objective.gradient(state, [table[c].combine_chunks() for c in objective.columns])
        value = np.concatenate([[loss, 1.0], *(grads[w].ravel() for w in names)])
        return pa.table({"value": pa.array([_fixed(value)], pa.list_(pa.int64()))})

    place = F.xxhash64(*objective.columns).alias("place")
    groups = step.select("group", "id", place, *objective.columns).groupBy("group").applyInArrow(run, "value array<bigint>")
    total = summed(groups, int(step.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if total is None:
        return None
    value, at, grads = total / 2.0**UNIT, 2, {}
    for w in names:
        grads[w] = value[at : at + state[w].size].reshape(state[w].shape)
        at += state[w].size
    return float(value[0]), round(value[1]), grads


def adam(state: State, grads: State, rate: float) -> None:
    state["adam_steps"] = state.get("adam_steps", np.zeros(1)) + 1
    t = float(state["adam_steps"][0])
    for w, g in grads.items():
        m = DECAY * state.get(f"adam_{w}", 0.0) + (1 - DECAY) * g
        v = DECAY_SQUARE * state.get(f"adam_square_{w}", 0.0) + (1 - DECAY_SQUARE) * g * g
        state[f"adam_{w}"], state[f"adam_square_{w}"] = m, v
        state[w] = state[w] - rate * (m / (1 - DECAY**t)) / (np.sqrt(v / (1 - DECAY_SQUARE**t)) + GUARD)


def save(spark: SparkSession, state: State, path: str) -> None:
    """A state as a table (name, width, at, values), a row for each row of each array."""
    rows = [(k, int(v.shape[-1]) if v.ndim else 1, v.ndim, i, row.tolist()) for k, v in state.items() for i, row in enumerate(v.reshape(-1, v.shape[-1] if v.ndim else 1))]
    rows += [(k, int(v.shape[-1]), v.ndim, -1, []) for k, v in state.items() if not v.size]
    spark.createDataFrame(rows, "name string, width int, dims int, at int, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> State:
    table = spark.read.parquet(path)
    if (n := table.agg(F.sum(F.size("values"))).first()[0] or 0) > MOST_WEIGHTS:
        raise ValueError(f"a state of {n} numbers; {MOST_WEIGHTS} are the most")
    found: dict[str, list] = {}
    for r in table.orderBy("name", "at").collect():
        found.setdefault(r.name, []).append(r)
    return {k: np.array([x for r in rows for x in r["values"]], float).reshape((-1, rows[0].width) if rows[0].dims == 2 else (-1,)) for k, rows in found.items()}


def checkpoints(spark: SparkSession, store: str) -> DataFrame:
    """(name) of the committed checkpoints below a folder, of which there is one an epoch."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(conf)
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    done = [(n,) for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/_SUCCESS"))]
    return spark.createDataFrame(done, "name string")


def train(rows: DataFrame, objective: Objective, store: str, epochs: int = 10, steps: int = 4, rate: float = 0.01, seed: int = 1, evaluate: Callable[[State], float] | None = None) -> State:
    """Train on rows (id and the objective's columns) and give the last state. `store` has checkpoint-<epoch> after each epoch and metrics/epoch=<epoch> with its mean loss and what `evaluate` says; a run with the same store goes on after the last
    checkpoint. Rows with a null are left out; rows that repeat an id are rows of their own. Without rows the state stays as it began."""
    spark = rows.sparkSession
    clean = rows.select("id", *objective.columns).dropna()
    last = latest_checkpoint(spark, checkpoints(spark, store)).first().checkpoint
    state = load(spark, f"{store}/{last}") if last else objective.start(seed)
    n = clean.count()
    for epoch in range(int(last.rpartition("-")[2]) if last else 0, epochs):
        folder = scratch_folder(spark)
        dealt = clean.withColumn("group", objective.group(n, epoch, seed))
        dealt = dealt.withColumn("step", F.pmod(F.xxhash64("group", F.lit(epoch)), F.lit(steps)).cast("int"))
        dealt.write.partitionBy("step").parquet(folder)
        whole, loss, groups = spark.read.schema(dealt.schema).parquet(folder), 0.0, 0
        for k in range(steps if n else 0):
            step = whole.filter(F.col("step") == k)  # a folder
            found = step_gradient(step, objective, state)
            if found is not None:
                loss, groups = loss + found[0], groups + found[1]
                adam(state, {w: g / found[1] for w, g in found[2].items()}, rate)
                objective.after(state, step)
        remove(spark, folder)
        score = None if evaluate is None else float(evaluate(state))
        spark.createDataFrame([(loss / max(1, groups), score)], "loss double, score double").write.mode("overwrite").parquet(f"{store}/metrics/epoch={epoch + 1}")
        save(spark, state, f"{store}/checkpoint-{epoch + 1}")
    return state


def best_checkpoint(spark: SparkSession, store: str) -> str:
    """The checkpoint with the highest score, of equals the first."""
    best = spark.read.parquet(f"{store}/metrics").orderBy(F.desc("score"), "epoch").first()
    return f"checkpoint-{best.epoch}"


def projected(rows: DataFrame, vector: str, weights: np.ndarray, out: str = "embedding") -> DataFrame:
    """Add the projection of a vector column, of length one."""
    inputs = weights.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = normed(_vectors(batch.column(batch.schema.get_field_index(vector)), inputs) @ weights)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(value), pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{out}` array<double>")

"""Gradients against differences, runs that go on, and what is learned on planted pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basalt.operators import learning as L
from basalt.operators import vectors


def lists(x):
    return pa.array(x.tolist(), pa.list_(pa.float64()))


@pytest.mark.parametrize("objective", [L.Contrastive((5, 4), width=3), L.Distilled((5, 4), width=3, temperature=2.0)])
def test_gradients_are_differences(objective):
    r = np.random.default_rng(2)
    state = objective.start(3)
    if "queue_left" in state:
        state["queue_left"], state["queue_right"] = (L.normed(r.normal(size=(6, 3)))[0] for _ in range(2))
    columns = [lists(r.normal(size=(7, 5))), lists(r.normal(size=(7, 4))), pa.array(r.normal(size=7))]
    _, grads = objective.gradient(state, columns[: len(objective.columns)])
    for w in objective.weights:
        for at in np.ndindex(state[w].shape):
            losses = []
            for sign in (1, -1):
                moved = state[w].copy()
                moved[at] += sign * 1e-6
                losses.append(objective.gradient(state | {w: moved}, columns[: len(objective.columns)])[0])
            assert grads[w][at] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=1e-6)


def planted(spark, n=400, size=12):
    r = np.random.default_rng(5)
    x, turn = r.normal(size=(n, size)), r.normal(size=(size, size))
    rows = [(i, x[i].tolist(), (x[i] @ turn + 0.05 * r.normal(size=size)).tolist(), "clash") for i in range(n)]
    return spark.createDataFrame(rows, "id long, left array<double>, right array<double>, step string")


def recall(spark, state, held):
    left, right = L.projected(held, "left", state["left"], "u"), L.projected(held, "right", state["right"], "u")
    found = vectors.search(left, right.withColumnRenamed("id", "other"), "id", "other", "u", 1)
    return found.filter("id = other").count() / held.count()


def test_dual_encoder(spark, tmp_path):
    pairs = planted(spark)
    held, known = pairs.filter("id % 5 = 0"), pairs.filter("id % 5 <> 0").unionByName(spark.createDataFrame([(None, [1.0] * 12, [1.0] * 12, ""), (3, None, [1.0] * 12, "")], pairs.schema))
    objective = L.Contrastive((12, 12), width=12, batch=80, queue=40)
    before = recall(spark, objective.start(1), held)
    state = L.train(known, objective, str(tmp_path / "s"), epochs=9, steps=2, rate=0.05, evaluate=lambda s: -float(np.abs(s["left"]).mean()))
    losses = [x.loss for x in spark.read.parquet(str(tmp_path / "s/metrics")).orderBy("epoch").collect()]
    assert losses[-1] < losses[0] / 3 and before < 0.2 and recall(spark, state, held) >= 0.9
    assert len(state["queue_left"]) == 40 and L.best_checkpoint(spark, str(tmp_path / "s")).startswith("checkpoint-")


def test_a_run_goes_on_with_equal_weights(spark, tmp_path):
    pairs = planted(spark, 90)
    objective = L.Contrastive((12, 12), width=4, batch=30, queue=8)
    whole = L.train(pairs, objective, str(tmp_path / "a"), epochs=3, steps=2)

    def killed(state):
        raise KeyboardInterrupt

    L.train(pairs, objective, str(tmp_path / "b"), epochs=1, steps=2)
    with pytest.raises(KeyboardInterrupt):  # ends within the second epoch, before its checkpoint
        L.train(pairs, objective, str(tmp_path / "b"), epochs=3, steps=2, evaluate=killed)
    again = L.train(pairs.repartition(5, "id"), objective, str(tmp_path / "b"), epochs=3, steps=2)
    assert whole.keys() == again.keys() and all((whole[k] == again[k]).all() for k in whole)
    assert L.train(pairs.limit(0), objective, str(tmp_path / "c"), epochs=1)["left"].tolist() == objective.start(1)["left"].tolist()


def test_distilled_ranker(spark, tmp_path):
    r = np.random.default_rng(6)
    size, rows = 8, []
    turn = r.normal(size=(size, size))
    for q in range(120):
        x = r.normal(size=size)
        for c in range(5):
            y = r.normal(size=size)
            rows.append((q, c, x.tolist(), y.tolist(), float(x @ turn @ y)))
    df = spark.createDataFrame(rows, "id long, candidate int, left array<double>, right array<double>, teacher double")
    held, known = df.filter("id % 4 = 0"), df.filter("id % 4 <> 0")

    def top(ranked):
        best = held.groupBy("id").agg(F.max_by("candidate", "teacher").alias("best"))
        return ranked.filter("rank = 1").join(best, "id").filter("candidate = best").count() / 30

    state = L.train(known, L.Distilled((size, size), width=8), str(tmp_path / "s"), epochs=8, steps=2, rate=0.05)
    mine = L.projected(L.projected(held, "left", state["left"], "u"), "right", state["right"], "v")
    assert top(vectors.rerank(mine, "id", "candidate", "u", "v", 1)) > top(vectors.rerank(held, "id", "candidate", "left", "right", 1)) + 0.2


def test_sums_don_t_depend_on_order(spark):
    r = np.random.default_rng(1)
    values = L._fixed(r.normal(size=(50, 4)) * 1000)
    df = spark.createDataFrame([(v.tolist(),) for v in values], "value array<bigint>")
    for parts in (1, 3, 17):
        assert L.summed(df.repartition(parts), 17).tolist() == values.sum(axis=0).tolist()
    assert L.summed(df.limit(0), 4) is None

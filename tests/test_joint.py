"""Joint training: gradients by finite differences, its log, and checks that a broken model fails."""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentika.operators import joint as T
from sentika.operators.metrics import best_checkpoint, log_loss
from sentika.plans import catalog
from sentika.plans.jobs import training_curves_table
from sentika.sources.files import scan_training_log

ASPECTS = ["A", "B"]
CONFIG = T.JointConfig(num_features=32, epochs=3, batches=2, rate=0.2)


@pytest.fixture(scope="module")
def labeled(spark):
    words = {"A": "alpha apple", "B": "beta berry", "Positif": "good", "Negatif": "bad", "Netral": "so"}
    rows = []
    for i in range(240):
        aspects = [a for a, on in zip(ASPECTS, (i % 2, i % 3 == 0)) if on] or ["GENERAL"]
        mood = ["Positif", "Negatif", "Netral"][(i // 2) % 3]
        text = " ".join([words.get(a, "other") for a in aspects] + [words[mood]] * 2 + [f"x{i % 11}"])
        rows.append((f"r{i}", text if i % 40 else None, aspects, mood))
    return spark.createDataFrame(rows, "review_id string, clean_text string, aspects array<string>, sentiment_rule string")


@pytest.fixture(scope="module")
def run(labeled):
    return T.JointTraining(labeled, ASPECTS, CONFIG, "review_id", "clean_text")


def test_gradient_equals_finite_differences(run):
    rnd = np.random.default_rng(3)
    weights = rnd.normal(0, 0.5, (33, 8))
    gradient, loss = run.gradient(weights, 1)
    hashed = [r.hashed for r in run.rows.where("split = 'train' AND batch = 1").collect()]
    used = sorted({f for h in hashed for f in h or ()})
    for f, k in [(used[0], 0), (used[1], 1), (used[2], 3), (used[-1], 7), (32, 0), (32, 5)]:
        around = []
        for step in (1e-5, -1e-5):
            moved = weights.copy()
            moved[f, k] += step
            around.append(run.gradient(moved, 1)[1])
        assert gradient[f, k] == pytest.approx((around[0] - around[1]) / 2e-5, rel=1e-4, abs=1e-7)
    unused = [f for f in range(32) if f not in used]
    assert np.abs(gradient[unused]).sum() == 0 and loss > 0


def test_loss_equals_that_of_the_scored_rows(run):
    """Masked, weighted by class, and the same whether tasks sum it or SQL does."""
    weights = np.random.default_rng(5).normal(0, 0.5, (33, 8))
    model = run.model(weights)
    heads = F.arrays_zip("aspect_true", F.col("aspect_probs").alias("aspect_prob"), "sentiment_true", "sentiment_probs")
    scored = model.transform(run.rows.where("split = 'train'").drop("hashed")).select(F.explode(heads).alias("h")).select("h.*")
    assert scored.where("sentiment_true = -1").count() > 50
    assert log_loss(scored, run.of_class).first().total_loss == pytest.approx(run.gradient(weights)[1])
    assert run.gradient(np.zeros((33, 8)))[1] == pytest.approx(math.log(2) + math.log(3))


def test_training_keeps_the_best_epoch_and_writes_its_log(spark, run, tmp_path):
    trained = run.run()
    log = training_curves_table(scan_training_log(spark, trained.log_path)).collect()
    assert [r.epoch for r in log] == [1, 2, 3]
    assert log[-1].train_loss < log[0].train_loss < math.log(2) + math.log(3) + 0.1
    assert trained.best.first() == best_checkpoint(trained.log).first()
    assert trained.model is trained.checkpoints[trained.best.first().epoch - 1]
    assert run.gradient(trained.model.weights)[1] < run.gradient(np.zeros((33, 8)))[1] - 0.1
    path = str(tmp_path / "joint")
    trained.model.save(spark, path)
    again = T.JointModel.load(spark, path, ASPECTS)
    df = spark.createDataFrame([("a", "beta berry bad"), ("b", None), ("c", "")], "id string, clean_text string")
    a, b = trained.model.transform(df).collect(), again.transform(df).collect()
    assert a == b and a[1].aspect_probs == a[2].aspect_probs
    assert a[0].aspect_probs[1] > a[1].aspect_probs[1] and a[0].aspect_probs[0] < a[1].aspect_probs[0]


def test_the_same_run_gives_the_same_weights(labeled, run):
    again = T.JointTraining(labeled.repartition(5), ASPECTS, CONFIG, "review_id", "clean_text")
    weights = np.ones((33, 8))
    np.testing.assert_allclose(run.gradient(weights, 0)[0], again.gradient(weights, 0)[0], atol=1e-12)


def test_checks_fail_on_a_model_that_did_not_learn(spark, monkeypatch):
    monkeypatch.setattr(catalog, "JOINT", dataclasses.replace(catalog.JOINT, rate=1e-12, epochs=2))
    loss = {r["loss"]: r.below_constant for r in catalog.joint_training_loss(spark, "/root/testdata/sf0.001").collect()}
    assert loss["total_loss"] is False


def test_a_task_works_on_few_words_at_a_time():
    import pyarrow as pa

    lists = pa.array([[1] * 1000] * 300 + [[2] * 100_000, [], [3]], pa.list_(pa.int32()))
    batch = pa.record_batch([lists, pa.array(range(len(lists)))], ["hashed", "id"])
    cut = list(T._pieces(batch, batch.column(0)))
    assert [i for b in cut for i in b.column(1).to_pylist()] == list(range(303))
    assert max(len(b.column(0).flatten()) - len(b.column(0)[0]) for b in cut) <= T._WORDS and len(cut) > 9


def test_sums_are_counted_not_added_entry_by_entry(monkeypatch):
    from types import SimpleNamespace

    rnd = np.random.default_rng(4)
    row, feature, value = np.sort(rnd.integers(0, 5, 60)), rnd.integers(0, 9, 60), rnd.random(60)
    weights = rnd.random((9, 8))
    want = np.zeros((6, 8))
    np.add.at(want, row, weights[feature] * value[:, None])
    monkeypatch.setattr(T, "np", SimpleNamespace(**{**vars(np), "add": None}))
    assert (T.logits((row, feature, value), 6, weights) == want).all()

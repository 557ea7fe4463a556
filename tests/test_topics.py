"""Topics of texts: steps and costs against dense NumPy, the kept start, terms, edges."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentika.operators import topics as K

CONFIG = K.TopicConfig(k=3, starts=4, epochs=2, batches=2, num_features=64)
GROUPS = ["sun sea sand beach", "code bug test build", "bread milk cheese egg"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(GROUPS[i % 3].split(), 6)), "extra") for i in range(150)]
    rows += [(900, None, "x"), (901, "  ", "x"), (902, "", "x"), (903, "sun " * 40_000, "x")] + [(i, "sun sea", "y") for i in range(200, 260)]
    return spark.createDataFrame(rows, "id int, clean_text string, batch string")


@pytest.fixture(scope="module")
def training(texts):
    return K.TopicTraining(texts, "clean_text", CONFIG)


@pytest.fixture(scope="module")
def topics(training):
    return training.run()


def dense(training, rows):
    lists = pa.array([r.hashed for r in rows], pa.list_(pa.int32()))
    out = np.zeros((len(rows), CONFIG.num_features))
    for i, r in enumerate(rows):
        for f, n in Counter(r.hashed).items():
            out[i, f] = n * training.features.idf[f]
    assert len(lists) == len(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def test_step_equals_dense(training):
    centres, seen = np.random.default_rng(2).random((4, 3, 64)), np.full((4, 3), 2.0)
    moved, total = training.step(centres, seen, 1)
    x = dense(training, training.rows.where("batch = 1").collect())
    for s in range(4):
        near = ((x[:, None] - centres[s][None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(3):
            mine = x[near == c]
            assert total[s, c] == 2 + len(mine)
            want = (2 * centres[s, c] + (len(mine) * centres[s, c] + (mine - centres[s, c]).sum(axis=0))) / (2 + len(mine))
            assert moved[s, c] == pytest.approx(want, abs=1e-9)


def test_costs_and_kept_start(training, topics, texts):
    x = dense(training, training.rows.collect())
    c = topics.model.centres
    cost = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
    rows = topics.costs.collect()
    kept = [r for r in rows if r.kept]
    assert len(rows) == 4 and len(kept) == 1 and {r.texts for r in rows} == {211}
    assert kept[0].cost == pytest.approx(cost) and kept[0].cost == min(r.cost for r in rows)
    again = K.cost_by_join(texts, topics.model, "id").first()
    assert again.texts == 211 and again.cost == pytest.approx(cost) and again.cost < again.one_centre
    assert again.one_centre == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())


def test_counted_words_and_keys_that_repeat(spark, topics):
    rows = [("a", "sun sea sun"), ("b", "sea"), ("b", "sea sun"), (None, "sand"), (None, "sand sun"), ("c", ""), ("d", None), ("e", "x " * 9_000)]
    df = spark.createDataFrame(rows, "key string, clean_text string")
    of = {r.key: Counter({e.feature: e.n for e in r.entries}) for r in K.counted_words(df, "key", "clean_text", 64).collect()}
    hashed = df.select("key", K.hashed_words("clean_text", 64).alias("h")).collect()
    want = {k: sum((Counter(r.h) for r in hashed if r.key == k), Counter()) for k in ["a", "b", None, "c", "d", "e"]}
    assert {k: c for k, c in of.items() if c} == {k: c for k, c in want.items() if c}
    single = K.counted_words(df.where("key IN ('a', 'e')"), "key", "clean_text", 64).collect()
    assert all(Counter({e.feature: e.n for e in r.entries}) == want[r.key] for r in single) and len(single) == 2
    joined = df.groupBy("key").agg(F.concat_ws(" ", F.collect_list("clean_text")).alias("clean_text")).fillna("none", "key")
    once, again = (K.cost_by_join(d, topics.model, "key").first() for d in (joined, df))
    assert again.texts == once.texts and again.cost == pytest.approx(once.cost)


def test_words_of_texts_are_not_shuffled(spark, topics, texts):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(K.cost_by_join(texts, topics.model, "id")))
    assert moved and not [by for by in moved if "," in by] and "SortMergeJoin" not in plan(K.cost_by_join(texts, topics.model, "id"))
    assert "Exchange" not in plan(K.counted_words(texts, "id", "clean_text", 64))


def test_groups_are_found_and_broken_centres_cost_more(topics, texts):
    of = {r.id: r.cluster_id for r in topics.model.assign(texts).collect()}
    assert len({(i % 3, of[i]) for i in range(150)}) == 3 == len({of[i] for i in range(3)})
    broken = K.TopicModel(topics.model.features, topics.model.centres[[0, 0, 0]], "clean_text")
    assert K.cost_by_join(texts, broken, "id").first().cost > 1.2 * K.cost_by_join(texts, topics.model, "id").first().cost


def test_edges_of_assignment(topics, texts):
    rows = {r.id: r for r in topics.model.assign(texts).collect()}
    assert len(rows) == 214 and list(rows[0].asDict()) == ["id", "clean_text", "batch", "cluster_id", "topic_distance"]
    assert all(rows[i].cluster_id is None and rows[i].topic_distance is None for i in (900, 901, 902))
    assert rows[903].cluster_id is not None and len({rows[i].cluster_id for i in range(200, 260)}) == 1
    with pytest.raises(ValueError):
        K.fit_text_topics(texts.where("id >= 900 AND id < 903"), config=CONFIG)
    assert topics.model.assign(texts.where("false")).count() == 0


def test_terms_are_counted(topics, texts):
    assigned = topics.model.assign(texts)
    counts: dict[int, Counter] = {}
    for r in assigned.where("cluster_id IS NOT NULL").collect():
        counts.setdefault(r.cluster_id, Counter()).update(r.clean_text.split())
    want = {(c, t, n) for c, terms in counts.items() for t, n in sorted(terms.items(), key=lambda x: (-x[1], x[0]))[:2]}
    assert {(r.cluster_id, r.term, r.n) for r in K.topic_terms(assigned, 2).collect()} == want


def test_saved_model_assigns_alike(spark, topics, texts, tmp_path):
    topics.model.save(spark, str(tmp_path / "m"))
    again = K.TopicModel.load(spark, str(tmp_path / "m"))
    assert {r.id: r.cluster_id for r in again.assign(texts).collect()} == {r.id: r.cluster_id for r in topics.model.assign(texts).collect()}

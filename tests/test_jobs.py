from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from small_lexicon import SMALL

from sentika.functions.labels import label_reviews
from sentika.lexicons.sample import sample_lexicon
from sentika.operators import models as ML
from sentika.plans import jobs
from sentika.plans import sample_views as V
from sentika.schemas import LANDING, RAW
from sentika.session import scratch_path, shared_root
from sentika.sources import files
from sentika.streaming import streams as Z

SF = "/root/testdata/sf0.001"
LEXICON = sample_lexicon()

# Reviews and what rule scoring says about them.
DEMO = [
    ("Gr8 and EASY shop!!! With a clear menu", "EASE=Positif | DELIVERY=Positif"),
    ("Offlineeee? It is <b>offlinee</b> since Monday, I am angry", "UPTIME=Negatif"),
    ("thx parcel arrived but the app will krash when I type my PIN", "UPTIME=Positif | DELIVERY=Positif | TRUST=Positif"),
    ("Locked out... awful", "UPTIME=Negatif | TRUST=Negatif"),
    ("Good morning to all", "GENERAL=Netral"),
    (None, "GENERAL=Netral"),
]


def test_rule_scoring_of_demo_reviews(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(DEMO)], "id int, review_text string")
    rows = ML.score_reviews_rules(df, SMALL).orderBy("id").collect()
    assert [r.summary for r in rows] == [s for _, s in DEMO]
    assert set(rows[0].confidence.values()) == {0.0}


def test_csv_keeps_awkward_text(spark):
    texts = ['say "hi", ok', "two\nlines", "  padded  ", "NA", "back\\slash", 'end"', "é☀️", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "review_id string, review_text string")
    path = scratch_path(spark, "csv-test")
    files.write_csv(jobs.conform_schema(df, RAW), path)
    got = {r.review_id: r.review_text for r in files.scan_reviews_csv(spark, path).collect()}
    assert got == {str(i): t for i, t in enumerate(texts)}


def test_csv_with_byte_order_mark(spark):
    path = scratch_path(spark, "bom").removeprefix("file:")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write('review_id,username,user_image_url,review_text,rating\na,u,,"x ""y""\nz",5\n')
    row = files.scan_reviews_csv(spark, path, RAW).select("review_id", "review_text", "rating").first()
    assert tuple(row) == ("a", 'x "y"\nz', 5)


def test_collection_keeps_the_first_feed(spark):
    paths = []
    for name, rows in (("a", [("1", "first feed text", 5)]), ("b", [("1", "second", 1), ("2", "short", 2), ("3", "long enough", 3)])):
        path = scratch_path(spark, f"feed-{name}")
        files.write_json(spark.createDataFrame(rows, "reviewId string, content string, score int"), path)
        paths.append(path)
    rows = jobs.structure_reviews(jobs.ingest_pages(spark, paths)).orderBy("review_id").collect()
    assert [(r.review_id, r.review_text, r.sentiment_label_naive) for r in rows] == [
        ("1", "first feed text", "Positif"), ("3", "long enough", "Netral"),
    ]
    assert {r.review_id for r in jobs.ingest_pages(spark, paths, cap=2).collect()} == {"1", "2"}


def test_report_document(spark):
    labeled = label_reviews(V.cleaned(spark, SF), LEXICON)
    rows = jobs.report_rows(labeled, V.ASPECTS, {"r2": 0.5, "alpha": 1.0})
    doc = json.loads(jobs.report_document(rows, "t", "p", "s").first().report)
    assert doc["dataset"]["total_ulasan"] == 200
    assert sum(doc["dataset"]["distribusi_rating"].values()) == 200 - 12
    assert set(doc["distribusi_sentimen_per_aspek"]) == set(V.ASPECTS)
    for moods in doc["distribusi_sentimen_per_aspek"].values():
        assert sum(m["pct"] for m in moods.values()) == pytest.approx(100, abs=0.05)
    assert doc["regresi_ridge"] == {"r2": 0.5, "alpha": 1.0}
    assert set(doc["rekomendasi_strategis"]["PRIVACY"]) == {"status", "neg_pct", "pos_pct"}


def test_train_save_load_score(spark):
    config = ML.TrainingConfig(num_features=1 << 10, max_iter=3, reg_params=(0.1,))
    trained = ML.train_evaluate(V.labeled(spark, SF), V.ASPECTS, config)
    scores = trained.test_metrics.first()
    assert 0 < scores.combined_f1 <= 1
    assert trained.test_f1_per_aspect.count() <= len(V.ASPECTS)
    path = scratch_path(spark, "model-test")
    ML.save_model(trained.model, path)
    reviews = V.reviews(spark, SF)
    one = ML.score_reviews(reviews, trained.model, LEXICON).orderBy("doc_id").collect()
    two = ML.score_reviews(reviews, ML.load_model(path), LEXICON).orderBy("doc_id").collect()
    assert [r.summary for r in one] == [r.summary for r in two]
    for r in one:
        assert set(r.confidence) == set(V.ASPECTS)
        found = [a for a in V.ASPECTS if a in r.sentiments]
        assert r.aspects == (found or ["GENERAL"])
        assert all((r.confidence[a] >= 0.5) == (a in found) for a in V.ASPECTS if abs(r.confidence[a] - 0.5) > 1e-4)


def test_kmeans_finds_separate_groups(spark):
    rows = [(i, [float(i % 3 * 10 + i / 1000), float(i % 3)]) for i in range(90)]
    found = ML.kmeans_topics(spark.createDataFrame(rows, "id int, embedding array<double>"), k=3).collect()
    groups = {(r.id % 3, r.cluster_id) for r in found}
    assert len(groups) == 3 and len({c for _, c in groups}) == 3


def test_streams_equal_batch(spark):
    documents = V.table(spark, SF, "documents")
    folder = scratch_path(spark, "stream-in")
    documents.repartition(4).write.parquet(folder)
    stream = V.as_reviews(Z.read_table_stream(spark, folder, documents.schema, per_batch=1))
    labeled = Z.stream_score(stream, LEXICON)
    out = Z.run_available(labeled.select("review_id", "aspects", "sentiment_rule"), "stream-test")
    batch = label_reviews(V.cleaned(spark, SF), LEXICON)
    key = lambda df: sorted((r.review_id, tuple(r.aspects), r.sentiment_rule) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(batch)

    counts = Z.stream_aspect_counts(labeled, "review_date", lateness="60 days")
    flat = counts.select(F.col("window.start").alias("day"), "aspect", "sentiment", "n")
    latest = Z.latest_updates(
        spark, Z.run_available(flat, "counts-test", mode="update", timeout=600), ["day", "aspect", "sentiment"], "n"
    )
    every = Z.count_available(labeled, "batch-counts-test", "review_date", timeout=600)
    summed = Z.summed_batches(spark, every, ["window", "aspect", "sentiment"], "n").select(
        F.col("window.start").alias("day"), "aspect", "sentiment", "n"
    )
    assert len({r.batch for r in spark.read.parquet(every).select("batch").distinct().collect()}) >= 4
    twin = (
        batch.select(F.date_trunc("day", "review_date").alias("day"), F.explode("aspects").alias("aspect"), "sentiment_rule")
        .groupBy("day", "aspect", "sentiment_rule")
        .count()
    )
    expected = sorted(map(tuple, twin.collect()))
    assert sorted(map(tuple, latest.collect())) == expected
    assert sorted(map(tuple, summed.collect())) == expected


def test_stream_dedup_across_batches(spark):
    folder = scratch_path(spark, "dedup-in")
    rows = spark.range(100).selectExpr(
        "cast(id % 30 as string) reviewId", "concat('text ', id % 30) content", "timestamp_seconds(1704067200 + id) at"
    )
    files.write_json(rows.repartition(5), folder)
    stream = jobs.conform_schema(Z.read_json_stream(spark, folder, LANDING, per_batch=1), RAW)
    out = Z.run_available(Z.stream_dedup(stream, "7 days").select("review_id", "review_text"), "dedup-test")
    got = spark.read.parquet(out).collect()
    assert len(got) == 30 and {r.review_id for r in got} == {str(i) for i in range(30)}


def test_shared_root_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_root(spark) == configured.rstrip("/")


def test_flagship_job_has_one_narrow_scan(spark):
    plan = jobs.sentiment_by_aspect(V.reviews(spark, SF), LEXICON)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan


def test_filters_reach_the_scan_through_the_label_job(spark):
    labeled = jobs.label_job(V.table(spark, SF, "documents").withColumnRenamed("text", "review_text").withColumn("rating", F.lit(3)), LEXICON)
    plan = labeled.where("n_chars > 500 and lang = 'en'")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThan(n_chars,500)" in pushed and "EqualTo(lang,en)" in pushed


def test_label_job_starts_no_job_before_an_action(spark):
    tracker = spark.sparkContext.statusTracker()
    collected = jobs.dedup_keep_first(V.reviews(spark, SF), "review_id", ["review_text"])
    spark.sparkContext.setJobGroup("label-job-test", "")
    jobs.label_job(jobs.structure_reviews(collected), LEXICON)
    started = list(tracker.getJobIdsForGroup("label-job-test"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not started


def test_scoring_refuses_to_overwrite_its_input(spark):
    with pytest.raises(ValueError):
        jobs.score_file(spark, "/tmp/a", "/tmp/a/", LEXICON)


def test_models_read_every_word(spark):
    words = [f"w{k}" for k in range(300)]
    df = spark.createDataFrame([(" ".join(words),)], "clean_text string")
    row = ML.tfidf_pipeline().fit(df).transform(df).select("tokens").first()
    assert row.tokens == words


def test_heads_score_in_a_session_that_observed_a_query(spark):
    """A summary of training, kept by a head, would carry the session into the tasks."""
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import Observation

    spark.range(3).observe(Observation("seen"), F.count(F.lit(1)).alias("n")).collect()
    rows = [(Vectors.dense([float(k % 2), float(k)]), [k % 2]) for k in range(20)]
    features = spark.createDataFrame(rows, ["features", "aspect_true"])
    heads = ML.fit_aspect_heads(features, ["a"], ML.TrainingConfig(max_iter=3), 0.1)
    assert len(ML.PipelineModel(heads).transform(features).select("aspect_pred_0").collect()) == 20


def test_no_csv_file_is_too_much_for_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_ROWS", 10)
    files.write_csv(spark.range(95).coalesce(1).selectExpr("cast(id as string) as review_id"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.csv"))) == 10
    assert files.scan_reviews_csv(spark, str(tmp_path / "out")).count() == 95


def test_term_weights_compute_their_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    rows = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "review_id int, t string")
    got = ML.term_weights(rows.select("review_id", counted.asNondeterministic()("t").alias("clean_text"))).collect()
    assert {(r.review_id, r.term, r.tf) for r in got} == {(1, "a", 2), (1, "b", 1), (2, "b", 1), (2, "c", 1)}
    assert seen.value == 3


def test_reports_and_topics_label_their_texts_once(spark, tmp_path, monkeypatch):
    """What was written is read by all that follows."""
    from sentika.plans import catalog

    calls = []
    labeled = V.labeled
    monkeypatch.setattr(V, "labeled", lambda *a: calls.append("labeled") or labeled(*a))
    written = []
    real = catalog._written
    monkeypatch.setattr(catalog, "_written", lambda df, name: written.append(name) or real(df, name))
    rows = [(k, f"thing {k} then trash of the word{k % 5}", "en", "s") for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert catalog.report_regression(spark, str(tmp_path)).count() == 4
    assert catalog.text_topic_terms(spark, str(tmp_path)).count() > 5
    assert calls == ["labeled"] and written == ["labels", "cleaned"]


def test_features_compute_their_texts_once(spark, monkeypatch):
    """Hashed words are written by the pass that makes the texts; weights are fitted on them."""
    from sentika.plans import catalog

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    rows = [(str(k), f"word{k % 3} other word{k % 3}", ["GENERAL"], "Netral") for k in range(12)]
    df = spark.createDataFrame(rows, "review_id string, t string, aspects array<string>, sentiment_rule string")
    df = df.withColumn("clean_text", counted.asNondeterministic()("t"))
    monkeypatch.setattr(V, "labeled", lambda *a: df)
    got = {r.review_id: r.features for r in catalog._featurised(spark, "").collect()}
    assert seen.value == 12
    want = ML.tfidf_pipeline(config=catalog.TRAINING).fit(df).transform(df).select("review_id", "features").collect()
    assert got == {r.review_id: r.features for r in want}


def test_scoring_reads_the_texts_that_training_read(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from sentika.plans import catalog

    class Seen(Exception):
        pass

    def score(df, model, lexicon, **more):
        raise Seen(model, df.inputFiles(), more)

    trained = []
    monkeypatch.setattr(ML, "train_evaluate", lambda df, *a: trained.append(df.inputFiles()) or SimpleNamespace(model="m"))
    monkeypatch.setattr(ML, "save_model", lambda *a: None)
    monkeypatch.setattr(ML, "score_reviews", score)
    rows = [(k, f"thing {k} then trash", "en", "s") for k in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for query in (catalog.score_reviews, catalog.save_load_model):
        with pytest.raises(Seen) as found:
            query(spark, str(tmp_path))
        assert found.value.args == ("m", trained[-1], {"cleaned": True})

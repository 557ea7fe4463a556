"""Aspect and sentiment models on ``pyspark.ml``.

One binary logistic regression per aspect says whether a review is about it; one
three-class regression per aspect, trained on the reviews that carry the aspect,
says how it is judged. All heads share one text feature.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentika.functions.labels import (
    aspect_multihot,
    aspect_sentiment_ids,
    detect_aspects,
    detect_sentiment,
    lexicon_hits,
    passes_threshold,
    round_half_even,
    summary_string,
)
from sentika.functions.text import SPACE, clean_reviews, words
from sentika.lexicons import GENERAL, SENTIMENTS, Lexicon
from sentika.operators.distributions import class_weights
from sentika.operators.metrics import best_checkpoint, combined_f1, long_labels, sentiment_f1_per_aspect
from sentika.operators.selection import train_val_test_split
from sentika.session import scratch_path


@dataclass(frozen=True)
class TrainingConfig:
    num_features: int = 1 << 16
    max_iter: int = 20
    reg_params: Sequence[float] = (0.0, 0.01, 0.1)
    seed: int = 42
    weights_from: str = "train"  # or "all": count every labelled row
    parallelism: int = 4  # heads fitted at the same time


def tfidf_pipeline(text_col: str = "clean_text", config: TrainingConfig = TrainingConfig()) -> Pipeline:
    """All words of the text as hashed TF-IDF in ``features``."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text_col, outputCol="tokens", pattern=rf"[{SPACE}]+"),
            HashingTF(inputCol="tokens", outputCol="counts", numFeatures=config.num_features),
            IDF(inputCol="counts", outputCol="features"),
        ]
    )


def write_features(
    rows: DataFrame, kept: Sequence[str], text_col: str, config: TrainingConfig, fit_on: str = "true", partition_by: Sequence[str] = ()
) -> tuple[PipelineModel, DataFrame]:
    """The text model, its weights fitted on the rows that meet ``fit_on``, and ``kept`` with ``features``.

    The pass that makes the texts also hashes their words and writes how often they occur; weights
    are fitted on that and applied to it, so no text is made or cut into words twice. Runs jobs."""
    spark = rows.sparkSession
    tokens, counts, idf = tfidf_pipeline(text_col, config).getStages()
    path = scratch_path(spark, "counts")
    PipelineModel([tokens, counts]).transform(rows.select(*kept, text_col)).select(*kept, "counts").write.parquet(path)
    counted = spark.read.parquet(path)
    weights = idf.fit(counted.where(fit_on).select("counts"))
    path = scratch_path(spark, "features")
    weights.transform(counted).select(*kept, "features").write.partitionBy(*partition_by).parquet(path)
    return PipelineModel([tokens, counts, weights]), spark.read.parquet(path)


def label_arrays(labeled: DataFrame, aspects: Sequence[str]) -> DataFrame:
    """Add ``aspect_true`` (0/1 per aspect) and ``sentiment_true`` (id or -1 per aspect)."""
    return labeled.withColumns(
        {
            "aspect_true": aspect_multihot(F.col("aspects"), aspects),
            "sentiment_true": aspect_sentiment_ids(F.col("aspects"), F.col("sentiment_rule"), aspects),
        }
    )


def fit_aspect_heads(
    features: DataFrame, aspects: Sequence[str], config: TrainingConfig, reg_param: float
) -> list[Model]:
    """One binary model per aspect on ``features`` and ``aspect_true``."""
    fits = []
    for i in range(len(aspects)):
        data = features.select("features", F.get("aspect_true", F.lit(i)).cast("double").alias("label"))
        head = LogisticRegression(
            maxIter=config.max_iter,
            regParam=reg_param,
            predictionCol=f"aspect_pred_{i}",
            probabilityCol=f"aspect_prob_{i}",
            rawPredictionCol=f"aspect_raw_{i}",
        )
        fits.append((head, data))
    return _fit_all(fits, config.parallelism)


def fit_sentiment_heads(
    features: DataFrame,
    aspects: Sequence[str],
    config: TrainingConfig,
    reg_param: float,
    weights: Mapping[int, float] | None = None,
) -> list[Model]:
    """One three-class model per aspect, on the rows that carry the aspect; an aspect
    that no row carries gets none."""
    counted = features.agg(
        *[F.count_if(F.get("aspect_true", F.lit(i)) == 1).alias(f"n_{i}") for i in range(len(aspects))]
    ).first()
    fits = []
    for i in range(len(aspects)):
        if not counted[f"n_{i}"]:
            continue
        label = F.get("sentiment_true", F.lit(i))
        weight = F.lit(1.0)
        if weights:
            weight = F.get(F.array(*[F.lit(weights[c]) for c in sorted(weights)]), label)
        data = features.where(label != -1).select(
            "features", label.cast("double").alias("label"), weight.alias("weight")
        )
        head = LogisticRegression(
            family="multinomial",
            maxIter=config.max_iter,
            regParam=reg_param,
            weightCol="weight",
            predictionCol=f"sentiment_pred_{i}",
            probabilityCol=f"sentiment_prob_{i}",
            rawPredictionCol=f"sentiment_raw_{i}",
        )
        fits.append((head, data))
    return _fit_all(fits, config.parallelism)


def _fit_all(fits: Sequence[tuple[LogisticRegression, DataFrame]], parallelism: int) -> list[Model]:
    """Fit independent heads at the same time: the jobs are Spark's, the threads only
    submit them, so one head's short stages fill the idle cores of another's.

    Heads are read back from shared storage: a fitted model keeps a summary that holds the
    session, and a session that ever observed a query cannot be sent to tasks."""
    session = fits[0][1].sparkSession if fits else None

    def fitted(fit: tuple[LogisticRegression, DataFrame]) -> Model:
        path = scratch_path(session, "head")
        fit[0].fit(fit[1]).write().save(path)
        return LogisticRegressionModel.load(path)

    with ThreadPool(max(1, min(parallelism, len(fits)))) as pool:
        run = inheritable_thread_target(session)(fitted)
        return pool.map(run, fits)


def prediction_arrays(scored: DataFrame, aspects: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Collect the heads' outputs: ``aspect_probs``, ``aspect_pred``, ``sentiment_pred``."""
    neutral = F.lit(SENTIMENTS.index("Netral"))

    def mood(i: int) -> Column:
        name = f"sentiment_pred_{i}"
        return F.col(name).cast("int") if name in scored.columns else neutral

    probs = F.array(*[vector_to_array(f"aspect_prob_{i}")[1] for i in range(len(aspects))])
    return scored.withColumn("aspect_probs", probs).withColumns(
        {
            "aspect_pred": F.transform("aspect_probs", lambda p: passes_threshold(p, threshold).cast("int")),
            "sentiment_pred": F.array(*[mood(i) for i in range(len(aspects))]),
        }
    )


def evaluate(scored: DataFrame, aspects: Sequence[str]) -> DataFrame:
    """aspect_f1_macro, sentiment_f1_avg and combined_f1 of scored, labelled rows."""
    return combined_f1(_long(scored, aspects))


def _long(scored: DataFrame, aspects: Sequence[str]) -> DataFrame:
    pairs = ("aspect_true", "sentiment_true"), ("aspect_pred", "sentiment_pred")
    return long_labels(prediction_arrays(scored, aspects), aspects, *pairs)


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    log: DataFrame
    best: DataFrame
    test_metrics: DataFrame
    test_f1_per_aspect: DataFrame


def train_evaluate(
    labeled: DataFrame,
    aspects: Sequence[str],
    config: TrainingConfig = TrainingConfig(),
    key: str = "review_id",
    text_col: str = "clean_text",
) -> Trained:
    """Split, weigh, fit every candidate penalty, keep the best on validation, test it.

    Runs jobs. Labels and features are written once to the shared scratch folder and
    read by every fit, so no fit cleans text again and a lost executor costs only the
    blocks it was reading.
    """
    spark = labeled.sparkSession
    rows = label_arrays(train_val_test_split(labeled, key, seed=config.seed), aspects)
    kept = [key, "split", "aspects", "sentiment_rule", "aspect_true", "sentiment_true"]
    text_model, table = write_features(rows, kept, text_col, config, "split = 'train'", ["split"])
    train, val, test = (table.where(F.col("split") == s) for s in ("train", "val", "test"))

    counted = train if config.weights_from == "train" else table
    weights = {r.sentiment_id: r.weight for r in class_weights(counted, aspects).collect()}
    candidates, entries = [], []
    for epoch, reg_param in enumerate(config.reg_params, 1):
        fitted = PipelineModel(
            [
                *fit_aspect_heads(train, aspects, config, reg_param),
                *fit_sentiment_heads(train, aspects, config, reg_param, weights),
            ]
        )
        scores = evaluate(fitted.transform(val), aspects).first()
        candidates.append(fitted)
        entries.append((epoch, float(reg_param), *(v or 0.0 for v in scores)))
    log = spark.createDataFrame(
        entries,
        "epoch int, reg_param double, aspect_f1_macro double, sentiment_f1_avg double, combined_f1 double",
    )
    best = best_checkpoint(log)
    row = best.first()
    if row is None:
        raise RuntimeError("no candidate reached a positive validation score")
    chosen = candidates[row.epoch - 1]
    scored = chosen.transform(test)
    return Trained(
        PipelineModel([*text_model.stages, *chosen.stages]),
        log,
        best,
        evaluate(scored, aspects),
        sentiment_f1_per_aspect(_long(scored, aspects)),
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---- scoring ----------------------------------------------------------------

PREDICTION_COLUMNS = ["clean_text", "aspects", "sentiments", "confidence", "summary"]


def score_reviews(
    df: DataFrame,
    model: PipelineModel,
    lexicon: Lexicon,
    threshold: float = 0.5,
    text_col: str = "review_text",
    cleaned: bool = False,
) -> DataFrame:
    """Clean and score new reviews: detected aspects or the general one, a sentiment
    for each detected aspect, a probability for every aspect, and a summary. Set ``cleaned``
    only for rows whose ``clean_text`` came out of the cleaning chain."""
    aspects = lexicon.aspect_names
    clean = df if cleaned else clean_reviews(df, text_col, slang=lexicon.slang)
    scored = prediction_arrays(model.transform(clean), aspects, threshold)
    names = F.array(*[F.lit(a) for a in aspects])
    moods = F.array(*[F.lit(s) for s in SENTIMENTS])
    found = F.array_compact(
        F.array(*[F.when(F.get("aspect_pred", F.lit(i)) == 1, F.lit(a)) for i, a in enumerate(aspects)])
    )
    judged = F.map_from_arrays(
        names,
        F.array(*[F.get(moods, F.get("sentiment_pred", F.lit(i))) for i in range(len(aspects))]),
    )
    rounded = F.transform("aspect_probs", lambda p: round_half_even(p, 4))
    return (
        scored.withColumn("aspects", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(GENERAL))))
        .withColumns(
            {
                "sentiments": F.map_filter(judged, lambda a, _: F.array_contains("aspects", a)),
                "confidence": F.map_from_arrays(names, rounded),
            }
        )
        .withColumn("summary", summary_string(F.col("aspects"), F.col("sentiments")))
        .select(*[c for c in df.columns if c not in PREDICTION_COLUMNS], *PREDICTION_COLUMNS)
    )


def score_reviews_rules(df: DataFrame, lexicon: Lexicon, text_col: str = "review_text") -> DataFrame:
    """Scoring without a model: lexicon aspects, the words' sentiment for each of
    them (the general one included), confidence 0."""
    clean = clean_reviews(df, text_col, slang=lexicon.slang)
    counted = lexicon_hits(clean, lexicon, cleaned=True)
    hits = {a: F.col(f"hits_{i}") for i, a in enumerate(lexicon.aspects)}
    mood = detect_sentiment(F.col("hits_positive"), F.col("hits_negative"))
    names = F.array(*[F.lit(a) for a in lexicon.aspects])
    return (
        counted.withColumn("aspects", detect_aspects(hits))
        .withColumns(
            {
                "sentiments": F.map_from_arrays("aspects", F.array_repeat(mood, F.size("aspects"))),
                "confidence": F.map_from_arrays(names, F.array_repeat(F.lit(0.0), F.lit(len(hits)))),
            }
        )
        .withColumn("summary", summary_string(F.col("aspects"), F.col("sentiments")))
        .select(*[c for c in df.columns if c not in PREDICTION_COLUMNS], *PREDICTION_COLUMNS)
    )


# ---- clusters ---------------------------------------------------------------

def fit_topics(df: DataFrame, embedding_col: str = "embedding", k: int = 8, seed: int = 42, max_iter: int = 20) -> Model:
    """K-means over an array column, fitted on all rows."""
    vectors = df.select(array_to_vector(F.col(embedding_col).cast("array<double>")).alias("__vector"))
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__vector", predictionCol="cluster_id").fit(vectors)


def assign_topics(df: DataFrame, model: Model, embedding_col: str = "embedding") -> DataFrame:
    """Add ``cluster_id``, the nearest centre of a fitted model."""
    vectors = df.withColumn("__vector", array_to_vector(F.col(embedding_col).cast("array<double>")))
    return model.transform(vectors).drop("__vector")


def kmeans_topics(
    df: DataFrame, embedding_col: str = "embedding", k: int = 8, seed: int = 42, max_iter: int = 20
) -> DataFrame:
    """Add ``cluster_id`` from k-means over an array column, fitted on all rows."""
    return assign_topics(df, fit_topics(df, embedding_col, k, seed, max_iter), embedding_col)


def own_centre_is_nearest(assigned: DataFrame, model: Model, embedding_col: str = "embedding") -> Column:
    """Whether no centre is nearer to a row than that of its cluster."""
    row = F.col(embedding_col).cast("array<double>")

    def distance(centre) -> Column:
        squares = F.zip_with(row, F.array(*[F.lit(float(x)) for x in centre]), lambda x, c: (x - c) * (x - c))
        return F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)

    distances = F.array(*[distance(c) for c in model.clusterCenters()])
    return F.get(distances, F.col("cluster_id")) <= F.array_min(distances) + 1e-9


# ---- checks of fitted models -------------------------------------------------

def beats_constant(scored: DataFrame, label: Column, probability: Column, classes: int) -> Column:
    """Aggregate: the log loss of ``probability`` (an array) is at most that of the class shares,
    give or take a hundredth a row, as a penalised fit never reaches a loss of zero."""
    p = F.when(label.isNotNull(), F.greatest(F.get(probability, label), F.lit(1e-15)))
    n = [F.count_if(label == c) for c in range(classes)]
    total = F.count(label)
    constant = sum((F.when(k > 0, -k * F.log(k / total)).otherwise(0.0) for k in n), F.lit(0.0))
    return F.coalesce(-F.sum(F.log(p)) <= constant + 0.01 * total, F.lit(True))


def term_weights(df: DataFrame, key: str = "review_id", text_col: str = "clean_text") -> DataFrame:
    """``key, term, tf, idf`` of every word of every text, without hashing: the weights that
    the models' features approximate. idf is ln((N + 1) / (df + 1)). Texts are written once, as
    terms, their frequency and the number of texts all read them."""
    path = scratch_path(df.sparkSession, "texts")
    rows = df.select(key, text_col)
    rows.write.parquet(path)
    df = df.sparkSession.read.schema(rows.schema).parquet(path)
    terms = df.select(key, F.explode(words(F.lower(F.col(text_col)))).alias("term"))
    tf = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    held = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = df.agg(F.count(F.lit(1)).alias("texts"))
    weighed = held.crossJoin(F.broadcast(n))  # one row
    return tf.join(weighed.select("term", F.log((F.col("texts") + 1.0) / (F.col("df") + 1)).alias("idf")), "term").select(
        key, "term", "tf", "idf"
    )

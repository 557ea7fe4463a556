"""Classification metrics from one long table.

The long table has one row per review and aspect with ``aspect, aspect_true,
aspect_pred`` (0/1) and ``sentiment_true, sentiment_pred`` (ids, -1 = aspect
absent). Every metric is read off a confusion count that Spark aggregates inside
each task first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentika.session import reliable_checkpoint


def long_labels(
    df: DataFrame, aspects: Sequence[str], true: tuple[str, str], pred: tuple[str, str], *keep: str
) -> DataFrame:
    """Unfold per-aspect arrays: ``true`` and ``pred`` name a multi-hot column and a
    sentiment-id column, each with one position per aspect."""
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("aspect"),
                F.get(true[0], F.lit(i)).cast("int").alias("aspect_true"),
                F.get(pred[0], F.lit(i)).cast("int").alias("aspect_pred"),
                F.get(true[1], F.lit(i)).cast("int").alias("sentiment_true"),
                F.get(pred[1], F.lit(i)).cast("int").alias("sentiment_pred"),
            )
            for i, a in enumerate(aspects)
        ]
    )
    return df.select(*keep, F.inline(rows))


def _f1(tp: Column, support: Column, predicted: Column) -> Column:
    """2tp / (true + predicted), 0 when nothing is true or predicted."""
    return F.coalesce(2.0 * tp / F.nullif(support + predicted, F.lit(0)), F.lit(0.0))


def outcome_counts(long: DataFrame) -> DataFrame:
    """Rows of the long table per combination of outcomes, as ``n``: a few dozen rows
    per aspect. Every metric accepts them in place of the long table."""
    keys = "aspect", "aspect_true", "aspect_pred", "sentiment_true", "sentiment_pred"
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _weight(long: DataFrame) -> Column:
    return F.col("n") if "n" in long.columns else F.lit(1)


def aspect_f1(long: DataFrame) -> DataFrame:
    """Binary F1 of each aspect."""
    t, p = F.col("aspect_true") == 1, F.col("aspect_pred") == 1
    n = _weight(long)
    sums = long.groupBy("aspect").agg(
        *[
            F.sum(F.when(cell, n).otherwise(0)).cast("bigint").alias(name)
            for name, cell in (("tp", t & p), ("fp", ~t & p), ("fn", t & ~p))
        ]
    )
    return sums.withColumn("f1", _f1(F.col("tp"), F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")))


def aspect_f1_macro(long: DataFrame) -> DataFrame:
    return aspect_f1(long).agg(F.avg("f1").alias("aspect_f1_macro"))


def sentiment_confusion(long: DataFrame) -> DataFrame:
    """Counts per aspect, true and predicted sentiment, where the aspect is present."""
    return (
        long.where("sentiment_true <> -1")
        .groupBy("aspect", "sentiment_true", "sentiment_pred")
        .agg(F.sum(_weight(long)).cast("bigint").alias("n"))
    )


def classification_report(long: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per aspect and class, with the accuracy of
    the aspect. Classes are those seen in truth or prediction."""
    n, hit = F.col("n"), F.col("sentiment_true") == F.col("sentiment_pred")
    zero = F.lit(0).cast("bigint")
    roles = F.array(
        F.struct(
            F.col("sentiment_true").alias("class"),
            n.alias("support"),
            zero.alias("predicted"),
            F.when(hit, n).otherwise(zero).alias("tp"),
        ),
        F.struct(
            F.col("sentiment_pred").alias("class"),
            zero.alias("support"),
            n.alias("predicted"),
            zero.alias("tp"),
        ),
    )
    sums = (
        sentiment_confusion(long)
        .select("aspect", F.inline(roles))
        .groupBy("aspect", "class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )
    rate = lambda top, bottom: F.coalesce(F.col(top) / F.nullif(F.col(bottom), F.lit(0)), F.lit(0.0))
    per_aspect = Window.partitionBy("aspect")
    return sums.select(
        "aspect",
        "class",
        rate("tp", "predicted").alias("precision"),
        rate("tp", "support").alias("recall"),
        _f1(F.col("tp"), F.col("support"), F.col("predicted")).alias("f1"),
        "support",
        (F.sum("tp").over(per_aspect) / F.sum("support").over(per_aspect)).alias("accuracy"),
    )


def sentiment_f1_per_aspect(long: DataFrame) -> DataFrame:
    """Macro F1 of each aspect over the classes seen; aspects without support are absent."""
    return classification_report(long).groupBy("aspect").agg(F.avg("f1").alias("sentiment_f1"))


def combined_f1(long: DataFrame) -> DataFrame:
    """Aspect macro F1, the mean of the per-aspect sentiment F1 rounded to four
    digits, and the mean of both. The outcome counts are written once (a job), as both
    sides need them and a filter of one side would else recompute the long table."""
    long = long if "n" in long.columns else reliable_checkpoint(outcome_counts(long))
    mood = sentiment_f1_per_aspect(long).select(
        F.lit(None).cast("double").alias("a"), F.round("sentiment_f1", 4).alias("s")
    )
    aspect = aspect_f1(long).select(F.col("f1").alias("a"), F.lit(None).cast("double").alias("s"))
    return (
        aspect.unionByName(mood)
        .agg(F.avg("a").alias("aspect_f1_macro"), F.avg("s").alias("sentiment_f1_avg"))
        .withColumn("combined_f1", (F.col("aspect_f1_macro") + F.col("sentiment_f1_avg")) / 2)
    )


def confusion_matrix(long: DataFrame, classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Row-normalised confusion counts: one row per aspect and true class."""
    wide = (
        sentiment_confusion(long)
        .groupBy("aspect", "sentiment_true")
        .pivot("sentiment_pred", list(classes))
        .agg(F.sum("n"))
        .fillna(0)
    )
    total = sum((F.col(str(c)) for c in classes), F.lit(0))
    return wide.select(
        "aspect",
        "sentiment_true",
        *[F.col(str(c)).alias(f"n_{c}") for c in classes],
        *[(F.col(str(c)) / (total + 1e-9)).alias(f"rate_{c}") for c in classes],
    )


def log_loss(
    scored: DataFrame, weights: Sequence[float] | None = None, alpha: float = 1.0, beta: float = 1.0
) -> DataFrame:
    """Binary cross-entropy of the aspects plus class-weighted cross-entropy of the
    sentiments, absent aspects left out of the second.

    ``scored`` has ``aspect_true, aspect_prob, sentiment_true, sentiment_probs``.
    """
    y, p = F.col("aspect_true"), F.col("aspect_prob")
    bce = -F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))
    known = F.col("sentiment_true") >= 0
    weight = F.lit(1.0)
    if weights is not None:
        weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("sentiment_true"))
    own = F.get("sentiment_probs", F.col("sentiment_true"))
    ce = F.sum(F.when(known, -weight * F.log(own))) / F.sum(F.when(known, weight))
    return scored.agg(bce.alias("aspect_loss"), ce.alias("sentiment_loss")).withColumn(
        "total_loss", alpha * F.col("aspect_loss") + beta * F.col("sentiment_loss")
    )


def regression_metrics(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """R2 and RMSE in one pass."""
    error = F.col(target) - F.col(prediction)
    return df.agg(
        (1 - F.sum(error * error) / (F.count(target) * F.var_pop(target))).alias("r2"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    )


def epoch_mean_loss(steps: DataFrame, epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    return steps.groupBy(epoch).agg(F.avg(loss).alias("train_loss"), F.count(F.lit(1)).alias("steps"))


def best_checkpoint(log: DataFrame, score: str = "combined_f1", epoch: str = "epoch") -> DataFrame:
    """The row with the highest positive score, the earliest on ties; empty if none.

    A top-1 by order, so no task ever sorts the whole log.
    """
    return log.where(F.col(score) > 0).orderBy(F.desc(score), epoch).limit(1)


def annotator_agreement(df: DataFrame) -> DataFrame:
    """Fill ``agreement``: Y where both annotators gave the same aspect and sentiment."""
    same = (F.col("aspect_annotator_1") == F.col("aspect_annotator_2")) & (
        F.col("sentiment_annotator_1") == F.col("sentiment_annotator_2")
    )
    return df.withColumn("agreement", F.when(same, F.lit("Y")).otherwise(F.lit("N")))


def agreement_share(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.avg((F.col("agreement") == "Y").cast("double")).alias("agreement_share"),
    )

"""The sample tables seen as review data.

Ratings do not exist in the sample tables; they are a fixed function of the document
id, missing for every 17th row. Dates count hours from the start of 2024.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentika.functions.labels import sentiment_id
from sentika.functions.text import clean_reviews
from sentika.lexicons.sample import sample_lexicon
from sentika.operators.models import label_arrays
from sentika.operators.selection import hash_unit
from sentika.plans.jobs import label_job

LEXICON = sample_lexicon()
ASPECTS = LEXICON.aspect_names


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_reviews(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "cast(doc_id as string) as review_id",
        "doc_id",
        "text as review_text",
        "lang",
        "source",
        "case when doc_id % 17 <> 0 then cast(1 + doc_id % 5 as int) end as rating",
        "timestamp_seconds(1704067200 + doc_id * 3600) as review_date",
    )


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return as_reviews(table(spark, sf, "documents"))


def spread_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews for text work: the small sample tables are one file with one row group, so
    their rows are dealt over all cores first. Listing files runs no job."""
    documents, cores = table(spark, sf, "documents"), spark.sparkContext.defaultParallelism
    few = len(documents.inputFiles()) < cores
    return as_reviews(documents.repartition(cores) if few else documents)


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean_reviews(spread_reviews(spark, sf), slang=LEXICON.slang, stats=True)


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    return label_job(spread_reviews(spark, sf), LEXICON)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Rule labels as truth and predictions that deviate from them by a hash, so that
    every metric has hits and misses that any engine can reproduce."""
    rows = label_arrays(labeled(spark, sf), ASPECTS)

    def probability(i: int, a: str):
        noise = hash_unit(F.col("review_id"), a)
        return 0.05 + 0.9 * (0.4 * F.get("aspect_true", F.lit(i)) + 0.6 * noise)

    off = hash_unit(F.col("review_id"), "mood") >= 0.8
    truth = sentiment_id(F.col("sentiment_rule"))
    guess = F.when(off, (truth + 1) % 3).otherwise(truth).cast("int")
    return rows.withColumn("aspect_probs", F.array(*[probability(i, a) for i, a in enumerate(ASPECTS)])).withColumns(
        {
            "aspect_pred": F.transform("aspect_probs", lambda p: (p >= 0.5).cast("int")),
            "sentiment_pred": F.array_repeat(guess, len(ASPECTS)),
        }
    )


def step_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as training steps: the day is the epoch, the value is the loss."""
    return table(spark, sf, "events").select(
        F.dayofmonth("ts").alias("epoch"), F.col("value").alias("loss"), "event_type"
    )


def epoch_log(spark: SparkSession, sf: str) -> DataFrame:
    """One row per epoch in the shape of a training log."""
    return (
        step_log(spark, sf)
        .groupBy("epoch")
        .agg(
            F.avg("loss").alias("train_loss"),
            F.avg((F.col("event_type") == "purchase").cast("double")).alias("val_aspect_f1_macro"),
            F.avg((F.col("event_type") == "click").cast("double")).alias("val_sentiment_f1_avg"),
        )
        .withColumn("combined_f1", (F.col("val_aspect_f1_macro") + F.col("val_sentiment_f1_avg")) / 2)
    )

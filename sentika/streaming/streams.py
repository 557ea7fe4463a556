"""Streams: score new reviews, drop repeated ones, keep aspect counts current.

Each function maps a streaming DataFrame to a streaming DataFrame, so the caller
chooses source, sink and trigger; :func:`run_available` drains a file source once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentika.functions.labels import label_reviews
from sentika.functions.text import clean_reviews
from sentika.lexicons import Lexicon
from sentika.session import scratch_path


def read_json_stream(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


def read_table_stream(
    spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 100, spread_over: int | None = None
) -> DataFrame:
    """Parquet table as a stream of its files; a pattern in the path lets a table be
    a folder or a single file. ``spread_over`` redistributes batches of few files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    return stream.repartition(spread_over) if spread_over else stream


def stream_score(reviews: DataFrame, lexicon: Lexicon, rating_col: str | None = "rating") -> DataFrame:
    """Clean and label each arriving review; stateless, so append output suits."""
    clean = clean_reviews(reviews, slang=lexicon.slang, stats=True)
    return label_reviews(clean, lexicon, rating_col=rating_col, cleaned=True)


def stream_dedup(
    reviews: DataFrame, horizon: str, key: str = "review_id", time_col: str = "review_date"
) -> DataFrame:
    """One arrival per key; keys older than the horizon are forgotten, which bounds
    the state. Rows that arrive later than the horizon are dropped, so it must cover the
    disorder of the source, which only the caller knows."""
    return reviews.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark([key])


def aspect_counts(labeled: DataFrame, time_col: str, window: str = "1 day") -> DataFrame:
    """Reviews per time window, aspect and sentiment. Each task adds up its own counts
    before the shuffle."""
    return (
        labeled.select(F.col(time_col), F.explode("aspects").alias("aspect"), F.col("sentiment_rule").alias("sentiment"))
        .groupBy(F.window(time_col, window), "aspect", "sentiment")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stream_aspect_counts(labeled: DataFrame, time_col: str, lateness: str, window: str = "1 day") -> DataFrame:
    """Counts of a stream that never ends: rows later than the watermark are dropped, so
    ``lateness`` must cover the disorder of the source, which only the caller knows."""
    return aspect_counts(labeled.withWatermark(time_col, lateness), time_col, window)


def count_available(
    labeled: DataFrame, name: str, time_col: str, window: str = "1 day", timeout: int | None = None
) -> str:
    """Count everything that has arrived, batch by batch, into a fresh folder.

    Every batch writes its own counts, whole again if it is repeated, and nothing is
    late and no state is held; :func:`summed_batches` adds them up, whatever the number
    of batches.
    """
    return _drained(labeled, name, timeout, lambda batch: aspect_counts(batch, time_col, window))


def summed_batches(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The sum of each key over all batches."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum(value).alias(value))


def run_available(stream: DataFrame, name: str, mode: str = "append", timeout: int | None = None) -> str:
    """Process everything that has arrived into a fresh parquet folder and return it.

    In update mode every batch is its own ``batch`` partition, rewritten whole if the
    batch is repeated after a failure; :func:`latest_updates` reads the result. A backlog
    may take as long as it needs unless ``timeout`` (seconds) is given.
    """
    if mode != "append":
        return _drained(stream, name, timeout, lambda batch: batch, mode)
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    writer = stream.writeStream.option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
    query = writer.trigger(availableNow=True).outputMode("append").format("parquet").option("path", out).start()
    _await(query, name, timeout)
    return out


def _drained(stream: DataFrame, name: str, timeout: int | None, made, mode: str = "append") -> str:
    """Write what is ``made`` of each batch to the batch's own partition."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)

    def keep(batch: DataFrame, batch_id: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", scratch_path(spark, f"{name}-progress"))
    _await(writer.trigger(availableNow=True).outputMode(mode).foreachBatch(keep).start(), name, timeout)
    return out


def _await(query, name: str, timeout: int | None) -> None:
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout} s")


def latest_updates(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The last value each key was given over all batches."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))

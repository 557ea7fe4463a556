"""Counts and shares of labels.

Everything here starts from a small *label cube*: the number of reviews per
combination of labels. Spark aggregates it inside each task before the one
shuffle, so a dominant label costs nothing, and exploding multi-label rows
happens on the cube instead of on the reviews.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentika.functions.labels import aspect_title, has_aspect, sentiment_id, sentiment_score
from sentika.lexicons import NEGATIVE, NEUTRAL, POSITIVE, SENTIMENTS

_ALL = "__all__"


def label_cube(labeled: DataFrame, *extra: str) -> DataFrame:
    """Reviews per (aspects, sentiment_rule) and any extra small columns, as ``n``."""
    return labeled.groupBy("aspects", "sentiment_rule", *extra).agg(F.count(F.lit(1)).alias("n"))


def rating_histogram(df: DataFrame) -> DataFrame:
    return df.where("rating is not null").groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def word_count_summary(df: DataFrame) -> DataFrame:
    """Rows, mean and exact median of word_count, from the histogram of its values."""
    histogram = df.groupBy("word_count").agg(F.count(F.lit(1)).alias("n"))
    return histogram.agg(
        F.sum("n").alias("total"),
        (F.sum(F.col("word_count") * F.col("n")) / F.sum("n")).alias("mean_words"),
        F.percentile("word_count", F.lit(0.5), F.col("n")).alias("median_words"),
    )


def aspect_distribution(labeled: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per label, the general one included, reviews and percentage of all reviews.

    Shares add up to more than 100 because a review can carry several labels.
    """
    cube = labeled.groupBy("aspects").agg(F.count(F.lit(1)).alias("n"))
    zero = _zero_rows(cube, F.array(*[F.lit(a) for a in [*labels, _ALL]]).alias("aspects"))
    counts = (
        cube.withColumn("aspects", F.concat(F.array(F.lit(_ALL)), "aspects"))
        .unionByName(zero)
        .select(F.explode("aspects").alias("aspect"), "n")
        .groupBy("aspect")
        .agg(F.sum("n").alias("n"))
    )
    total = F.max(F.when(F.col("aspect") == _ALL, F.col("n"))).over(_whole())
    return (
        counts.withColumn("percentage", F.coalesce(100.0 * F.col("n") / F.nullif(total, F.lit(0)), F.lit(0.0)))
        .where(F.col("aspect") != _ALL)
    )


def aspect_sentiment_counts(labeled: DataFrame) -> DataFrame:
    """Reviews per aspect and review sentiment, only combinations that occur."""
    return (
        label_cube(labeled)
        .select(F.explode("aspects").alias("aspect"), F.col("sentiment_rule").alias("sentiment"), "n")
        .groupBy("aspect", "sentiment")
        .agg(F.sum("n").alias("n"))
    )


def dense_grid(
    counts: DataFrame, aspects: Sequence[str], sentiments: Sequence[str] = SENTIMENTS
) -> DataFrame:
    """Every aspect with every sentiment, zero where ``counts`` has no row.

    Zero rows are added and summed with the counts, which needs no join.
    """
    grid = F.array(
        *[
            F.struct(F.lit(a).alias("aspect"), F.lit(s).alias("sentiment"), F.lit(0).cast("bigint").alias("n"))
            for a in aspects
            for s in sentiments
        ]
    )
    zero = counts.sparkSession.range(1).select(F.inline(grid))
    wanted = counts.where(F.col("aspect").isin(*aspects) & F.col("sentiment").isin(*sentiments))
    return (
        wanted.select("aspect", "sentiment", "n")
        .unionByName(zero)
        .groupBy("aspect", "sentiment")
        .agg(F.sum("n").alias("n"))
    )


def pct_within(counts: DataFrame, group: str, n: str = "n", name: str = "pct") -> DataFrame:
    """Share of the group total in percent, 0 for an empty group.

    ``counts`` is an aggregate with one row per combination of labels.
    """
    total = F.sum(n).over(Window.partitionBy(group))
    return counts.withColumn(name, F.coalesce(100.0 * F.col(n) / F.nullif(total, F.lit(0)), F.lit(0.0)))


def aspect_sentiment_pct(labeled: DataFrame, aspects: Sequence[str]) -> DataFrame:
    """Dense aspect x sentiment table with counts and shares within the aspect."""
    grid = dense_grid(aspect_sentiment_counts(labeled), aspects)
    return pct_within(grid, "aspect").withColumn("aspect_label", aspect_title(F.col("aspect")))


def aspect_sentiment_pivot(
    dist: DataFrame, value: str = "n", sentiments: Sequence[str] = SENTIMENTS
) -> DataFrame:
    """One row per aspect, one column per sentiment, zero where missing."""
    return dist.groupBy("aspect").pivot("sentiment", list(sentiments)).agg(F.sum(value)).fillna(0)


def aspect_ratio_features(labeled: DataFrame, aspects: Sequence[str]) -> DataFrame:
    """One wide row: positive, negative, neutral ratio and mean score per aspect."""
    cube = label_cube(labeled)
    sums, ratios = [], []
    for i, a in enumerate(aspects):
        inside = has_aspect(F.col("aspects"), a)
        mood = F.col("sentiment_rule")
        sums += [
            F.sum(F.when(inside, F.col("n"))).alias(f"total_{i}"),
            F.sum(F.when(inside & (mood == POSITIVE), F.col("n"))).alias(f"pos_{i}"),
            F.sum(F.when(inside & (mood == NEGATIVE), F.col("n"))).alias(f"neg_{i}"),
            F.sum(F.when(inside & (mood == NEUTRAL), F.col("n"))).alias(f"net_{i}"),
            F.sum(F.when(inside, F.col("n") * sentiment_score(mood))).alias(f"score_{i}"),
        ]
        for part, suffix in (("pos", "pos_ratio"), ("neg", "neg_ratio"), ("net", "net_ratio"), ("score", "score")):
            ratio = F.col(f"{part}_{i}") / F.col(f"total_{i}")
            ratios.append(F.coalesce(ratio, F.lit(0.0)).alias(f"{a}_{suffix}"))
    return cube.agg(*sums).select(*ratios)


def class_weights(labeled: DataFrame, aspects: Sequence[str], classes: int = 3) -> DataFrame:
    """Inverse-frequency weight per sentiment id, normalised to sum 1.

    A review counts once for each of its aspects, as each is one training label.
    Pass only the training rows to keep validation and test out of the weights.
    """
    per_row = sum((has_aspect(F.col("aspects"), a).cast("bigint") for a in aspects), F.lit(0).cast("bigint"))
    counts = label_cube(labeled).select(
        sentiment_id(F.col("sentiment_rule")).alias("sentiment_id"), (F.col("n") * per_row).alias("n")
    )
    zero = counts.sparkSession.range(classes).select(
        F.col("id").cast("int").alias("sentiment_id"), F.lit(0).cast("bigint").alias("n")
    )
    raw = (
        counts.unionByName(zero)
        .groupBy("sentiment_id")
        .agg(F.sum("n").alias("n"))
        .withColumn("raw", 1.0 / (F.col("n") + 1e-9))
    )
    return raw.select("sentiment_id", "n", (F.col("raw") / F.sum("raw").over(_whole())).alias("weight"))


def _whole() -> Window:
    """All rows of a result whose size is the number of labels."""
    return Window.partitionBy(F.lit(0))


def _zero_rows(like: DataFrame, column: Column) -> DataFrame:
    return like.sparkSession.range(1).select(column, F.lit(0).cast("bigint").alias("n"))

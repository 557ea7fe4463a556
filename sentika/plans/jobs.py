"""End-to-end jobs: collect, label, report, score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentika.functions.labels import TIER_TEXTS, label_reviews, naive_sentiment, priority_tier
from sentika.functions.text import clean_reviews
from sentika.lexicons import NEGATIVE, POSITIVE, Lexicon
from sentika.operators.distributions import aspect_sentiment_pct, dense_grid, pct_within
from sentika.operators.models import score_reviews, score_reviews_rules
from sentika.operators.selection import (
    conform_schema,
    dedup_keep_first,
    fill_defaults,
    first_rows,
    long_enough,
    union_feeds,
)
from sentika.schemas import RAW
from sentika.session import reliable_checkpoint
from sentika.sources.files import scan_landing_pages, scan_reviews_csv, write_csv


def ingest_pages(spark: SparkSession, feed_paths: Sequence[str], cap: int | None = None) -> DataFrame:
    """Landed pages of several feeds, first feed first, one row per review.

    ``cap`` is the collection target: so many reviews are kept at most, those of the
    first feeds, the newest first.
    """
    feeds = [conform_schema(scan_landing_pages(spark, path), RAW) for path in feed_paths]
    stacked = union_feeds(feeds)
    order = ["feed_rank", F.desc("review_date"), "review_text"]
    collected = dedup_keep_first(stacked, "review_id", order)
    if cap is not None:
        collected = first_rows(collected, cap, ["feed_rank", F.desc("review_date"), "review_id"])
    return collected.drop("feed_rank")


def structure_reviews(collected: DataFrame) -> DataFrame:
    """Keep reviews with some text and add the stars-only sentiment."""
    return (
        collected.dropna(subset=["review_text"])
        .where(long_enough(F.col("review_text")))
        .withColumn("sentiment_label_naive", naive_sentiment(F.col("rating")))
    )


def clean_job(reviews: DataFrame, lexicon: Lexicon, min_words: int = 3) -> DataFrame:
    """Cleaned reviews of at least ``min_words`` words, with text counts."""
    cleaned = clean_reviews(reviews, slang=lexicon.slang, stats=True)
    return cleaned.where(F.col("word_count") >= min_words)


def label_job(reviews: DataFrame, lexicon: Lexicon, min_words: int = 3) -> DataFrame:
    """Clean and label in one pass over the rows, without a shuffle."""
    return label_cleaned(clean_reviews(reviews, slang=lexicon.slang, stats=True), lexicon, min_words)


def label_cleaned(cleaned: DataFrame, lexicon: Lexicon, min_words: int = 3) -> DataFrame:
    """Label cleaned reviews of at least ``min_words`` words, which the cleaning counted."""
    return label_reviews(cleaned.where(F.col("word_count") >= min_words), lexicon, cleaned=True)


def sentiment_by_aspect(reviews: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The headline table: raw reviews to shares of each sentiment in each aspect."""
    return aspect_sentiment_pct(label_job(reviews, lexicon), lexicon.aspect_names)


def score_table(reviews: DataFrame, lexicon: Lexicon, model=None, text_col: str = "review_text") -> DataFrame:
    """Batch scoring of any table; by rules when no model is given."""
    filled = fill_defaults(reviews, {text_col: ""})
    if model is None:
        return score_reviews_rules(filled, lexicon, text_col)
    return score_reviews(filled, model, lexicon, text_col=text_col)


def score_file(
    spark: SparkSession, in_path: str, out_path: str, lexicon: Lexicon, model=None, text_col: str = "review_text"
) -> None:
    """Batch scoring: CSV in, predictions CSV out, which must be another place.

    A CSV file is read by one task, so its rows are dealt over all cores, four parts each,
    before the text work.
    """
    if in_path.rstrip("/") == out_path.rstrip("/"):
        raise ValueError("predictions would overwrite their input")
    reviews = scan_reviews_csv(spark, in_path, spread_over=4 * spark.sparkContext.defaultParallelism)
    write_csv(score_table(reviews, lexicon, model, text_col), out_path)


def report_rows(
    labeled: DataFrame, aspects: Sequence[str], regression: Mapping[str, float] | None = None
) -> DataFrame:
    """Everything the report says as one long table: section, item, detail, n, value.

    The reviews are scanned once for the label cube, a written table of a few
    hundred rows at most; the sections are read from it.
    """
    cube = reliable_checkpoint(
        labeled.groupBy("rating", "aspects", "sentiment_rule").agg(F.count(F.lit(1)).alias("n"))
    )
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    total = cube.agg(F.sum("n").alias("n")).select(
        F.lit("dataset").alias("section"), F.lit("total").alias("item"), text.alias("detail"), "n", number.alias("value")
    )
    ratings = (
        cube.where("rating is not null")
        .groupBy("rating")
        .agg(F.sum("n").alias("n"))
        .select(F.lit("rating").alias("section"), F.col("rating").cast("string").alias("item"), text.alias("detail"), "n", number.alias("value"))
    )
    moods = _dist_from_cube(cube, aspects)
    dist = moods.select(
        F.lit("sentiment").alias("section"),
        F.col("aspect").alias("item"),
        F.col("sentiment").alias("detail"),
        "n",
        F.round("pct", 2).alias("value"),
    )
    negative = F.round("pct", 2)
    tiers = moods.where(F.col("sentiment") == NEGATIVE).select(
        F.lit("tier").alias("section"),
        F.col("aspect").alias("item"),
        priority_tier(negative).alias("detail"),
        F.lit(None).cast("bigint").alias("n"),
        negative.alias("value"),
    )
    rows = total.unionByName(ratings).unionByName(dist).unionByName(tiers)
    if regression:
        measures = F.array(
            *[
                F.struct(
                    F.lit("regression").alias("section"),
                    F.lit(name).alias("item"),
                    text.alias("detail"),
                    F.lit(None).cast("bigint").alias("n"),
                    F.lit(float(value)).alias("value"),
                )
                for name, value in regression.items()
            ]
        )
        rows = rows.unionByName(labeled.sparkSession.range(1).select(F.inline(measures)))
    return rows


def _dist_from_cube(cube: DataFrame, aspects: Sequence[str]) -> DataFrame:
    counts = (
        cube.select(F.explode("aspects").alias("aspect"), F.col("sentiment_rule").alias("sentiment"), "n")
        .groupBy("aspect", "sentiment")
        .agg(F.sum("n").alias("n"))
    )
    return pct_within(dense_grid(counts, aspects), "aspect")


def _by_item(a, b):
    return F.when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0)


def report_document(rows: DataFrame, title: str = "", period: str = "", source: str = "") -> DataFrame:
    """The long report as one JSON document (a few dozen entries)."""
    section = F.col("section")

    def entries(name: str, value: Column) -> Column:
        pairs = F.collect_list(F.when(section == name, F.struct(F.col("item"), value.alias("v"))))
        return F.map_from_entries(F.array_sort(pairs, _by_item))

    mood = F.struct(F.col("n").alias("count"), F.col("value").alias("pct"))
    per_aspect = (
        rows.where(section == "sentiment")
        .groupBy("item")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("detail"), mood)))).alias("moods"))
        .select(F.lit("sentiment").alias("section"), "item", "moods")
    )
    high, watch, good = TIER_TEXTS
    status = F.when(F.col("detail") == "high", high).when(F.col("detail") == "watch", watch).otherwise(good)
    merged = rows.where(section != "sentiment").unionByName(per_aspect, allowMissingColumns=True)

    def advice(aspect: Column, tier: Column) -> Column:
        positive = F.element_at(F.element_at("moods", aspect), POSITIVE)
        return F.struct(tier["status"].alias("status"), tier["neg_pct"].alias("neg_pct"), positive["pct"].alias("pos_pct"))

    document = F.struct(
        F.lit(title).alias("judul_penelitian"),
        F.struct(
            F.col("total").alias("total_ulasan"),
            F.lit(period).alias("periode"),
            F.lit(source).alias("sumber"),
            F.col("ratings").alias("distribusi_rating"),
        ).alias("dataset"),
        F.col("moods").alias("distribusi_sentimen_per_aspek"),
        F.col("regression").alias("regresi_ridge"),
        F.transform_values("tiers", advice).alias("rekomendasi_strategis"),
    )
    return merged.agg(
        F.max(F.when(section == "dataset", F.col("n"))).alias("total"),
        entries("rating", F.col("n")).alias("ratings"),
        entries("sentiment", F.col("moods")).alias("moods"),
        entries("regression", F.col("value")).alias("regression"),
        entries("tier", F.struct(status.alias("status"), F.col("value").alias("neg_pct"))).alias("tiers"),
    ).select(F.to_json(document).alias("report"))


def training_curves_table(log: DataFrame) -> DataFrame:
    """Epoch, loss and validation scores in epoch order."""
    return log.select("epoch", "train_loss", "val_aspect_f1_macro", "val_sentiment_f1_avg").orderBy("epoch")

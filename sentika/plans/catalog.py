"""Every capability as a runnable query over the sample tables.

Each query takes the session and the folder of the tables and returns a DataFrame of
plain columns, so that any engine can check it. Arrays and maps are joined to text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentika.functions import labels as L
from sentika.functions import text as X
from sentika.lexicons import Lexicon, lexicon_terms
from sentika.lexicons.sample import LANGUAGE_PROFILES, STOP_WORDS
from sentika.operators import dictionary_scan as A
from sentika.operators import distributions as D
from sentika.operators import joint as T
from sentika.operators import languages as G
from sentika.operators import lookups as J
from sentika.operators import metrics as M
from sentika.operators import models as ML
from sentika.operators import regression as R
from sentika.operators import selection as S
from sentika.operators import topics as K
from sentika.plans import jobs
from sentika.plans import sample_views as V
from sentika.plans.sample_views import ASPECTS, LEXICON
from sentika.schemas import LANDING, RAW, columns
from sentika.session import reliable_checkpoint, scratch_path
from sentika.sources import files
from sentika.streaming import arrivals as Y
from sentika.streaming import streams as Z

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TRAINING = ML.TrainingConfig(num_features=1 << 12, max_iter=5, reg_params=(0.0, 0.1))
ONE_CANDIDATE = ML.TrainingConfig(num_features=1 << 12, max_iter=5, reg_params=(0.1,))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _written(df: DataFrame, name: str) -> DataFrame:
    """Rows computed once, for all that reads them."""
    path = scratch_path(df.sparkSession, name)
    files.write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _joined(labeled: DataFrame, *more: str) -> DataFrame:
    """Labels as plain columns."""
    return labeled.select(
        "review_id",
        L.join_aspects(F.col("aspects")).alias("aspects"),
        "aspect_count",
        "sentiment_rule",
        "is_multilabel",
        *more,
    )


def _counts_text(counts: Column) -> Column:
    """A map of counts as ``A:1,B:2`` in lexicon order."""
    parts = [F.concat(F.lit(f"{a}:"), F.element_at(counts, a).cast("string")) for a in ASPECTS]
    return F.array_join(F.array_compact(F.array(*parts)), ",")


def _moods_text(moods: Column) -> Column:
    names = [*ASPECTS, "GENERAL"]
    parts = [F.concat(F.lit(f"{a}:"), F.element_at(moods, a)) for a in names]
    return F.array_join(F.array_compact(F.array(*parts)), ",")


# ---- sources and sinks ------------------------------------------------------

@query
def scan_reviews(spark, sf):
    path = scratch_path(spark, "raw-csv")
    files.write_csv(S.conform_schema(V.reviews(spark, sf), RAW), path)
    return files.scan_reviews_csv(spark, path).select("review_id", "review_text", "rating")


@query
def sink_table(spark, sf):
    table, path = scratch_path(spark, "labeled"), scratch_path(spark, "labeled-csv")
    rows = V.labeled(spark, sf).select(
        "review_id", "clean_text", "aspects", "sentiment_rule", "matched_keywords", "is_multilabel"
    )
    files.write_table(rows, table)
    files.write_csv(files.scan_reviews(spark, table), path)
    schema = columns(
        review_id="string",
        clean_text="string",
        aspects="string",
        sentiment_rule="string",
        matched_keywords="string",
        is_multilabel="boolean",
    )
    return files.scan_reviews_csv(spark, path, schema)


@query
def sink_json_report(spark, sf):
    path = scratch_path(spark, "report")
    files.write_json(jobs.report_document(jobs.report_rows(V.labeled(spark, sf), ASPECTS)), path)
    shape = "distribusi_sentimen_per_aspek map<string,map<string,struct<count:bigint,pct:double>>>"
    document = spark.read.schema("report string").json(path).select(F.from_json("report", shape).alias("r"))
    moods = document.select(F.explode("r.distribusi_sentimen_per_aspek").alias("aspect", "moods"))
    return moods.select("aspect", F.explode("moods").alias("sentiment", "cell")).select(
        "aspect", "sentiment", F.col("cell.count").alias("n"), F.col("cell.pct").alias("pct")
    )


@query
def scan_training_log(spark, sf):
    log = V.epoch_log(spark, sf).drop("combined_f1")
    path = scratch_path(spark, "metrics")
    fields = ["epoch", "train_loss", "val_aspect_f1_macro", "val_sentiment_f1_avg"]
    files.write_json(log.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("training_log")), path)
    return files.scan_training_log(spark, path).select(
        "epoch", *[F.round(c, 9).alias(c) for c in fields[1:]]
    )


def _landing_feeds(spark, sf) -> list[str]:
    """Two collected feeds: every document, and again those with a quality label."""
    newest = V.reviews(spark, sf)
    relevant = newest.join(V.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    paths = []
    for name, feed in (("newest", newest), ("relevant", relevant)):
        path = scratch_path(spark, f"feed-{name}")
        pages = feed.select(
            F.col("review_id").alias("reviewId"),
            F.col("review_text").alias("content"),
            F.col("rating").alias("score"),
            F.lit(int(name == "relevant")).alias("thumbsUpCount"),
            F.col("review_date").alias("at"),
        )
        files.write_json(pages, path)
        paths.append(path)
    return paths


@query
def ingest_pages(spark, sf):
    collected = jobs.ingest_pages(spark, _landing_feeds(spark, sf))
    return jobs.structure_reviews(collected).select(
        "review_id", "review_text", "rating", "helpful_count", "sentiment_label_naive"
    )


@query
def conform_schema(spark, sf):
    landed = V.reviews(spark, sf).select(
        F.col("review_id").alias("reviewId"),
        F.col("review_text").alias("content"),
        F.col("rating").alias("score"),
        "source",
    )
    return S.conform_schema(landed)


@query
def score_file(spark, sf):
    source, target = scratch_path(spark, "to-score"), scratch_path(spark, "scored")
    files.write_csv(S.conform_schema(V.reviews(spark, sf), RAW), source)
    jobs.score_file(spark, source, target, LEXICON)
    schema = columns(**{name: "string" for name in [*RAW.fieldNames(), *ML.PREDICTION_COLUMNS]})
    scored = files.scan_reviews_csv(spark, target, schema)
    return scored.select("review_id", "clean_text", "aspects", "summary")


@query
def save_load_model(spark, sf):
    path = scratch_path(spark, "model")
    texts = _cleaned_once(spark, sf)
    model = ML.train_evaluate(jobs.label_cleaned(texts, LEXICON), ASPECTS, ONE_CANDIDATE).model
    ML.save_model(model, path)
    one = _score(texts, model).select("review_id", F.struct("aspects", "sentiments", "summary").alias("one"))
    two = _score(texts, ML.load_model(path)).select("review_id", F.struct("aspects", "sentiments", "summary").alias("two"))
    return one.join(two, "review_id", "full").select("review_id", F.col("one").eqNullSafe(F.col("two")).alias("agree"))


# ---- projections and filters ------------------------------------------------

@query
def filter_nonnull_text(spark, sf):
    text = F.when(F.col("rating").isNotNull(), F.col("review_text"))
    rows = V.reviews(spark, sf).withColumn("review_text", text)
    return rows.dropna(subset=["review_text"]).select("review_id", "review_text")


@query
def filter_min_length(spark, sf):
    return V.reviews(spark, sf).where(S.long_enough(F.col("review_text"))).select("review_id")


@query
def naive_sentiment(spark, sf):
    return V.reviews(spark, sf).select(
        "review_id", "rating", L.naive_sentiment(F.col("rating")).alias("sentiment_label_naive")
    )


@query
def filter_min_words(spark, sf):
    return jobs.clean_job(V.reviews(spark, sf), LEXICON).select("review_id", "word_count")


@query
def aspect_filter(spark, sf):
    return V.labeled(spark, sf).where(L.has_aspect(F.col("aspects"), "PRIVACY")).select("review_id", "sentiment_rule")


@query
def aspect_membership(spark, sf):
    joined = _joined(V.labeled(spark, sf))
    flags = [L.has_aspect_joined(F.col("aspects"), a).alias(f"has_{a.lower()}") for a in ASPECTS]
    return joined.select("review_id", *flags)


@query
def annotation_projection(spark, sf):
    rows = V.labeled(spark, sf).withColumn("aspects", L.join_aspects(F.col("aspects")))
    return S.annotation_projection(rows)


@query
def fill_defaults(spark, sf):
    rows = V.reviews(spark, sf).select("review_id", F.col("rating").alias("stars"))
    return S.fill_defaults(rows, {"stars": 0, "rating": 3, "sentiment_rule": "Netral"})


@query
def bind_label_columns(spark, sf):
    return _joined(V.labeled(spark, sf), "rating", "lang")


@query
def row_ordinal(spark, sf):
    rows = V.reviews(spark, sf).where(S.long_enough(F.col("review_text"))).select("doc_id", "review_id")
    return S.dense_ordinal(rows, ["doc_id"])


def _audited_filters() -> dict[str, Column]:
    text = F.col("review_text")
    return {
        "has_text": text.isNotNull(),
        "long_enough": S.long_enough(text),
        "enough_words": F.col("word_count") >= 3,
    }


@query
def filter_audit(spark, sf):
    return S.filter_audit(V.cleaned(spark, sf), _audited_filters())


@query
def filter_audit_written(spark, sf):
    """The same audit observed while the rows are written, and the rows found in the table."""
    path = scratch_path(spark, "filtered")
    audit = S.write_filtered(V.cleaned(spark, sf), _audited_filters(), path)
    written = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_written"))
    return audit.crossJoin(F.broadcast(written))  # one row


# ---- lookups ----------------------------------------------------------------

@query
def slang_lookup(spark, sf):
    return V.spread_reviews(spark, sf).select(
        "review_id", X.normalize_slang(F.col("review_text"), LEXICON.slang).alias("normalized")
    )


@query
def slang_lookup_join(spark, sf):
    slang = LEXICON.to_table(spark).where("kind = 'slang'")
    rows = V.spread_reviews(spark, sf).select("review_id", "review_text")
    joined = J.replace_words_join(rows, slang, "review_id", "review_text", "normalized")
    return joined.select("review_id", "normalized")


@query
def lexicon_match_join(spark, sf):
    terms = lexicon_terms(LEXICON.to_table(spark), "aspect")
    lengths = [J.piece_count(t) for ts in LEXICON.aspects.values() for t in ts]
    return J.lexicon_match_join(V.cleaned(spark, sf), terms, lengths, "review_id", "clean_text")


@query
def label_score_map(spark, sf):
    return J.label_codes(V.labeled(spark, sf)).select("review_id", "sentiment_rule", "sentiment_score", "sentiment_id")


@query
def dense_grid_join(spark, sf):
    privacy = V.labeled(spark, sf).where(L.has_aspect(F.col("aspects"), "PRIVACY") & (F.col("rating") >= 4))
    return D.dense_grid(D.aspect_sentiment_counts(privacy), ASPECTS)


@query
def aspect_semi_anti(spark, sf):
    return J.aspect_side(V.labeled(spark, sf)).select("review_id", "side")


# ---- aggregations -----------------------------------------------------------

@query
def rating_histogram(spark, sf):
    return D.rating_histogram(V.reviews(spark, sf))


@query
def naive_sentiment_counts(spark, sf):
    rows = V.reviews(spark, sf).withColumn("sentiment", L.naive_sentiment(F.col("rating")))
    return D.value_counts(rows, "sentiment").orderBy(F.desc("n"), "sentiment")


@query
def lang_distribution(spark, sf):
    return D.value_counts(J.detect_language(V.cleaned(spark, sf), LANGUAGE_PROFILES, out_col="guess"), "guess")


@query
def word_count_summary(spark, sf):
    return D.word_count_summary(jobs.clean_job(V.reviews(spark, sf), LEXICON)).select(
        "total", F.round("mean_words", 6).alias("mean_words"), "median_words"
    )


@query
def aspect_distribution(spark, sf):
    return D.aspect_distribution(V.labeled(spark, sf), LEXICON.labels).select(
        "aspect", "n", F.round("percentage", 6).alias("percentage")
    )


@query
def aspect_sentiment_counts(spark, sf):
    return D.aspect_sentiment_counts(V.labeled(spark, sf))


@query
def aspect_sentiment_pct(spark, sf):
    return jobs.sentiment_by_aspect(V.reviews(spark, sf), LEXICON).select(
        "aspect", "aspect_label", "sentiment", "n", F.round("pct", 6).alias("pct")
    )


@query
def aspect_sentiment_pivot(spark, sf):
    dist = D.dense_grid(D.aspect_sentiment_counts(V.labeled(spark, sf)), ASPECTS)
    return D.aspect_sentiment_pivot(dist)


@query
def aspect_ratio_features(spark, sf):
    wide = D.aspect_ratio_features(V.labeled(spark, sf), ASPECTS)
    return wide.select(*[F.round(c, 9).alias(c) for c in wide.columns])


@query
def class_weights(spark, sf):
    return D.class_weights(V.labeled(spark, sf), ASPECTS).select(
        "sentiment_id", "n", F.round("weight", 9).alias("weight")
    )


def _long(spark, sf) -> DataFrame:
    pairs = ("aspect_true", "sentiment_true"), ("aspect_pred", "sentiment_pred")
    return M.long_labels(V.scored(spark, sf), ASPECTS, *pairs)


@query
def aspect_f1_macro(spark, sf):
    return M.aspect_f1_macro(_long(spark, sf)).select(F.round("aspect_f1_macro", 9).alias("aspect_f1_macro"))


@query
def sentiment_f1_per_aspect(spark, sf):
    return M.sentiment_f1_per_aspect(_long(spark, sf)).select("aspect", F.round("sentiment_f1", 9).alias("sentiment_f1"))


@query
def sentiment_f1_avg(spark, sf):
    return M.combined_f1(_long(spark, sf)).select(F.round("sentiment_f1_avg", 9).alias("sentiment_f1_avg"))


@query
def combined_f1(spark, sf):
    wide = M.combined_f1(_long(spark, sf))
    return wide.select(*[F.round(c, 9).alias(c) for c in wide.columns])


@query
def confusion_matrix(spark, sf):
    wide = M.confusion_matrix(_long(spark, sf))
    return wide.select(*[F.round(c, 9).alias(c) if c.startswith("rate") else c for c in wide.columns])


@query
def classification_report(spark, sf):
    wide = M.classification_report(_long(spark, sf))
    rates = ("precision", "recall", "f1", "accuracy")
    return wide.select(*[F.round(c, 9).alias(c) if c in rates else c for c in wide.columns])


@query
def epoch_mean_loss(spark, sf):
    return M.epoch_mean_loss(V.step_log(spark, sf)).select("epoch", F.round("train_loss", 9).alias("train_loss"), "steps")


def _folded(spark, sf, labeled: DataFrame | None = None) -> DataFrame:
    labeled = V.labeled(spark, sf) if labeled is None else labeled
    return S.kfold_hashed(R.regression_table(labeled, ASPECTS, "doc_id"), "doc_id")


@query
def gram_matrix(spark, sf):
    return R.gram_matrix(_folded(spark, sf), R.feature_names(ASPECTS), "rating", "fold")


@query
def regression_metrics(spark, sf):
    rows = V.labeled(spark, sf).where("rating is not null").select(
        "rating", (3 + L.sentiment_score(F.col("sentiment_rule"))).alias("prediction")
    )
    wide = M.regression_metrics(rows, "rating", "prediction")
    return wide.select(*[F.round(c, 9).alias(c) for c in wide.columns])


@query
def log_loss(spark, sf):
    guess = F.col("sentiment_pred")
    rows = F.array(
        *[
            F.struct(
                F.get("aspect_true", F.lit(i)).alias("aspect_true"),
                F.get("aspect_probs", F.lit(i)).alias("aspect_prob"),
                F.get("sentiment_true", F.lit(i)).alias("sentiment_true"),
                F.get("sentiment_pred", F.lit(i)).alias("sentiment_pred"),
            )
            for i in range(len(ASPECTS))
        ]
    )
    long = V.scored(spark, sf).select(F.inline(rows))
    probs = F.array(*[F.when(guess == c, 0.7).otherwise(0.15) for c in range(3)])
    wide = M.log_loss(long.withColumn("sentiment_probs", probs), weights=(0.2, 0.3, 0.5))
    return wide.select(*[F.round(c, 8).alias(c) for c in wide.columns])


def _annotated(spark, sf) -> DataFrame:
    """The stars-aware labels as one annotator, the words-only labels as the other."""
    counted = L.lexicon_hits(jobs.clean_job(V.reviews(spark, sf), LEXICON), LEXICON, cleaned=True)
    hits = {a: F.col(f"hits_{i}") for i, a in enumerate(ASPECTS)}
    words = F.col("hits_positive"), F.col("hits_negative")
    joined = L.join_aspects(L.detect_aspects(hits))
    return M.annotator_agreement(
        counted.select(
            "review_id",
            joined.alias("aspect_annotator_1"),
            L.detect_sentiment(*words, F.col("rating")).alias("sentiment_annotator_1"),
            joined.alias("aspect_annotator_2"),
            L.detect_sentiment(*words).alias("sentiment_annotator_2"),
        )
    )


@query
def annotator_agreement(spark, sf):
    return _annotated(spark, sf).select("review_id", "sentiment_annotator_1", "sentiment_annotator_2", "agreement")


@query
def agreement_share(spark, sf):
    return M.agreement_share(_annotated(spark, sf)).select(
        "reviews", F.round("agreement_share", 9).alias("agreement_share")
    )


# ---- windows ----------------------------------------------------------------

@query
def dedup_keep_first(spark, sf):
    turns = V.table(spark, sf, "conversations")
    return S.dedup_keep_first(turns, "conv_id", ["turn", "text"]).select("conv_id", "turn", "role", "text")


@query
def stratified_sample(spark, sf):
    rows = V.reviews(spark, sf).select("review_id", "rating", "review_text")
    return S.stratified_sample(rows).select("review_id", "rating")


@query
def pct_within_group(spark, sf):
    counts = D.aspect_sentiment_counts(V.labeled(spark, sf))
    return D.pct_within(counts, "aspect").select("aspect", "sentiment", "n", F.round("pct", 6).alias("pct"))


@query
def best_checkpoint(spark, sf):
    return M.best_checkpoint(V.epoch_log(spark, sf)).select("epoch", F.round("combined_f1", 9).alias("combined_f1"))


@query
def top_terms_per_group(spark, sf):
    counts = J.term_frequencies(V.labeled(spark, sf), STOP_WORDS, min_length=2)
    return J.top_terms_per_group(counts, "aspect", 80)


@query
def kfold_assign(spark, sf):
    rows = V.reviews(spark, sf).where("rating is not null").select("doc_id")
    return S.kfold_contiguous(rows, ["doc_id"])


# ---- sort, limit, samples ---------------------------------------------------

@query
def coef_ranking(spark, sf):
    table = R.regression_table(V.labeled(spark, sf), ASPECTS)
    slopes = R.univariate_slopes(table, R.feature_names(ASPECTS), "rating")
    return R.coef_ranking(slopes, 5).select(
        "feature",
        F.round("coefficient", 9).alias("coefficient"),
        L.coef_direction(F.col("coefficient")).alias("direction"),
    )


@query
def sorted_histogram(spark, sf):
    return D.rating_histogram(V.reviews(spark, sf)).orderBy("rating")


@query
def random_sample(spark, sf):
    return S.random_sample(V.reviews(spark, sf).select("review_id", "rating"), 100, "review_id")


@query
def shuffle_limit(spark, sf):
    return S.random_sample(V.reviews(spark, sf).select("review_id"), 250, "review_id", seed=7)


@query
def cap_rows(spark, sf):
    return S.first_rows(V.reviews(spark, sf).select("review_id", "doc_id"), 500, ["doc_id"]).select("review_id")


@query
def train_val_test_split(spark, sf):
    return S.train_val_test_split(V.reviews(spark, sf)).select("review_id", "split")


# ---- set operations ---------------------------------------------------------

@query
def union_feeds_distinct(spark, sf):
    documents = V.reviews(spark, sf).select("review_id", "review_text")
    turns = V.table(spark, sf, "conversations").selectExpr(
        "cast(conv_id as string) as review_id", "text as review_text", "turn"
    )
    stacked = S.union_feeds([turns, documents])
    return S.dedup_keep_first(stacked, "review_id", ["feed_rank", "turn", "review_text"])


@query
def stack_batches(spark, sf):
    documents = V.reviews(spark, sf).select(F.lit("documents").alias("batch"), F.length("review_text").alias("chars"))
    turns = V.table(spark, sf, "conversations").select(
        F.lit("conversations").alias("batch"), F.length("text").alias("chars")
    )
    stacked = documents.unionByName(turns)
    return stacked.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))


# ---- text cleaning ----------------------------------------------------------

def _rule(name: str, rule: Callable[[Column], Column], prepare: Callable[[Column], Column] | None = None) -> None:
    """One cleaning rule over the whole texts; ``prepare`` plants what it removes."""

    def run(spark, sf):
        text = F.col("review_text")
        rows = V.reviews(spark, sf).select("review_id", (prepare(text) if prepare else text).alias("before"))
        return rows.select("review_id", rule(F.col("before")).alias("after"))

    run.__name__ = name
    query(run)


def _replace(old: str, new: str) -> Callable[[Column], Column]:
    return lambda text: F.replace(text, F.lit(old), F.lit(new))


_rule("clean_guard", X.blank_to_empty)
_rule("clean_nfc", X.normalize_unicode, _replace("é", "é"))
_rule("clean_emoji", X.strip_emoji, _replace(" que ", " \U0001f600 ☀️ "))
_rule("clean_mentions", X.strip_mentions, _replace(" que ", " @que #que_é "))
_rule("collapse_repeats", X.collapse_repeats)
_rule("collapse_punct", X.collapse_punctuation)
_rule("clean_lower", F.lower)
_rule("normalize_slang", lambda t: X.normalize_slang(F.lower(t), LEXICON.slang))
_rule("clean_special", X.replace_special)
_rule("clean_whitespace", X.normalize_space)
_rule("fallback_clean", X.fallback_clean)


@query
def clean_html(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", X.strip_html(F.col("html")).alias("after"))


@query
def clean_urls(spark, sf):
    pages = V.table(spark, sf, "pages")
    text = F.concat_ws(" ", "html", "url", F.lit("www.example.org/x end"))
    return pages.select("page_id", X.strip_urls(text).alias("after"))


@query
def stem_lookup(spark, sf):
    cleaned = X.clean_reviews(V.spread_reviews(spark, sf), slang=LEXICON.slang, stems=LEXICON.stems, out_col="clean_text_stem")
    return cleaned.select("review_id", "clean_text_stem")


@query
def clean_text(spark, sf):
    return V.cleaned(spark, sf).select("review_id", "clean_text")


@query
def clean_pages(spark, sf):
    """The whole chain on raw pages, where tags and addresses abound."""
    pages = V.table(spark, sf, "pages").select("page_id", F.concat_ws(" ", "html", "url").alias("review_text"))
    return X.clean_reviews(pages, slang=LEXICON.slang).select("page_id", "clean_text")


@query
def text_stats(spark, sf):
    rows = X.text_stats(V.reviews(spark, sf), "review_text")
    return rows.select("review_id", "char_count", "word_count", "sent_count")


@query
def detect_language(spark, sf):
    return J.detect_language(V.cleaned(spark, sf), LANGUAGE_PROFILES, out_col="guess").select("review_id", "guess")


def _language_guesses(spark, sf) -> DataFrame:
    """Languages of the fifth of the texts that was held out, by a model of the others."""
    texts = V.spread_reviews(spark, sf).withColumn("held", S.hash_unit(F.col("review_id"), "lang") < 0.2)
    model = G.fit_languages(texts.where(~F.col("held")), text_col="review_text")
    return model.detect(texts.where("held"), "review_text", "guess")


@query
def fitted_language(spark, sf):
    """The fitted model's guess for every held-out text, and how far ahead it is."""
    return _language_guesses(spark, sf).select("review_id", "guess", F.round("guess_margin", 6).alias("margin"))


@query
def fitted_language_quality(spark, sf):
    return G.detection_quality(_language_guesses(spark, sf))


# ---- labelling --------------------------------------------------------------

@query
def compile_lexicon(spark, sf):
    """Hits of every list of a lexicon that came as a table."""
    lexicon = Lexicon.from_table(LEXICON.to_table(spark))
    counted = L.lexicon_hits(V.reviews(spark, sf), lexicon, "review_text")
    return counted.select("review_id", *[c for c in counted.columns if c.startswith("hits_")])


def _corpus_lexicon(reviews: DataFrame) -> DataFrame:
    """A large lexicon: every word of two texts or more by its length, and the first pair of words of every text."""
    word = rf"[{X.WORD}]+"
    text = F.lower(F.coalesce("review_text", F.lit("")))
    words = reviews.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(word), F.lit(0)))).alias("term"))
    words = words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lengths = F.concat(F.lit("length "), F.least(F.length("term"), F.lit(9)).cast("string"))
    pairs = reviews.select(F.regexp_extract(text, rf"({word} {word})", 1).alias("term")).where("term <> ''").distinct()
    listed = words.select(lengths.alias("label"), "term").unionByName(pairs.select(F.lit("pair").alias("label"), "term"))
    return listed.withColumn("ord", F.xxhash64("term"))


@query
def lexicon_counts(spark, sf):
    """Hits of a lexicon made of the corpus' own words and pairs, in all texts."""
    texts = V.spread_reviews(spark, sf)
    terms = reliable_checkpoint(_corpus_lexicon(texts))
    return A.lexicon_counts(texts, terms, "review_id", "review_text", part_terms=20_000)


@query
def label_reviews_by_table(spark, sf):
    lexicon = LEXICON.to_table(spark)
    rows = V.labeled(spark, sf).select("review_id", "clean_text", "rating")
    labels = A.label_reviews_by_table(rows, lexicon, part_terms=20)
    return _joined(labels, _counts_text(F.col("matched_keywords")).alias("hits"))


@query
def detect_aspects(spark, sf):
    return V.labeled(spark, sf).select("review_id", L.join_aspects(F.col("aspects")).alias("aspects"))


@query
def detect_sentiment(spark, sf):
    return V.labeled(spark, sf).select("review_id", "rating", "sentiment_rule")


@query
def matched_keywords(spark, sf):
    return V.labeled(spark, sf).select("review_id", _counts_text(F.col("matched_keywords")).alias("hits"))


@query
def label_reviews(spark, sf):
    return V.labeled(spark, sf).select(
        "review_id",
        "clean_text",
        "char_count",
        "word_count",
        "sent_count",
        L.join_aspects(F.col("aspects")).alias("aspects"),
        "aspect_count",
        "sentiment_rule",
        _counts_text(F.col("matched_keywords")).alias("hits"),
        "is_multilabel",
    )


@query
def aspects_join_split(spark, sf):
    joined = V.labeled(spark, sf).select("review_id", L.join_aspects(F.col("aspects")).alias("joined"))
    return joined.select("review_id", "joined", F.posexplode(L.split_aspects(F.col("joined"))).alias("position", "aspect"))


@query
def aspect_multihot(spark, sf):
    hot = V.labeled(spark, sf).select("review_id", L.aspect_multihot(F.col("aspects"), ASPECTS).alias("hot"))
    return hot.select("review_id", *[F.get("hot", F.lit(i)).alias(f"is_{a.lower()}") for i, a in enumerate(ASPECTS)])


@query
def aspect_sentiment_ids(spark, sf):
    ids = L.aspect_sentiment_ids(F.col("aspects"), F.col("sentiment_rule"), ASPECTS)
    long = V.labeled(spark, sf).select("review_id", F.posexplode(ids).alias("position", "sentiment_id"))
    names = F.array(*[F.lit(a) for a in ASPECTS])
    return long.select("review_id", F.get(names, F.col("position")).alias("aspect"), "sentiment_id")


@query
def aspect_regression_features(spark, sf):
    return R.regression_table(V.labeled(spark, sf), ASPECTS, "review_id")


@query
def coef_direction(spark, sf):
    slopes = R.univariate_slopes(R.regression_table(V.labeled(spark, sf), ASPECTS), R.feature_names(ASPECTS), "rating")
    return slopes.select("feature", L.coef_direction(F.col("coefficient")).alias("direction"))


@query
def priority_tier(spark, sf):
    dist = jobs.sentiment_by_aspect(V.reviews(spark, sf), LEXICON).where("sentiment = 'Negatif'")
    pct = F.round("pct", 2)
    return dist.select("aspect", pct.alias("neg_pct"), L.priority_tier(pct).alias("tier"))


@query
def aspect_title(spark, sf):
    long = V.labeled(spark, sf).select(F.explode("aspects").alias("aspect"))
    return long.groupBy("aspect").agg(F.count(F.lit(1)).alias("n")).select(L.aspect_title(F.col("aspect")).alias("title"), "n")


@query
def summary_string(spark, sf):
    return ML.score_reviews_rules(V.spread_reviews(spark, sf), LEXICON).select("review_id", "summary")


@query
def text_preview(spark, sf):
    return V.reviews(spark, sf).select("review_id", L.text_preview(F.col("review_text")).alias("preview"))


@query
def round_half_even(spark, sf):
    eighths = F.floor("value") / 8.0
    return V.table(spark, sf, "events").select("event_id", L.round_half_even(eighths, 2).alias("rounded"))


@query
def sigmoid_threshold(spark, sf):
    p = L.sigmoid((F.col("value") - 50.0) / 10.0)
    return V.table(spark, sf, "events").select(
        "event_id",
        F.round(p, 9).alias("probability"),
        L.passes_threshold(p).alias("at_least"),
        L.passes_threshold(p, inclusive=False).alias("above"),
    )


@query
def argmax_class(spark, sf):
    return V.table(spark, sf, "embeddings").select("vec_id", L.argmax_class(F.col("embedding")).alias("predicted"))


# ---- models -----------------------------------------------------------------

def _embedded(spark, sf) -> DataFrame:
    return V.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")


def _clusters(spark, sf) -> DataFrame:
    return ML.kmeans_topics(_embedded(spark, sf))


@query
def kmeans_topics(spark, sf):
    rows = _embedded(spark, sf)
    model = ML.fit_topics(rows)
    assigned = ML.assign_topics(rows, model)
    return assigned.select("doc_id", "label", ML.own_centre_is_nearest(assigned, model).alias("own_centre_is_nearest"))


@query
def kmeans_topic_terms(spark, sf):
    clusters = _clusters(spark, sf).select("doc_id", "cluster_id")
    texts = V.cleaned(spark, sf).join(clusters, "doc_id").select("cluster_id", "clean_text")
    counts = J.term_frequencies(texts, group_col="cluster_id")
    return J.top_terms_per_group(counts, "cluster_id", 10)


@query
def text_topic_costs(spark, sf):
    """The cost table of topics of the texts; the kept start is the cheapest, its cost is found again
    by joins and sums, and it is below that of a single centre."""
    texts = _written(V.cleaned(spark, sf).drop("review_text"), "cleaned")
    topics = K.fit_text_topics(texts)
    again = K.cost_by_join(texts, topics.model, "review_id").withColumnRenamed("texts", "texts_again")
    best = topics.costs.where("kept").select(F.col("cost").alias("best"))
    rows = topics.costs.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(again.withColumnRenamed("cost", "cost_again")))  # one row each
    return rows.select(
        "start",
        "texts",
        (F.col("best") <= F.col("cost")).alias("not_cheaper"),
        ((F.abs(F.col("best") - F.col("cost_again")) <= 1e-6 * F.col("cost_again")) & (F.col("texts") == F.col("texts_again"))).alias(
            "cost_repeats"
        ),
        (F.col("best") < F.col("one_centre")).alias("below_one_centre"),
    )


@query
def text_topic_terms(spark, sf):
    """Occurrences of every term, added up over the topics of all texts."""
    texts = _written(V.cleaned(spark, sf), "cleaned")
    assigned = reliable_checkpoint(K.fit_text_topics(texts).model.assign(texts).select("review_id", "clean_text", "cluster_id"))
    counts = J.term_frequencies(assigned.where("cluster_id IS NOT NULL"), group_col="cluster_id")
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


@query
def tfidf_features(spark, sf):
    weights = ML.term_weights(V.labeled(spark, sf))
    return weights.withColumn("idf", F.round("idf", 9))


def _featurised(spark, sf) -> DataFrame:
    rows = ML.label_arrays(V.labeled(spark, sf), ASPECTS)
    kept = ["review_id", "aspects", "sentiment_rule", "aspect_true", "sentiment_true"]
    return ML.write_features(rows, kept, "clean_text", TRAINING)[1]


def _better(scored: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row for each aspect: whether its model beats the shares of the classes."""
    flags = scored.agg(*[c.alias(f"b{i}") for i, c in enumerate(checks.values())])
    rows = [F.struct(F.lit(a).alias("aspect"), F.col(f"b{i}").alias("beats_constant")) for i, a in enumerate(checks)]
    return flags.select(F.inline(F.array(*rows)))


@query
def aspect_classifier(spark, sf):
    rows = _featurised(spark, sf)
    scored = ML.PipelineModel(ML.fit_aspect_heads(rows, ASPECTS, TRAINING, 0.01)).transform(rows)
    checks = {
        a: ML.beats_constant(scored, F.get("aspect_true", F.lit(i)), ML.vector_to_array(f"aspect_prob_{i}"), 2)
        for i, a in enumerate(ASPECTS)
    }
    return _better(scored, checks)


@query
def sentiment_classifier(spark, sf):
    rows = _featurised(spark, sf)
    scored = ML.PipelineModel(ML.fit_sentiment_heads(rows, ASPECTS, TRAINING, 0.01)).transform(rows)
    checks = {}
    for i, a in enumerate(ASPECTS):
        own = F.get("sentiment_true", F.lit(i))
        fitted = f"sentiment_prob_{i}" in scored.columns
        checks[a] = ML.beats_constant(scored, F.when(own != -1, own), ML.vector_to_array(f"sentiment_prob_{i}"), 3) if fitted else F.lit(True)
    return _better(scored, checks)


JOINT = T.JointConfig(num_features=1 << 12, epochs=4, batches=4, rate=0.1)


def _labeled_by_words(spark, sf) -> DataFrame:
    """Labels that the texts alone explain; the sample's stars are not related to them."""
    texts = V.labeled(spark, sf).select("review_id", "clean_text")
    return L.label_reviews(texts, LEXICON, rating_col=None, cleaned=True)


@query
def joint_training_log(spark, sf):
    """The log that joint training wrote, read back: one line an epoch, whose loss falls, whose
    scores its checkpoint gives again, and whose best line is the model that was kept."""
    run = T.JointTraining(_labeled_by_words(spark, sf), ASPECTS, JOINT, "review_id", "clean_text")
    trained = run.run()
    log = jobs.training_curves_table(files.scan_training_log(spark, trained.log_path)).collect()
    kept = next(i for i, m in enumerate(trained.checkpoints) if m is trained.model)
    combined = [(r.val_aspect_f1_macro + r.val_sentiment_f1_avg) / 2 for r in log]
    rows = []
    for i, (r, model) in enumerate(zip(log, trained.checkpoints, strict=True)):
        again = run.scores(model, "val")
        same = abs(again[0] - r.val_aspect_f1_macro) < 1e-9 and abs(again[1] - r.val_sentiment_f1_avg) < 1e-9
        rows.append((r.epoch, i == 0 or r.train_loss < log[i - 1].train_loss, same, combined[i] <= combined[kept]))
    return spark.createDataFrame(rows, "epoch int, loss_falls boolean, scores_repeat boolean, kept_is_best boolean")


@query
def joint_training_loss(spark, sf):
    """Both losses of the trained weights on rows that were held out, against those of the best
    constants of the training rows; weighted by class as in training."""
    run = T.JointTraining(_labeled_by_words(spark, sf), ASPECTS, JOINT, "review_id", "clean_text")
    trained = run.run()
    heads = F.arrays_zip("aspect_true", F.col("aspect_probs").alias("aspect_prob"), "sentiment_true", "sentiment_probs")
    held = trained.model.transform(run.rows.where("split <> 'train'").drop("hashed")).select(F.posexplode(heads)).select("pos", "col.*")
    train = run.rows.where("split = 'train'").select(F.posexplode(F.arrays_zip("aspect_true", "sentiment_true"))).select("pos", "col.*")
    n = [F.count_if(F.col("sentiment_true") == c) * float(w) for c, w in enumerate(run.of_class)]
    shares = F.array(*[(x + 1e-6) / (sum(n, F.lit(0.0)) + 3e-6) for x in n])
    constants = train.groupBy("pos").agg(((F.sum("aspect_true") + 0.5) / (F.count(F.lit(1)) + 1)).alias("p"), shares.alias("q"))
    flat = held.join(F.broadcast(constants), "pos").withColumns({"aspect_prob": F.col("p"), "sentiment_probs": F.col("q")})  # a row an aspect
    own, constant = M.log_loss(held, run.of_class).first(), M.log_loss(flat, run.of_class).first()
    names = ("aspect_loss", "sentiment_loss", "total_loss")
    return spark.createDataFrame([(n, bool(own[n] < constant[n])) for n in names], "loss string, below_constant boolean")


@query
def train_evaluate(spark, sf):
    trained = ML.train_evaluate(V.labeled(spark, sf), ASPECTS, TRAINING)
    test = trained.test_metrics.withColumns({"epoch": F.lit(0), "reg_param": F.lit(0.0), "part": F.lit("test")})
    return trained.log.withColumn("part", F.lit("val")).unionByName(test)


def _cleaned_once(spark, sf) -> DataFrame:
    """All reviews, cleaned once for training and for scoring."""
    return _written(V.cleaned(spark, sf).select("review_id", "rating", "clean_text", "word_count"), "cleaned")


def _score(texts: DataFrame, model) -> DataFrame:
    scored = ML.score_reviews(texts, model, LEXICON, cleaned=True)
    return scored.select(
        "review_id", L.join_aspects(F.col("aspects")).alias("aspects"), _moods_text(F.col("sentiments")).alias("sentiments"), "summary"
    )


@query
def score_reviews(spark, sf):
    """Whether each scored row follows from its own probabilities, rebuilt from them."""
    texts = _cleaned_once(spark, sf)
    model = ML.train_evaluate(jobs.label_cleaned(texts, LEXICON), ASPECTS, ONE_CANDIDATE).model
    scored = ML.score_reviews(texts, model, LEXICON, cleaned=True)
    sure = F.lit(True)
    for a in ASPECTS:
        p = F.element_at("confidence", a)
        held = F.array_contains("aspects", a)
        sure = sure & ((held == (p >= 0.5)) | (F.abs(p - 0.5) < 1e-4)) & (held == F.map_contains_key("sentiments", a))
    general = F.array_contains("aspects", "GENERAL") == (F.size("sentiments") == 0)
    summary = L.summary_string(F.col("aspects"), F.col("sentiments")) == F.col("summary")
    return scored.select("review_id", (sure & general & summary).alias("follows"))


@query
def score_reviews_rules(spark, sf):
    scored = ML.score_reviews_rules(V.spread_reviews(spark, sf), LEXICON)
    return scored.select(
        "review_id",
        "clean_text",
        L.join_aspects(F.col("aspects")).alias("aspects"),
        _moods_text(F.col("sentiments")).alias("sentiments"),
        F.element_at("confidence", ASPECTS[0]).alias("confidence_first"),
        "summary",
    )


@query
def standardize(spark, sf):
    names = R.feature_names(ASPECTS)
    rows = R.regression_table(V.labeled(spark, sf), ASPECTS, "review_id").drop("rating")
    return R.standardize(reliable_checkpoint(rows), names).select("review_id", *[F.round(c, 9).alias(c) for c in names])


@query
def ridge_cv(spark, sf):
    """The chosen fit, at six digits."""
    found = R.ridge_table(_folded(spark, sf), R.feature_names(ASPECTS))
    numbers = ["coefficient", "abs_coef", "r2", "rmse", "cv_r2", "alpha"]
    # the sign of a coefficient of zero is not a property of the fit
    direction = F.when(F.col("abs_coef") > 1e-9, F.col("direction"))
    return found.withColumn("direction", direction).withColumns({c: F.round(c, 6) + 0.0 for c in numbers})


@query
def model_selection(spark, sf):
    candidates = (
        V.step_log(spark, sf)
        .groupBy(F.col("event_type").alias("candidate"), "epoch")
        .agg(F.avg(F.col("loss") / 100).alias("combined_f1"))
        .groupBy("epoch")
        .agg(F.max("combined_f1").alias("combined_f1"))
    )
    return M.best_checkpoint(candidates).select("epoch", F.round("combined_f1", 9).alias("combined_f1"))


@query
def oversample_minority(spark, sf):
    rows = V.table(spark, sf, "labels").select("doc_id", "toxic")
    return S.oversample_minority(rows, "toxic", "doc_id")


@query
def term_frequencies(spark, sf):
    return J.term_frequencies(V.labeled(spark, sf), STOP_WORDS, min_length=2)


# ---- report -----------------------------------------------------------------

@query
def executive_report(spark, sf):
    return jobs.report_rows(V.labeled(spark, sf), ASPECTS)


@query
def report_regression(spark, sf):
    """The report's regression section, written with the whole document and read back."""
    labeled = _written(V.labeled(spark, sf).select("doc_id", "rating", "aspects", "sentiment_rule"), "labels")
    _, measures = R.ridge_cv(_folded(spark, sf, labeled), R.feature_names(ASPECTS))
    path = scratch_path(spark, "report")
    files.write_json(jobs.report_document(jobs.report_rows(labeled, ASPECTS, measures)), path)
    document = spark.read.schema("report string").json(path)
    section = F.from_json("report", "regresi_ridge map<string,double>")["regresi_ridge"]
    return document.select(F.explode(section).alias("measure", "value")).withColumn("value", F.round("value", 6))


@query
def training_curves_table(spark, sf):
    curves = jobs.training_curves_table(scan_training_log(spark, sf))
    return curves


# ---- streams ----------------------------------------------------------------

@query
def stream_score(spark, sf):
    documents = V.table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    stream = V.as_reviews(Z.read_table_stream(spark, f"{sf}/documents.parquet*", documents.schema, spread_over=cores))
    out = Z.run_available(Z.stream_score(stream, LEXICON), "stream-score")
    return _joined(spark.read.parquet(out))


@query
def stream_dedup(spark, sf):
    paths = _landing_feeds(spark, sf)
    feeds = [S.conform_schema(Z.read_json_stream(spark, p, LANDING), RAW) for p in paths]
    # the drained feeds come in any order: the horizon is what their dates span
    days = V.reviews(spark, sf).agg(F.datediff(F.max("review_date"), F.min("review_date")).alias("d")).first().d
    deduped = Z.stream_dedup(feeds[0].unionByName(feeds[1]), f"{(days or 0) + 1} days")
    out = Z.run_available(deduped.select("review_id", "review_text", "rating"), "stream-dedup")
    return spark.read.parquet(out)


@query
def stream_first_arrival(spark, sf):
    """Both feeds as one stream of several batches; of every review the row of the first feed."""
    paths = _landing_feeds(spark, sf)
    feeds = [
        S.conform_schema(Z.read_json_stream(spark, p, LANDING, per_batch=4), RAW).withColumn("feed_rank", F.lit(i))
        for i, p in enumerate(paths)
    ]
    span = F.datediff(F.max("review_date"), F.min("review_date"))
    days, expected = V.reviews(spark, sf).agg(span, F.count(F.lit(1))).first()
    order = [("feed_rank", False), ("review_date", True), ("review_text", False)]
    stacked = feeds[1].unionByName(feeds[0])
    firsts = Y.stream_first(stacked, timedelta(days=(days or 0) + 1), "review_id", "review_date", order, expected_keys=expected)
    out = Z.run_available(firsts, "stream-first", "update")
    return Y.last_updates(spark, out, "review_id").select("review_id", "review_text", "rating", "helpful_count")


@query
def stream_aspect_counts(spark, sf):
    documents = V.table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    stream = V.as_reviews(Z.read_table_stream(spark, f"{sf}/documents.parquet*", documents.schema, spread_over=cores))
    out = Z.count_available(Z.stream_score(stream, LEXICON), "stream-counts", "review_date")
    total = Z.summed_batches(spark, out, ["window", "aspect", "sentiment"], "n")
    utc = F.to_utc_timestamp("window.start", F.current_timezone())
    return total.select(F.date_format(utc, "yyyy-MM-dd").alias("day"), "aspect", "sentiment", "n")

"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentika.llm import (
    collocations,
    decontamination,
    hidden_markov,
    mixing,
    near_dedup,
    periodic_runs,
    secrets,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
    vector_search,
    warc,
)
from sentika.llm.common import table
from sentika.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Bytes and tokens of every document."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), str(tokenizer_path))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontamination.items_digest().alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document."""
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "vslot", "map_version"
    )


def op4_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, scanned once for each distinct text."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    spans = secrets.spans_text()
    return found.select(
        "doc_id",
        *[secrets.count_of(r.kind).alias(f"n_{r.kind}") for r in secrets.RULES],
        F.sha2(spans.cast("binary"), 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to segmented archives and read back from them."""
    path = scratch_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    index = warc.archive_index(warc.read_archives(spark, path))
    return index.select(
        F.col("page").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents")
    tagger = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, tagger).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


def op8_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken to reach the weights with half of all tokens."""
    docs = table(spark, sf_dir, "documents").withColumn("domain", mixing.domain_of())
    mixed = mixing.mix(docs, mixing.LEVELS, mixing.WEIGHTS, budget_share=0.5, max_epochs=4, seed=1)
    return mixed.select("doc_id", *mixing.LEVELS, "tokens", "budget", "copies")


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of one in a hundred."""
    return vector_search.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes."""
    left = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return left.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a hidden Markov model, beside its unigram score."""
    return hidden_markov.score(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of every language."""
    best = collocations.collocations(table(spark, sf_dir, "documents"))
    return best.withColumn("rank", F.col("rank").cast("long"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of which is made periodic first."""
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)
    best = periodic_runs.longest_run()
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        periodic_runs.run_digest().alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_decontamination,
        op3_virtual_slots,
        op4_circulant_minhash,
        op5_blob_ledger,
        op6_warc_segments,
        op7_toxic_spans,
        op8_hierarchical_mixing,
        op9_kmeans_tree,
        op10_suffix_dedup,
        op11_hidden_markov,
        op12_collocations,
        op13_periodic_runs,
    )
}

"""A training corpus from raw documents, stage by stage.

Every stage is ``(name, function)``; a function takes the session, the documents its
predecessor kept and the folder of tables, and returns a DataFrame, which is written and read
again before the next stage. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentika.llm import decontamination, mixing, near_dedup, sharding, toxicity
from sentika.llm.common import ship, table, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, learned from two thirds of the labels, does not reject."""
    tagger = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, tagger)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ship(spark)
    return near_dedup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of domains, languages and sources ask for.

    A quarter more tokens than there are, and two epochs at most: branches below their weight
    repeat documents, branches above it lose some.
    """
    # the row is carried whole, so that no column of its own is replaced
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang", "source", mixing.domain_of().alias("domain"))
    taken = mixing.mix(packed, mixing.LEVELS, mixing.WEIGHTS, budget_share=1.25, max_epochs=2)
    return mixing.repeated(taken).select("_row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every document, with its columns."""
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("near_dedup", distinct),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL has no trained tagger and no signatures; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}", "snappy")
    return docs

"""File sources and sinks: CSV, parquet, JSON, all with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentika.schemas import LANDING, RAW, TRAINING_LOG


#: Rows of a CSV file: one task reads a whole file, as quoted line breaks keep it from being split.
MAX_ROWS = 20_000


def scan_reviews_csv(
    spark: SparkSession, path: str, schema: T.StructType = RAW, spread_over: int | None = None
) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; a byte-order mark is
    skipped. Such files cannot be split: ``spread_over`` redistributes the rows of a few
    large ones."""
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
    return rows.repartition(spread_over) if spread_over else rows


def scan_reviews(spark: SparkSession, path: str, spread_over: int | None = None) -> DataFrame:
    """Review table in the native columnar format; ``spread_over`` redistributes the rows
    of a table with fewer row groups than cores."""
    rows = spark.read.parquet(path)
    return rows.repartition(spread_over) if spread_over else rows


def scan_landing_pages(spark: SparkSession, path: str, schema: T.StructType = LANDING) -> DataFrame:
    """Collected pages of one feed: a folder of JSON-lines files."""
    return spark.read.schema(schema).json(path)


def scan_training_log(spark: SparkSession, path: str) -> DataFrame:
    """The per-epoch log inside a metrics document, as a table."""
    return spark.read.schema(TRAINING_LOG).option("multiLine", True).json(path).select(F.inline("training_log"))


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Arrays become pipe-joined text, maps and structs become JSON text."""

    def flat(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(column.cast("array<string>"), "|").alias(field.name)
        if isinstance(field.dataType, (T.MapType, T.StructType)):
            return F.to_json(column).alias(field.name)
        return column

    return df.select(*[flat(f) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    (
        flatten_for_csv(df)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", MAX_ROWS)
        .csv(path)
    )


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

"""Row selection: filters, dedup, unions, ordinals, samples, splits, folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sentika.functions.text import SPACE, strip_space
from sentika.schemas import ANNOTATION_BLANK, ANNOTATION_INPUT, SOURCE_COLUMNS
from sentika.session import broadcast_if_small, reliable_checkpoint


# ---- shape ------------------------------------------------------------------

def conform_schema(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Rename feed columns to their canonical names; absent ones are skipped and
    extra ones kept. With ``schema``, also select and cast to exactly its columns,
    filling absent ones with null."""
    renamed = df.withColumnsRenamed(SOURCE_COLUMNS)
    if schema is None:
        return renamed
    return renamed.select(
        *[
            (F.col(f.name) if f.name in renamed.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def annotation_projection(df: DataFrame) -> DataFrame:
    """Columns an annotator needs, where present, and the blank ones to fill in."""
    kept = df.select(*[c for c in ANNOTATION_INPUT if c in df.columns])
    return kept.withColumns({c: F.lit("") for c in ANNOTATION_BLANK})


def fill_defaults(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace nulls of the named columns; a column that is absent is added."""
    present = {c: v for c, v in values.items() if c in df.columns}
    absent = {c: F.lit(v) for c, v in values.items() if c not in df.columns}
    filled = df.fillna(present) if present else df
    return filled.withColumns(absent) if absent else filled


# ---- filters ----------------------------------------------------------------

def long_enough(text: Column, more_than: int = 5) -> Column:
    """More than ``more_than`` characters are left after stripping white space: that
    many lie between, and including, two that are not white space."""
    if more_than < 1:
        return F.length(strip_space(text)) > more_than
    return text.rlike(rf"(?s)[^{SPACE}].{{{more_than - 1},}}[^{SPACE}]")


def filter_audit(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows before, after and removed by each filter, applied one after another,
    counted in a single pass."""
    steps, kept = [], F.lit(True)
    totals = [F.count(F.lit(1)).alias("before_0")]
    for i, condition in enumerate(conditions.values()):
        kept = kept & F.coalesce(condition, F.lit(False))
        totals.append(F.count_if(kept).alias(f"before_{i + 1}"))
    for i, name in enumerate(conditions):
        before, after = F.col(f"before_{i}"), F.col(f"before_{i + 1}")
        steps.append(
            F.struct(
                F.lit(i + 1).alias("step"),
                F.lit(name).alias("filter"),
                before.alias("rows_before"),
                after.alias("rows_after"),
                (before - after).alias("rows_removed"),
            )
        )
    return df.agg(*totals).select(F.inline(F.array(*steps)))


def write_filtered(df: DataFrame, conditions: dict[str, Column], path: str) -> DataFrame:
    """Write the rows that pass all filters to a fresh parquet folder; returns the audit of the filters.

    The counts are observed by the tasks that write, so the input is read once. Columns and order
    are those of :func:`filter_audit`; a null condition removes the row, and an empty table gives zeros.
    """
    kept, totals = F.lit(True), [F.count(F.lit(1)).alias("rows_0")]
    for i, condition in enumerate(conditions.values()):
        kept = kept & F.coalesce(condition, F.lit(False))
        totals.append(F.count_if(kept).alias(f"rows_{i + 1}"))
    seen = Observation()
    df.observe(seen, *totals).where(kept).write.parquet(path)
    counts = [seen.get[f"rows_{i}"] for i in range(len(totals))]
    rows = [(i + 1, name, counts[i], counts[i + 1], counts[i] - counts[i + 1]) for i, name in enumerate(conditions)]
    return df.sparkSession.createDataFrame(
        rows, "step int, filter string, rows_before long, rows_after long, rows_removed long"
    )


# ---- dedup and union --------------------------------------------------------

def union_feeds(feeds: Sequence[DataFrame], rank_col: str = "feed_rank") -> DataFrame:
    """Stack feeds in priority order; the first one has rank 0."""
    ranked = [feed.withColumn(rank_col, F.lit(i)) for i, feed in enumerate(feeds)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def dedup_keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; null keys count as one key.

    The rank filter lets every task drop all but its own first row of a key before
    the shuffle, so a key that holds a large share of the rows sends one row per
    task and not its whole group.
    """
    first = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")


# ---- ordinals and folds -----------------------------------------------------

def dense_ordinal(df: DataFrame, order: Sequence[str | Column], name: str = "ordinal") -> DataFrame:
    """Contiguous positions 0, 1, 2, ... by ``order`` (its values must be unique rows).

    A global window would sort everything in one task. Here rows are range
    partitioned and sorted, the partition numbering is pinned by a reliable
    checkpoint, and each row adds the size of the earlier partitions to its own
    position. The offsets are one row per partition. The input is read twice, once to
    sample the ranges, so pass a table or a checkpoint if it is costly to compute.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = reliable_checkpoint(
        ranged.withColumns(
            {"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}
        )
    )
    first_of = F.shiftleft(F.col("__part").cast("bigint"), 33)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    return (
        placed.join(F.broadcast(offsets), "__part")  # one row per partition
        .withColumn(name, F.col("__row") - first_of + F.col("__offset"))
        .drop("__part", "__row", "__offset")
    )


def first_rows(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows by ``order`` (unique), of any size: no task holds them all."""
    return dense_ordinal(df, order, "__ordinal").where(F.col("__ordinal") < n).drop("__ordinal")


def kfold_contiguous(df: DataFrame, order: Sequence[str], k: int = 5, name: str = "fold") -> DataFrame:
    """Contiguous unshuffled folds 0..k-1 by row order; the first n % k folds get
    one extra row."""
    placed = dense_ordinal(df, order, "__ordinal")
    n = placed.agg(F.count(F.lit(1)).alias("n")).first().n
    size, extra = divmod(n, k)
    long_part = extra * (size + 1)
    fold = F.when(F.col("__ordinal") < long_part, F.floor(F.col("__ordinal") / (size + 1))).otherwise(
        extra + F.floor((F.col("__ordinal") - long_part) / max(size, 1))
    )
    return placed.withColumn(name, fold.cast("int")).drop("__ordinal")


def kfold_hashed(df: DataFrame, key: str, k: int = 5, name: str = "fold") -> DataFrame:
    """Folds from an md5 of the key: no sort, no shuffle, stable for each row."""
    return df.withColumn(name, F.floor(hash_unit(F.col(key), "fold") * k).cast("int"))


# ---- samples and splits -----------------------------------------------------

def hash_order(key: Column, seed: int) -> Column:
    """A reproducible random order: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_unit(key: Column, seed: int | str) -> Column:
    """A reproducible number in [0, 1) for each key."""
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(4294967296.0)


def _first_rows_by_hash(df: DataFrame, n: int, key: str, seed: int, strata: str | None = None) -> DataFrame:
    """The first n rows in hash order, of all rows or of each stratum.

    Exact sizes of 65,536 hash buckets tell which buckets are taken whole; only the one
    bucket where the cut falls is ranked, so no task holds the n rows. Counting reads
    only the key.
    """
    bucket = (hash_unit(F.col(key), seed) * 65536).cast("int")
    group = [strata] if strata else []
    sizes = df.groupBy(*group, bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__bucket")
    needed = sizes.withColumn("__before", F.sum("__n").over(upto) - F.col("__n")).where(F.col("__before") < n)
    last = F.max(F.struct("__bucket", "__before"))
    cuts = needed.groupBy(*group).agg(last["__bucket"].alias("__cut"), (n - last["__before"]).alias("__room"))
    if strata:
        tagged = df.join(broadcast_if_small(cuts), strata)
    else:
        cut = cuts.first()
        if cut is None or cut["__cut"] is None:
            return df
        tagged = df.withColumns({"__cut": F.lit(cut["__cut"]), "__room": F.lit(cut["__room"])})
    tagged = tagged.withColumn("__bucket", bucket)
    within = Window.partitionBy(*group, "__bucket").orderBy(hash_order(F.col(key), seed), F.col(key))
    ranked = tagged.where("__bucket = __cut").withColumn("__rank", F.row_number().over(within))
    partial = ranked.where("__rank <= __room").drop("__rank")
    return tagged.where("__bucket < __cut").unionByName(partial).drop("__cut", "__room", "__bucket")


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """min(n, rows) rows in reproducible random order.

    Runs a job that counts hash buckets of the key. The order is a distributed sort.
    """
    return _first_rows_by_hash(df, n, key, seed).orderBy(hash_order(F.col(key), seed), key)


def stratified_sample(
    df: DataFrame, n: int = 500, strata: str = "rating", key: str = "review_id", groups: int = 5, seed: int = 42
) -> DataFrame:
    """Up to n // groups rows of each stratum, shuffled, n at most; null strata drop out.
    Without the stratum column it is a plain sample of n.

    Runs jobs that count hash buckets, per stratum and of what is picked.
    """
    if strata not in df.columns:
        return random_sample(df, n, key, seed)
    picked = _first_rows_by_hash(df.where(F.col(strata).isNotNull()), n // groups, key, seed, strata)
    return random_sample(picked, n, key, seed)


def train_val_test_split(
    df: DataFrame,
    key: str = "review_id",
    train: float = 0.70,
    val: float = 0.15,
    seed: int = 42,
    name: str = "split",
) -> DataFrame:
    """Random split by a hash of the key: no shuffle, and a row never changes side."""
    u = hash_unit(F.col(key), seed)
    side = F.when(u < train, "train").when(u < train + val, "val").otherwise("test")
    return df.withColumn(name, side)


def oversample_minority(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Repeat rows of the smaller classes until every class is as large as the largest.

    A class of n rows is copied ``max // n`` times whole, and the rest is made up by
    the rows that come first in hash order. Exact counts of 4,096 hash buckets tell
    which buckets are taken whole; only the one bucket per class where the cut falls
    is ranked, so no class is sorted in one task. The counts are written once.
    """
    u = (hash_unit(F.col(key), seed) * 4096).cast("int")
    tagged = df.where(F.col(label).isNotNull()).withColumn("__bucket", u)
    sizes = reliable_checkpoint(
        tagged.groupBy(label, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    )
    per_class = sizes.groupBy(label).agg(F.sum("__n").alias("__class"))
    running = Window.partitionBy(label).orderBy("__bucket")
    largest = F.max("__class").over(Window.partitionBy(F.lit(0)))
    room = F.col("__extra") - (F.sum("__n").over(running) - F.col("__n"))
    plan = (
        sizes.join(
            per_class.withColumns(
                {
                    "__whole": F.floor(largest / F.col("__class")).cast("int"),
                    "__extra": largest % F.col("__class"),
                }
            ),
            label,
        )
        .withColumn("__take", F.greatest(F.least(room, F.col("__n")), F.lit(0)))
        .select(label, "__bucket", "__whole", "__take", "__n")
    )
    planned = tagged.join(broadcast_if_small(plan), [label, "__bucket"])
    cut = (F.col("__take") > 0) & (F.col("__take") < F.col("__n"))
    within = Window.partitionBy(label, "__bucket").orderBy(hash_order(F.col(key), seed), key)
    whole = planned.where(~cut).withColumn("__extra", (F.col("__take") > 0).cast("int"))
    partial = planned.where(cut).withColumn(
        "__extra", (F.row_number().over(within) <= F.col("__take")).cast("int")
    )
    return (
        whole.unionByName(partial)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__whole") + F.col("__extra"))))
        .drop("__bucket", "__whole", "__take", "__n", "__extra")
    )

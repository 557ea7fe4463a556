"""Topics of texts: mini-batch k-means on sparse TF-IDF, several starts at once, the cheapest kept.

Rows of hashed words are written once, dealt by hash to mini-batches. A step is one Spark job over a
mini-batch that moves the centres of all starts: tasks add up the rows nearest to each centre, Spark
sums them by feature, and the driver holds ``starts x k`` centres of ``num_features`` numbers,
whatever the corpus. The cost of every start is then summed over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentika.operators.joint import Features, hashed_words
from sentika.operators.lookups import term_frequencies, top_terms_per_group
from sentika.session import broadcast_if_small, evaluate_once, scratch_path

_ENTRIES = 1 << 13  # multiplied at a time, so that their products stay in the cache


@dataclass(frozen=True)
class TopicConfig:
    k: int = 8
    starts: int = 10
    epochs: int = 1
    batches: int = 8  # steps of an epoch
    num_features: int = 1 << 12
    seed: int = 42


def _pieces(features: Features, hashed: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, rows, and row, feature and value of the entries, some rows at a time."""
    ends = np.cumsum(np.diff(hashed.offsets.to_numpy()))
    cuts = np.flatnonzero(np.diff(ends // _ENTRIES, prepend=0)) if len(ends) else []
    edges = [0, *(int(c) for c in cuts if c), len(hashed)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            row, feature, value = features.of(hashed.slice(a, b - a))
            own = (feature < len(features.idf)) & (value > 0)  # without the constant
            yield a, b - a, row[own], feature[own], value[own]


def _distances(row, feature, value, rows: int, by_feature: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of every row to every centre, and which rows have a feature at all."""
    out = np.zeros((rows, by_feature.shape[1]))
    held = np.zeros(rows, bool)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        parts = by_feature.take(feature, axis=0)
        parts *= value[:, None]
        out[row[first]] = np.add.reduceat(parts, first, axis=0)
        held[row[first]] = True
    return np.maximum(1.0 - 2.0 * out + norms, 0.0), held


def _moving(features: Features, shared, starts: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_feature, norms = shared.value
        width, slots = by_feature.shape
        total = np.zeros((width + 1, slots))  # the last row counts
        flat = total.reshape(-1)  # one index a number is added faster than two
        for batch in batches:
            for _, n, row, feature, value in _pieces(features, batch.column(0)):
                far, held = _distances(row, feature, value, n, by_feature, norms)
                for s in range(starts):
                    slot = s * k + far[:, s * k : (s + 1) * k].argmin(axis=1)
                    np.add.at(flat, feature * slots + slot[row], value)
                    total[width] += np.bincount(slot[held], minlength=slots)
        seen = np.flatnonzero(total.any(axis=1))
        yield pa.record_batch({"feature": pa.array(seen, pa.int64()), **{f"g{j}": pa.array(total[seen, j]) for j in range(slots)}})

    return run


def _costs(features: Features, shared, starts: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_feature, norms = shared.value
        cost, texts = np.zeros(starts), 0
        for batch in batches:
            for _, n, row, feature, value in _pieces(features, batch.column(0)):
                far, held = _distances(row, feature, value, n, by_feature, norms)
                cost += far[held].reshape(-1, starts, k).min(axis=2).sum(axis=0)
                texts += int(held.sum())
        yield pa.record_batch(
            {"start": pa.array(np.arange(starts), pa.int32()), "cost": pa.array(cost), "texts": pa.array([texts] * starts, pa.int64())}
        )

    return run


def _nearest(features: Features, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_feature, norms = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("__hashed")
            ids, distances = [], []
            for _, n, row, feature, value in _pieces(features, batch.column(at)):
                far, held = _distances(row, feature, value, n, by_feature, norms)
                ids.append(pa.array(far.argmin(axis=1), pa.int32(), mask=~held))
                distances.append(pa.array(far.min(axis=1), pa.float64(), mask=~held))
            kept = [i for i in range(batch.num_columns) if i != at]
            made = [
                pa.concat_arrays(ids) if ids else pa.array([], pa.int32()),
                pa.concat_arrays(distances) if distances else pa.array([], pa.float64()),
            ]
            yield pa.record_batch(
                [*[batch.column(i) for i in kept], *made],
                [*[batch.schema.names[i] for i in kept], "cluster_id", "topic_distance"],
            )

    return run


def _by_feature(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = centres.reshape(-1, centres.shape[-1])
    return np.ascontiguousarray(flat.T), (flat * flat).sum(axis=1)


@dataclass(frozen=True)
class TopicModel:
    """Centres of one start, ``k`` rows of ``num_features`` numbers."""

    features: Features
    centres: np.ndarray
    text_col: str

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``cluster_id`` (nearest centre, ties to the smaller) and ``topic_distance`` (squared).

        A null or empty text, or one whose words all occur in every text, has no topic: both are null.
        Columns of these names are replaced.
        """
        kept = df.drop("cluster_id", "topic_distance", "__hashed")
        rows = kept.withColumn("__hashed", hashed_words(self.text_col, len(self.features.idf)))
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
        shared = df.sparkSession.sparkContext.broadcast(_by_feature(self.centres))
        return rows.mapInArrow(_nearest(self.features, shared), f"{shape}, cluster_id int, topic_distance double")

    def weights(self, spark: SparkSession) -> DataFrame:
        """``feature, idf, centre``: a row for each feature, the centres' numbers side by side."""
        rows = [(i, float(w), self.centres[:, i].tolist()) for i, w in enumerate(self.features.idf)]
        return spark.createDataFrame(rows, "feature int, idf double, centre array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        self.weights(spark).coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, text_col: str = "clean_text") -> "TopicModel":
        rows = spark.read.parquet(path).orderBy("feature").collect()  # num_features rows
        return cls(Features(np.array([r.idf for r in rows])), np.array([r.centre for r in rows]).T, text_col)


@dataclass(frozen=True)
class Topics:
    model: TopicModel
    costs: DataFrame  # start, cost, texts, kept


class TopicTraining:
    """One run; ``rows`` hold hashed words by mini-batch."""

    def __init__(self, df: DataFrame, text_col: str = "clean_text", config: TopicConfig = TopicConfig()):
        self.config, self.text_col = config, text_col
        spark = self.spark = df.sparkSession
        hashed = hashed_words(text_col, config.num_features)
        path = scratch_path(spark, "topic-rows")
        # the whole row is hashed, so that a text that occurs often is dealt to all batches
        deal = F.pmod(F.xxhash64(F.lit(config.seed), *[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(config.batches))
        of_text = F.xxhash64(F.lit(config.seed), F.sort_array("hashed")).alias("h")
        rows = evaluate_once(df, {"hashed": hashed, "batch": deal.cast("int")}).select("hashed", of_text, "batch")
        rows.where(F.size("hashed") > 0).write.partitionBy("batch").parquet(path)
        self.rows = spark.read.schema("hashed array<int>, h long, batch int").parquet(path)
        held = self.rows.select(F.explode(F.array_distinct("hashed")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
        texts = self.rows.count()
        idf = np.full(config.num_features, np.log(texts + 1.0))
        for r in held.collect():  # a row for each feature at most
            idf[r.f] = np.log((texts + 1.0) / (r.n + 1.0))
        self.features = Features(idf)

    def first_centres(self) -> np.ndarray:
        """Different texts in hash order, ``k`` for each start; repeated where there are too few."""
        c = self.config
        chosen = self.rows.select("h").distinct().orderBy("h").limit(c.starts * c.k)
        found = self.rows.select("hashed", "h").join(F.broadcast(chosen), "h").dropDuplicates(["h"]).orderBy("h").collect()  # starts x k rows
        if not found:
            raise ValueError("no text with words")
        lists = pa.array([r.hashed for r in found], pa.list_(pa.int32()))
        dense = np.zeros((len(found), c.num_features))
        for a, _, row, feature, value in _pieces(self.features, lists):
            dense[a + row, feature] = value
        return dense[np.arange(c.starts * c.k) % len(found)].reshape(c.starts, c.k, -1)

    def step(self, centres: np.ndarray, seen: np.ndarray, batch: int) -> tuple[np.ndarray, np.ndarray]:
        """Centres after one mini-batch: the mean of all rows a centre was ever nearest to, as they came."""
        c = self.config
        shared = self.spark.sparkContext.broadcast(_by_feature(centres))
        names = [f"g{j}" for j in range(c.starts * c.k)]
        parts = (
            self.rows.where(F.col("batch") == batch)
            .select("hashed")
            .mapInArrow(_moving(self.features, shared, c.starts, c.k), ", ".join(["feature long", *[f"{g} double" for g in names]]))
        )
        sums = np.zeros((c.num_features + 1, c.starts * c.k))
        for r in parts.groupBy("feature").agg(*[F.sum(g).alias(g) for g in names]).collect():  # num_features + 1 rows at most
            sums[r.feature] = r[1:]
        shared.unpersist()
        counts = sums[-1].reshape(c.starts, c.k)
        total = seen + counts
        moved = sums[:-1].T.reshape(centres.shape) - counts[:, :, None] * centres
        return centres + moved / np.maximum(total, 1.0)[:, :, None], total

    def run(self) -> Topics:
        c = self.config
        centres, seen = self.first_centres(), np.zeros((c.starts, c.k))
        for _ in range(c.epochs):
            for batch in range(c.batches):
                centres, seen = self.step(centres, seen, batch)
        shared = self.spark.sparkContext.broadcast(_by_feature(centres))
        parts = self.rows.select("hashed").mapInArrow(
            _costs(self.features, shared, c.starts, c.k), "start int, cost double, texts long"
        )
        costs = parts.groupBy("start").agg(F.sum("cost"), F.sum("texts")).collect()  # a row for each start
        best = min(costs, key=lambda r: (r[1], r[0]))[0]
        table = self.spark.createDataFrame(
            [(*r, r[0] == best) for r in costs], "start int, cost double, texts long, kept boolean"
        )
        return Topics(TopicModel(self.features, centres[best], self.text_col), table)


def fit_text_topics(df: DataFrame, text_col: str = "clean_text", config: TopicConfig = TopicConfig()) -> Topics:
    """Fit topics of all texts with words; ties between starts go to the smaller. Runs jobs."""
    return TopicTraining(df, text_col, config).run()


def topic_terms(assigned: DataFrame, k: int = 10, text_col: str = "clean_text", stop_words=()) -> DataFrame:
    """The ``k`` most frequent terms of each topic; texts without a topic are left out."""
    counts = term_frequencies(assigned.where(F.col("cluster_id").isNotNull()), stop_words, "cluster_id", text_col)
    return top_terms_per_group(counts, "cluster_id", k)


def counted_words(df: DataFrame, key: str, text_col: str, num_features: int) -> DataFrame:
    """``key, entries``: the different hashed words of each text, in order, with how often they occur.

    A text is counted within its row, without a shuffle. Only rows whose key comes again, which are one
    text, meet by key and word.
    """
    spark = df.sparkSession
    hashed = hashed_words(text_col, num_features).alias("hashed")
    path = scratch_path(spark, "topic-keys")
    df.groupBy(F.col(key).alias("again")).count().where("count > 1").select("again").write.parquet(path)
    keys = spark.read.parquet(path)
    rows, same = df.select(F.col(key).alias("key"), hashed), F.col("key").eqNullSafe(F.col("again"))
    none = keys.isEmpty()
    keys = broadcast_if_small(keys)
    single = evaluate_once(rows if none else rows.join(keys, same, "left_anti"), {"hashed": F.sort_array("hashed")})
    starts = F.transform("hashed", lambda w, i: F.when((i == 0) | (w != F.get("hashed", i - 1)), i))
    single = evaluate_once(single, {"starts": F.array_compact(starts)})
    entry = lambda p, i: F.struct(
        F.get("hashed", p).alias("feature"), (F.coalesce(F.get("starts", i + 1), F.size("hashed")) - p).cast("long").alias("n")
    )
    counts = single.select("key", F.transform("starts", entry).alias("entries"))
    if none:
        return counts
    met = rows.join(keys, same, "left_semi").select("key", F.explode("hashed").alias("feature")).groupBy("key", "feature")
    listed = F.sort_array(F.collect_list(F.struct("feature", "n")))  # num_features at most
    return counts.union(met.agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(listed.alias("entries")))


def cost_by_join(df: DataFrame, model: TopicModel, key: str, text_col: str = "clean_text") -> DataFrame:
    """``texts, cost, one_centre``: the cost again, by joins and sums alone, and that of the mean of all rows.

    ``key`` must be unique. Counts are written once; what is shuffled has a row for each text, or feature and task.
    """
    spark, k = df.sparkSession, len(model.centres)
    path, counts_path = scratch_path(spark, "topic-weights"), scratch_path(spark, "topic-counts")
    model.save(spark, path)
    weights = spark.read.parquet(path)  # num_features rows
    idf = weights.agg(F.sort_array(F.collect_list(F.struct("feature", "idf"))).alias("w")).select(F.col("w.idf").alias("by_feature"))
    squares = F.aggregate("entries", F.lit(0.0), lambda a, e: a + F.pow(e["n"] * F.get("by_feature", e["feature"]), F.lit(2.0)))
    counts = counted_words(df, key, text_col, len(model.features.idf)).crossJoin(F.broadcast(idf))
    counts.select("key", "entries", F.sqrt(squares).alias("whole")).write.option("compression", "zstd").parquet(counts_path)
    counts = spark.read.parquet(counts_path).select("key", "whole", F.inline("entries"))
    raw = counts.join(F.broadcast(weights), "feature").withColumn("v", F.col("n") * F.col("idf")).where("v > 0")
    products = [F.sum(F.col("v") * F.get("centre", F.lit(j))) for j in range(k)]
    norms = (model.centres**2).sum(axis=1)
    length = F.sqrt(F.sum(F.col("v") * F.col("v")))
    rows = raw.groupBy("key").agg(F.least(*[F.lit(float(q)) - 2 * p / length for p, q in zip(products, norms)]).alias("d"))
    mean = raw.where(F.col("key").isNotNull()).groupBy("feature").agg(F.sum(F.col("v") / F.col("whole")).alias("m"))
    square = mean.agg(F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0)).alias("square"))
    totals = rows.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(1 + F.col("d")), F.lit(0.0)).alias("cost"))
    return totals.crossJoin(square).select(  # one row each
        "texts", "cost", (F.col("texts") - F.col("square") / F.greatest(F.col("texts"), F.lit(1))).alias("one_centre")
    )

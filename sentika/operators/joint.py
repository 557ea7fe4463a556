"""Both tasks trained together: one set of hashed words, two linear heads, one loss, a log of its own.

The loss is that of the two-task model: binary cross-entropy of all aspects plus class-weighted
cross-entropy of the sentiments of the aspects a review is about (others are masked), each a mean
over the mini-batch. Rows are written once, dealt by hash to the mini-batches of an epoch. A step is
one Spark job over its batch: tasks add up gradients of the features they meet, Spark sums them by
feature, and the driver makes the step on a table of ``num_features`` rows, whatever the corpus.
After each epoch the validation rows are scored and a line of the log is written; the weights of
the best epoch are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentika.functions.text import words
from sentika.operators.distributions import class_weights
from sentika.operators.metrics import best_checkpoint, combined_f1, long_labels
from sentika.operators.models import label_arrays
from sentika.operators.selection import hash_unit, train_val_test_split
from sentika.session import scratch_path
from sentika.sources import files

MOODS = 3
_WORDS = 1 << 15  # of the rows a task works on at a time
SCORED = "aspect_probs array<double>, aspect_pred array<int>, sentiment_probs array<array<double>>, sentiment_pred array<int>"


@dataclass(frozen=True)
class JointConfig:
    num_features: int = 1 << 16
    epochs: int = 5
    batches: int = 8  # steps of an epoch
    rate: float = 0.05
    warmup: float = 0.1  # share of the steps in which the rate grows
    decay: float = 0.01  # of the weights, each step, times the rate
    clip: float = 1.0  # longest gradient
    aspect_weight: float = 1.0
    sentiment_weight: float = 1.0
    threshold: float = 0.5
    seed: int = 42


class Features:
    """Rows of hashed words as sparse TF-IDF of length one, with a constant feature behind them."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def of(self, hashed: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and value of every entry."""
        offsets = hashed.offsets.to_numpy()
        sizes = np.diff(offsets)
        flat = hashed.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
        width = len(self.idf)
        keys, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + flat, return_counts=True)
        row, feature = keys // width, keys % width
        value = counts * self.idf[feature]
        norm = np.sqrt(np.bincount(row, weights=value * value, minlength=len(sizes)))
        value = value / np.where(norm > 0, norm, 1.0)[row]
        every = np.arange(len(sizes))
        return np.append(row, every), np.append(feature, np.full(len(sizes), width)), np.append(value, np.ones(len(sizes)))


def logits(entries: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, weights: np.ndarray) -> np.ndarray:
    """Values of all output columns: the aspects', then three for each aspect."""
    row, feature, value = entries
    parts = np.ascontiguousarray(weights.T)[:, feature] * value
    return np.stack([np.bincount(row, weights=p, minlength=rows) for p in parts], axis=1)


def outputs(z: np.ndarray, aspects: int) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each aspect, and of each sentiment of each aspect."""
    moods = z[:, aspects:].reshape(len(z), aspects, MOODS)
    moods = np.exp(moods - moods.max(axis=2, keepdims=True))
    return 1.0 / (1.0 + np.exp(-z[:, :aspects])), moods / moods.sum(axis=2, keepdims=True)


def loss_sums(z: np.ndarray, truth: np.ndarray, mood: np.ndarray, of_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of both losses with their weights, and what each output adds to the gradient.

    Returns ``[aspect loss, its terms, sentiment loss, its weight]`` and an array like ``z``.
    """
    n, aspects = truth.shape
    p, q = outputs(z, aspects)
    raw = z[:, :aspects]
    binary = np.logaddexp(0.0, raw) - truth * raw  # stable form of the cross-entropy
    known = mood >= 0
    chosen = np.where(known, mood, 0)
    weight = np.where(known, of_class[chosen], 0.0)
    own = np.take_along_axis(q, chosen[:, :, None], axis=2)[:, :, 0]
    gradient = weight[:, :, None] * (q - (np.arange(MOODS) == chosen[:, :, None]))
    sums = np.array([binary.sum(), float(truth.size), (-weight * np.log(np.maximum(own, 1e-300))).sum(), weight.sum()])
    return sums, np.concatenate([p - truth, gradient.reshape(n, -1)], axis=1)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _pieces(batch: pa.RecordBatch, words_of: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """The rows of a batch some at a time, so that what is made of them stays small however long they are."""
    ends = np.cumsum(np.diff(words_of.offsets.to_numpy()))
    cuts = np.flatnonzero(np.diff(ends // _WORDS, prepend=0))
    edges = [0, *(int(c) for c in cuts if c), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def _gradients(features: Features, weights, of_class: np.ndarray, aspects: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = None, np.zeros(4)
        touched = np.zeros(len(features.idf) + 1, bool)
        for batch in (piece for whole in batches for piece in _pieces(whole, whole.column(0))):
            entries = features.of(batch.column(0))
            z = logits(entries, batch.num_rows, weights.value)
            own, by_output = loss_sums(z, _matrix(batch.column(1), aspects), _matrix(batch.column(2), aspects), of_class)
            row, feature, value = entries
            parts = np.ascontiguousarray(by_output.T)[:, row] * value
            found = np.stack([np.bincount(feature, weights=p, minlength=len(weights.value)) for p in parts])
            total = found if total is None else total + found
            touched[feature] = True
            sums += own
        if total is None:
            return
        seen = np.flatnonzero(touched)
        rows = np.concatenate([total[:, seen].T, np.pad(sums, (0, len(total) - 4))[None]])
        yield pa.record_batch(
            {"feature": pa.array(np.append(seen, -1), pa.int64()), **{f"g{k}": pa.array(rows[:, k]) for k in range(rows.shape[1])}}
        )

    return run


def _scores(features: Features, weights, aspects: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole, whole.column(whole.schema.get_field_index("hashed")))):
            hashed = batch.column(batch.schema.get_field_index("hashed"))
            p, q = outputs(logits(features.of(hashed), batch.num_rows, weights.value), aspects)
            kept = [batch.column(i) for i, f in enumerate(batch.schema.names) if f != "hashed"]
            names = [f for f in batch.schema.names if f != "hashed"]
            made = [
                pa.array(list(p), pa.list_(pa.float64())),
                pa.array(list((p >= threshold).astype(np.int32)), pa.list_(pa.int32())),
                pa.array([list(x) for x in q], pa.list_(pa.list_(pa.float64()))),
                pa.array(list(q.argmax(axis=2).astype(np.int32)), pa.list_(pa.int32())),
            ]
            yield pa.record_batch([*kept, *made], [*names, "aspect_probs", "aspect_pred", "sentiment_probs", "sentiment_pred"])

    return run


@dataclass(frozen=True)
class JointModel:
    """Weights of both heads: a row for each feature and one for the constant."""

    features: Features
    weights: np.ndarray
    aspects: tuple[str, ...]
    text_col: str
    threshold: float = 0.5

    def transform(self, df: DataFrame) -> DataFrame:
        """Add probabilities and predictions of both tasks; null texts are scored by the constant alone."""
        hashed = df.withColumn("hashed", hashed_words(self.text_col, len(self.features.idf)))
        weights = df.sparkSession.sparkContext.broadcast(self.weights)
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return hashed.mapInArrow(_scores(self.features, weights, len(self.aspects), self.threshold), f"{kept}, {SCORED}")

    def save(self, spark: SparkSession, path: str) -> None:
        """A table of one row for each feature."""
        idf = np.append(self.features.idf, 1.0)
        rows = [(i, float(w), self.weights[i].tolist()) for i, w in enumerate(idf)]
        spark.createDataFrame(rows, "feature int, idf double, weights array<double>").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, aspects: Sequence[str], text_col: str = "clean_text") -> "JointModel":
        rows = spark.read.parquet(path).orderBy("feature").collect()
        return cls(Features(np.array([r.idf for r in rows[:-1]])), np.array([r.weights for r in rows]), tuple(aspects), text_col)


def hashed_words(text_col: str, num_features: int):
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(num_features)).cast("int"))


@dataclass(frozen=True)
class JointTrained:
    model: JointModel
    log: DataFrame
    best: DataFrame
    log_path: str
    rows: DataFrame
    checkpoints: tuple[JointModel, ...]


class JointTraining:
    """One training run; ``rows`` hold hashed words and labels, by split and mini-batch."""

    def __init__(self, labeled: DataFrame, aspects: Sequence[str], config: JointConfig, key: str, text_col: str):
        self.config, self.aspects, self.text_col = config, tuple(aspects), text_col
        spark = self.spark = labeled.sparkSession
        path = scratch_path(spark, "joint-rows")
        batch = F.floor(hash_unit(F.col(key), f"batch {config.seed}") * config.batches).cast("int")
        split = train_val_test_split(label_arrays(labeled, aspects), key, seed=config.seed)
        split.select(
            key, "split", batch.alias("batch"), text_col, hashed_words(text_col, config.num_features).alias("hashed"),
            "aspects", "sentiment_rule", "aspect_true", "sentiment_true",
        ).write.partitionBy("split", "batch").parquet(path)
        self.rows = spark.read.parquet(path)
        train = self.rows.where("split = 'train'")
        held = train.select(F.explode(F.array_distinct("hashed")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
        idf = np.zeros(config.num_features)
        texts = train.count()
        idf[:] = np.log(texts + 1.0)
        for r in held.collect():  # a row for each feature at most
            idf[r.f] = np.log((texts + 1.0) / (r.n + 1.0))
        self.features = Features(idf)
        of_class: Mapping[int, float] = {r.sentiment_id: r.weight for r in class_weights(train, aspects).collect()}
        self.of_class = np.array([of_class.get(c, 0.0) for c in range(MOODS)])

    def gradient(self, weights: np.ndarray, batch: int | None = None) -> tuple[np.ndarray, float]:
        """Gradient and loss of one mini-batch (None: of all training rows)."""
        rows = self.rows.where("split = 'train'")
        rows = rows if batch is None else rows.where(F.col("batch") == batch)
        columns = [f"g{k}" for k in range(weights.shape[1])]
        shared = self.spark.sparkContext.broadcast(weights)
        parts = rows.select("hashed", "aspect_true", "sentiment_true").mapInArrow(
            _gradients(self.features, shared, self.of_class, len(self.aspects)),
            ", ".join(["feature long", *[f"{c} double" for c in columns]]),
        )
        total, sums = np.zeros_like(weights), np.zeros(4)
        for r in parts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in columns]).collect():
            if r.feature < 0:
                sums[:] = r[1:5]
            else:
                total[r.feature] = r[1:]
        shared.unpersist()
        c, n = self.config, len(self.aspects)
        scale = np.array([c.aspect_weight / max(sums[1], 1.0), c.sentiment_weight / sums[3] if sums[3] else 0.0])
        total[:, :n] *= scale[0]
        total[:, n:] *= scale[1]
        return total, float(scale[0] * sums[0] + scale[1] * sums[2])

    def model(self, weights: np.ndarray) -> JointModel:
        return JointModel(self.features, weights.copy(), self.aspects, self.text_col, self.config.threshold)

    def scores(self, model: JointModel, split: str) -> tuple[float, float, float]:
        scored = model.transform(self.rows.where(F.col("split") == split).drop("hashed"))
        pairs = ("aspect_true", "sentiment_true"), ("aspect_pred", "sentiment_pred")
        return tuple(v or 0.0 for v in combined_f1(long_labels(scored, self.aspects, *pairs)).first())

    def run(self) -> JointTrained:
        c = self.config
        outputs_ = len(self.aspects) * (1 + MOODS)
        weights = np.zeros((c.num_features + 1, outputs_))
        mean, square = np.zeros_like(weights), np.zeros_like(weights)
        steps, step = c.epochs * c.batches, 0
        entries, models = [], []
        for epoch in range(1, c.epochs + 1):
            losses = []
            for batch in range(c.batches):
                gradient, loss = self.gradient(weights, batch)
                losses.append(loss)
                step += 1
                gradient *= min(1.0, c.clip / max(float(np.sqrt((gradient**2).sum())), 1e-12))
                rate = c.rate * min(step / max(1.0, c.warmup * steps), (steps - step + 1) / max(1.0, (1 - c.warmup) * steps), 1.0)
                mean = 0.9 * mean + 0.1 * gradient
                square = 0.999 * square + 0.001 * gradient**2
                move = (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
                weights = weights - rate * (move + c.decay * weights)
            model = self.model(weights)
            models.append(model)
            aspect, mood, both = self.scores(model, "val")
            entries.append((epoch, float(np.mean(losses)), float(aspect), float(mood), float(both)))
        shape = "epoch int, train_loss double, val_aspect_f1_macro double, val_sentiment_f1_avg double, combined_f1 double"
        log = self.spark.createDataFrame(entries, shape)
        path = scratch_path(self.spark, "training-log")
        line = F.struct("epoch", "train_loss", "val_aspect_f1_macro", "val_sentiment_f1_avg")
        files.write_json(log.agg(F.sort_array(F.collect_list(line)).alias("training_log")), path)
        best = best_checkpoint(log)
        row = best.first()
        if row is None:
            raise RuntimeError("no epoch reached a positive validation score")
        return JointTrained(models[row.epoch - 1], log, best, path, self.rows, tuple(models))


def train_jointly(
    labeled: DataFrame,
    aspects: Sequence[str],
    config: JointConfig = JointConfig(),
    key: str = "review_id",
    text_col: str = "clean_text",
) -> JointTrained:
    """Train both heads on the training split, log every epoch, keep the best by validation.

    ``log_path`` is the metrics document the run wrote; ``scan_training_log`` reads it. Runs jobs.
    """
    return JointTraining(labeled, aspects, config, key, text_col).run()

"""Languages by character runs: a model fitted from labelled texts, unknown below a margin.

Fitting counts every run of ``n`` characters of every labelled text: tasks count the runs they meet,
Spark sums them by language and run. A language keeps its ``max_runs`` most frequent ones, so the
model is a table of at most ``max_runs`` rows a language, whatever the corpus, and goes to every task.
Scoring reads whole texts in one narrow pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentika.session import scratch_path

UNKNOWN = "unknown"
_BITS = 21  # of a code point
_HELD = 1 << 18  # runs a task holds before it counts them


@dataclass(frozen=True)
class LanguageConfig:
    n: int = 3  # characters of a run, 3 at most
    max_runs: int = 2_000  # kept for each language
    margin: float = 0.02  # least mean advantage over the second language, in nats a run


def letters_only(text: Column) -> Column:
    """Lower-cased letters with one blank around and between words; empty without any letter."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))
    return F.when(plain == "", "").otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def _codes(text: str, n: int) -> np.ndarray:
    """Every run of ``n`` characters as one number."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(points) < n:
        return np.empty(0, np.int64)
    codes = points[: len(points) - n + 1].copy()
    for k in range(1, n):
        codes = (codes << _BITS) | points[k : len(points) - n + 1 + k]
    return codes


def _run_of(code: int, n: int) -> str:
    return "".join(chr((code >> (_BITS * (n - 1 - k))) & ((1 << _BITS) - 1)) for k in range(n))


def _counting(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1)
            for lang in sorted(set(langs)):
                codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
                found, held = [], 0
                places = np.flatnonzero(langs == lang)
                for i in places:
                    found.append(_codes(texts[int(i)].as_py(), n))
                    held += len(found[-1])
                    if held < _HELD and i != places[-1]:
                        continue
                    # runs are counted some at a time: a task holds the different ones only
                    own, times = np.unique(np.concatenate(found), return_counts=True)
                    codes, at = np.unique(np.concatenate([codes, own]), return_inverse=True)
                    counts = np.bincount(at, weights=np.concatenate([counts, times]), minlength=len(codes)).astype(np.int64)
                    found, held = [], 0
                yield pa.record_batch(
                    {
                        "lang": pa.array([lang] * len(codes), pa.string()),
                        "run": pa.array([_run_of(int(c), n) for c in codes], pa.string()),
                        "n": pa.array(counts, pa.int64()),
                    }
                )

    return run


def run_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "clean_text", n: int = 3) -> DataFrame:
    """``lang, run, n`` over all texts that have a language; null and letterless texts have no runs."""
    texts = df.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), letters_only(F.col(text_col)).alias("text")
    )
    parts = texts.where(F.col("text") != "").mapInArrow(_counting(n), "lang string, run string, n long")
    return parts.groupBy("lang", "run").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    """Log shares of the kept runs in each language, the last row that of every other run."""

    config: LanguageConfig
    langs: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray

    def detect(self, df: DataFrame, text_col: str = "clean_text", out_col: str = "lang") -> DataFrame:
        """Add ``out_col`` and ``<out_col>_margin``, the mean advantage of the best language over the second.

        A text without letters or shorter than a run is ``unknown`` with a null margin; so is, with its
        margin, one whose advantage is below the model's. With one fitted language the margin is null
        and every text with runs has that language. Equal sums: first language by code. Columns of
        these names are replaced.
        """
        shared = df.sparkSession.sparkContext.broadcast((self.codes, self.weights))  # max_runs a language
        kept = df.drop(out_col, f"{out_col}_margin", "__text")
        rows = kept.withColumn("__text", letters_only(F.col(text_col)))
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
        return rows.mapInArrow(
            _scoring(shared, self.langs, self.config, out_col), f"{shape}, `{out_col}` string, `{out_col}_margin` double"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """A table of one row for each kept run and one for all others."""
        rows = [(int(c), w.tolist()) for c, w in zip([*self.codes, -1], self.weights)]
        spark.createDataFrame(rows, "code long, weights array<double>").withColumn(
            "langs", F.array(*[F.lit(x) for x in self.langs])
        ).coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: LanguageConfig = LanguageConfig()) -> "LanguageModel":
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.code < 0, r.code))
        return cls(config, tuple(rows[0].langs), np.array([r.code for r in rows[:-1]], np.int64), np.array([r.weights for r in rows]))


def _scoring(shared, langs: tuple[str, ...], config: LanguageConfig, out_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, weights = shared.value
        names = np.array(langs, object)
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            guesses, margins = [], []
            for text in batch.column(at):
                own = _codes(text.as_py(), config.n)
                if not len(own):
                    guesses.append(UNKNOWN)
                    margins.append(None)
                    continue
                place = np.searchsorted(codes, own)
                known = place < len(codes)
                known[known] = codes[place[known]] == own[known]
                seen = np.bincount(np.where(known, place, len(codes)), minlength=len(codes) + 1)
                used = np.flatnonzero(seen)
                sums = seen[used] @ weights[used]
                best = int(sums.argmax())
                rest = np.delete(sums, best)
                margin = float(sums[best] - rest.max()) / len(own) if len(rest) else None
                guesses.append(names[best] if margin is None or margin >= config.margin else UNKNOWN)
                margins.append(margin)
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.record_batch(
                [*[batch.column(i) for i in kept], pa.array(guesses, pa.string()), pa.array(margins, pa.float64())],
                [*[batch.schema.names[i] for i in kept], out_col, f"{out_col}_margin"],
            )

    return run


def fit_languages(
    df: DataFrame, lang_col: str = "lang", text_col: str = "clean_text", config: LanguageConfig = LanguageConfig()
) -> LanguageModel:
    """Fit on every labelled text. A run's share is ``(count + 1) / (runs of the language + kept runs + 1)``.

    Ties at the cut of the kept runs go to the smaller run. Runs a job; the driver gets at most
    ``max_runs`` rows for each kept run's languages.
    """
    if not 1 <= config.n <= 3:
        raise ValueError("runs have one to three characters")
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "language-runs")
    run_counts(df, lang_col, text_col, config.n).write.parquet(path)  # texts are read once
    counts = spark.read.parquet(path)
    frequent = Window.partitionBy("lang").orderBy(F.desc("n"), "run")
    ranked = counts.withColumn("rank", F.row_number().over(frequent)).where(F.col("rank") <= config.max_runs)
    kept = ranked.select("run").distinct()
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        raise ValueError("no text with a language and letters")
    langs = tuple(sorted(totals))
    rows = counts.join(kept, "run").collect()  # languages x languages x max_runs at most
    by_code = {}
    for r in rows:
        code = 0
        for ch in r.run:
            code = (code << _BITS) | ord(ch)
        by_code.setdefault(code, np.zeros(len(langs)))[langs.index(r.lang)] = r.n
    codes = np.array(sorted(by_code), np.int64)
    counted = np.vstack([*[by_code[int(c)] for c in codes], np.zeros(len(langs))])
    sizes = np.array([totals[x] for x in langs], float) + len(codes) + 1
    return LanguageModel(config, langs, codes, np.log((counted + 1.0) / sizes))


def detection_quality(guessed: DataFrame, truth: str = "lang", guess: str = "guess") -> DataFrame:
    """``lang, n, n_right, n_unknown`` of the texts whose language is known."""
    return (
        guessed.where(F.col(truth).isNotNull())
        .groupBy(F.col(truth).alias("lang"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(guess) == F.col(truth)).alias("n_right"),
            F.count_if(F.col(guess) == UNKNOWN).alias("n_unknown"),
        )
    )

"""Toxic spans by a linear-chain conditional random field.

Documents are labelled as a whole, so the training tokens are labelled from them: a word or word
beginning that labelled toxic documents hold far more often than clean ones marks its tokens as
toxic where they stand in a toxic document. The field has two states, clean and toxic, with
weights for a token's own cues, for the cues of its neighbours and for each change of state.
Forward-backward marginals give each token's probability; a logistic model of a text's marginals
gives the document's score.

Almost all tokens carry no cue. A run of them multiplies the same matrix again and again, which
has a closed form, so marginals are computed at the tokens with cues alone, exactly.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentika.llm.common import ALNUM_LOWER, blocks_of, text_bytes, written

#: Documented bound of the sample that is fitted on: labelled rows outside the held-out third.
MAX_TRAIN_ROWS = 20_000
#: Bound of the cues kept, the strongest first.
MAX_CUES = 20_000
#: Word beginnings of these lengths stand for words that training has not seen.
PREFIXES = (4, 5, 6)
#: A cue is held by this many training documents at least, and this much more often by toxic ones.
MIN_DOCS, MIN_LOG_ODDS = 4, 2.5
#: Likelihood-ratio statistic above which a difference between the classes is no chance.
MIN_G2 = 15.0
STRENGTHS = 4
SCORED = "id long, score double, starts array<int>, ends array<int>, marginals array<double>"


def held_out(id_col: str = "doc_id"):
    """The third of the ids that is never learned from; a null id is of it."""
    key = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    return F.coalesce(key == 1, F.lit(True))


def features_of(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, marked as such."""
    return [word, *[word[:n] + b"*" for n in PREFIXES if len(word) > n]]


def words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_LOWER).split()


def _distinct_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold each feature, counted per task batch."""
    for batch in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for label, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            counts[label].update({f for w in set(words(text)) for f in features_of(w)})
        for label, found in counts.items():
            yield pa.record_batch(
                {
                    "feature": pa.array(list(found), pa.binary()),
                    "toxic": pa.array([n * label for n in found.values()], pa.int64()),
                    "docs": pa.array(list(found.values()), pa.int64()),
                }
            )


def cue_table(train: DataFrame, n_toxic: int, n_clean: int) -> dict[bytes, float]:
    """Features that toxic training documents hold far more often, with their log odds.

    Counted by Spark over the whole training sample. The likelihood ratio must beat the chance of
    the best of that many features; at most ``MAX_CUES`` come to the driver, the surest first.
    """
    counts = written(
        train.select("label", "text")
        .mapInArrow(_distinct_features, "feature binary, toxic long, docs long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("a"), F.sum("docs").alias("n"))
        .where(F.col("a") >= MIN_DOCS)
        .withColumn("b", F.col("n") - F.col("a")),
        "toxicity-features",
    )
    total = n_toxic + n_clean
    expected = F.col("n") * F.lit(n_toxic / max(total, 1))
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("b") + 0.5) / (n_clean + 1.0))
    scored = counts.withColumns(
        {"log_odds": odds, "g2": 2 * (term(F.col("a"), expected) + term(F.col("b"), F.col("n") - expected))}
    )
    least = max(MIN_G2, 2.5 * math.log(max(counts.count(), 1)))
    kept = scored.where((F.col("log_odds") >= MIN_LOG_ODDS) & (F.col("g2") >= least))
    best = kept.orderBy(F.desc("g2"), "feature").limit(MAX_CUES).select("feature", "log_odds")
    return {bytes(r.feature): r.log_odds for r in best.collect()}


class _Strengths(dict):
    """Strength of each word seen, worked out once."""

    def __init__(self, tagger: Tagger):
        super().__init__()
        self.tagger = tagger

    def __missing__(self, word: bytes) -> int:
        self[word] = found = self.tagger.strength(word)
        return found

    def of(self, tokens: list[bytes]) -> np.ndarray:
        if len(self) > 500_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, tokens), np.int8, len(tokens))


@dataclass
class Tagger:
    """Cues with their log odds, the field's weights, and the document model."""

    cues: dict[bytes, float]
    #: Weights of the toxic state: any token, a cue of each strength, a cue beside the token.
    bias: float = -6.0
    own: tuple[float, ...] = (2.0, 4.0, 5.0, 6.0)
    near: float = 0.0
    #: Weights of two toxic tokens in a row, and of a change between the states.
    stay: float = 0.0
    change: float = 0.0
    document: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)

    def strength(self, word: bytes) -> int:
        """0 without a cue, else 1 to ``STRENGTHS`` by the best cue of the word."""
        best = max((self.cues[f] for f in features_of(word) if f in self.cues), default=None)
        return 0 if best is None else min(STRENGTHS, 1 + int((best - MIN_LOG_ODDS) / 1.5))

    def weights(self, strengths: np.ndarray, near: np.ndarray) -> np.ndarray:
        return self.bias + np.array([0.0, *self.own])[strengths] + self.near * near

    def chain(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """Change of state; one token without cues: its eigenvectors, their inverse, values over the top one, log of that."""
        step = np.exp(np.array([[0.0, self.change], [self.change, self.stay]]))
        values, left = np.linalg.eig(step * np.array([1.0, math.exp(self.bias)]))
        top = float(values.real.max())
        return step, left.real, np.linalg.inv(left).real, values.real / top, math.log(top)


def listed(strengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that carry a cue or stand beside one, their strengths, and whether a cue is beside them."""
    has = strengths > 0
    if not has.any():
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    near = np.zeros(len(has), bool)
    near[1:] |= has[:-1]
    near[:-1] |= has[1:]
    at = np.flatnonzero(has | near)
    return at, strengths[at].astype(np.int64), near[at]


def marginals(tagger: Tagger, n: int, at: np.ndarray, logit: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at the listed positions of a chain of ``n`` tokens.

    Messages cross the tokens between them by powers of one matrix. The state before the first
    token is clean, the last token may have either.
    """
    step, left, inverse, ratio, _ = tagger.chain()
    gaps = np.diff(at, prepend=-1) - 1
    odds = np.exp(logit)
    forward, ahead = np.array([1.0, 0.0]), np.empty((len(at), 2))
    for i in range(len(at)):
        if gaps[i]:
            forward = ((forward @ left) * ratio ** gaps[i]) @ inverse
        forward = forward @ step
        forward[1] *= odds[i]
        forward /= forward.sum()
        ahead[i] = forward
    back, out = left @ (ratio ** (n - 1 - at[-1]) * inverse.sum(axis=1)), np.empty(len(at))
    for i in range(len(at) - 1, -1, -1):
        joint = ahead[i] * back
        out[i] = joint[1] / joint.sum()
        back = step @ np.array([back[0], back[1] * odds[i]])
        if gaps[i]:
            back = left @ (ratio ** gaps[i] * (inverse @ back))
        back /= back.sum()
    return out


def document_features(n: int, probability: np.ndarray) -> list[float]:
    """What the document model sees: the surest token, how many are toxic, and their share of the text."""
    if not len(probability):
        return [1.0, 0.0, 0.0, 0.0]
    total = float(probability.sum())
    return [1.0, float(probability.max()), math.log1p(total), math.log1p(1000.0 * total / max(n, 1)) / 5.0]


@dataclass
class _Chains:
    """Labelled texts as arrays, padded to the longest list of positions."""

    n: np.ndarray
    at: np.ndarray
    strength: np.ndarray
    near: np.ndarray
    valid: np.ndarray

    def log_partition(self, tagger: Tagger) -> float:
        """Sum of the log normalisers of all chains."""
        step, left, inverse, ratio, log_top = tagger.chain()
        odds = np.exp(tagger.weights(self.strength, self.near))
        forward = np.tile([1.0, 0.0], (len(self.n), 1))
        logs, last = np.zeros(len(self.n)), np.full(len(self.n), -1)
        for i in range(self.at.shape[1]):
            on = self.valid[:, i]
            gap = np.where(on, self.at[:, i] - last - 1, 0)
            moved = (((forward @ left) * ratio ** gap[:, None]) @ inverse) @ step
            moved[:, 1] *= odds[:, i]
            total = moved.sum(axis=1)
            forward = np.where(on[:, None], moved / total[:, None], forward)
            logs += np.where(on, np.log(total) + gap * log_top, 0.0)
            last = np.where(on, self.at[:, i], last)
        gap = self.n - 1 - last
        end = (((forward @ left) * ratio ** gap[:, None]) @ inverse).sum(axis=1)
        return float((logs + np.log(end) + gap * log_top).sum())


def _packed(texts: list[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> _Chains:
    width = max([1, *(len(at) for _, (at, _, _) in texts)])
    shape = len(texts), width
    out = _Chains(np.array([n for n, _ in texts]), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape, bool))
    for r, (_, (at, strength, near)) in enumerate(texts):
        k = len(at)
        out.at[r, :k], out.strength[r, :k], out.near[r, :k], out.valid[r, :k] = at, strength, near, True
    return out


def _tagger_of(cues: dict[bytes, float], theta: np.ndarray) -> Tagger:
    own = tuple(map(float, theta[1 : 1 + STRENGTHS]))
    near, stay, change = map(float, theta[1 + STRENGTHS :])
    return Tagger(cues, float(theta[0]), own, near, stay, change)


def fit_field(cues: dict[bytes, float], texts: list[tuple[int, tuple, int]], rounds: int = 30) -> Tagger:
    """Weights that make the labelled tokens likeliest, by gradient ascent with a small penalty.

    ``texts`` holds each chain's length, listed positions and label. Tokens are labelled toxic
    where a toxic text has a cue, all others clean. Expected counts are the derivatives of the
    exact log partition, taken by central differences in the few weights.
    """
    counts = np.zeros(4 + STRENGTHS)
    for n, (at, strength, near), label in texts:
        gold = at[strength > 0] if label else at[:0]
        if not len(gold):
            continue
        runs = 1 + int((np.diff(gold) > 1).sum())
        counts[0] += len(gold)
        counts[1 : 1 + STRENGTHS] += np.bincount(strength[strength > 0], minlength=STRENGTHS + 1)[1:]
        counts[1 + STRENGTHS] += near[strength > 0].sum()
        counts[2 + STRENGTHS] += len(gold) - runs
        counts[3 + STRENGTHS] += 2 * runs - (gold[-1] == n - 1)
    chains = _packed([(n, where) for n, where, _ in texts])
    theta = np.array([-4.0, 2.0, 3.0, 4.0, 5.0, 0.0, 0.0, 0.0])
    mean, square, h = np.zeros_like(theta), np.zeros_like(theta), 1e-3
    for t in range(1, rounds + 1):
        expected = np.empty_like(theta)
        for k in range(len(theta)):
            up, down = theta.copy(), theta.copy()
            up[k] += h
            down[k] -= h
            expected[k] = (chains.log_partition(_tagger_of(cues, up)) - chains.log_partition(_tagger_of(cues, down))) / (2 * h)
        gradient = (counts - expected) / max(len(texts), 1) - 2e-4 * theta
        mean, square = 0.8 * mean + 0.2 * gradient, 0.95 * square + 0.05 * gradient**2
        theta = theta + 0.3 * (mean / (1 - 0.8**t)) / (np.sqrt(square / (1 - 0.95**t)) + 1e-8)
    return _tagger_of(cues, theta)


def fit_document(x: np.ndarray, y: np.ndarray, rounds: int = 25, penalty: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
    return tuple(map(float, w))


#: Chains of the training sample that the field's few weights are fitted on: so many at most, of
#: those with so many listed positions at most. Cues and document model use the whole sample.
MAX_CHAINS, MAX_LISTED = 3000, 64


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> Tagger:
    """A tagger from the labelled rows outside the held-out third.

    The ``max_rows`` rows with the smallest hashes of their ids are fitted on: a documented
    bound, so that they can be broadcast and the model fitted in the driver. Rows without a
    label, an id or a text do not count; ids with several labels take the largest. Without
    toxic or without clean rows every text gets the share of toxic ones as its score.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    sample = written(texts.join(F.broadcast(known), "id").select("label", "text"), "toxicity-sample")
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Tagger({}, document=(math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    cues = cue_table(sample, n_toxic, n_clean)
    rows = sample.mapInArrow(_lister(Tagger(cues)), "label int, n int, at array<int>, strength array<int>, near array<boolean>").collect()
    texts_ = [
        (r.n, (np.array(r["at"], np.int64), np.array(r.strength, np.int64), np.array(r.near, bool)), r.label) for r in rows
    ]
    texts_.sort(key=lambda t: (zlib.crc32(repr((t[0], t[1][0].tolist())).encode()), t[0], t[2]))
    tagger = fit_field(cues, [t for t in texts_ if t[0] and len(t[1][0]) <= MAX_LISTED][:MAX_CHAINS])
    x = np.array([_seen(tagger, n, *where) for n, where, _ in texts_])
    tagger.document = fit_document(x, np.array([label for _, _, label in texts_], float))
    return tagger


def _seen(tagger: Tagger, n: int, at: np.ndarray, strength: np.ndarray, near: np.ndarray) -> list[float]:
    return document_features(n, marginals(tagger, n, at, tagger.weights(strength, near)) if len(at) else at)


def _lister(tagger: Tagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strengths = _Strengths(tagger)
        for batch, texts in blocks_of(batches, "text", 8 << 20):
            tokens = [words(t) for t in texts]
            found = [listed(strengths.of(t)) for t in tokens]
            yield pa.record_batch(
                {
                    "label": batch.column(0),
                    "n": pa.array([len(t) for t in tokens], pa.int32()),
                    "at": pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    "strength": pa.array([f[1] for f in found], pa.list_(pa.int32())),
                    "near": pa.array([f[2] for f in found], pa.list_(pa.bool_())),
                }
            )

    return run


def _offsets(text: bytes, tokens: list[bytes], wanted: list[int]) -> list[tuple[int, int]]:
    """Code-point offsets of some tokens, in ascending order."""
    flat, pos, done, chars, out, want = text.translate(ALNUM_LOWER), 0, 0, 0, [], set(wanted)
    for i, w in enumerate(tokens[: wanted[-1] + 1] if wanted else []):
        pos = flat.index(w, pos)
        if i in want:
            chars += len(text[done:pos].decode("utf-8", "replace"))
            size = len(text[pos : pos + len(w)].decode("utf-8", "replace"))
            out.append((chars, chars + size))
            chars, done = chars + size, pos + len(w)
        pos += len(w)
    return out


def _scorer(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger: Tagger = shared.value
        strengths, weights = _Strengths(tagger), np.array(tagger.document)
        for batch, texts in blocks_of(batches, "text", 8 << 20):
            scores, starts, ends, sure = [], [], [], []
            for text in texts:
                tokens = words(text)
                at, strength, near = listed(strengths.of(tokens))
                p = marginals(tagger, len(tokens), at, tagger.weights(strength, near)) if len(at) else at.astype(float)
                z = float(np.dot(weights, document_features(len(tokens), p)))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                hit = p >= threshold
                spans = _offsets(text, tokens, at[hit].tolist())
                starts.append([s for s, _ in spans])
                ends.append([e for _, e in spans])
                sure.append(p[hit].tolist())
            yield pa.record_batch(
                {
                    "id": batch.column(0),
                    "score": pa.array(scores, pa.float64()),
                    "starts": pa.array(starts, pa.list_(pa.int32())),
                    "ends": pa.array(ends, pa.list_(pa.int32())),
                    "marginals": pa.array(sure, pa.list_(pa.float64())),
                }
            )

    return run


def score(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each document: the id, ``score`` and ``spans`` of toxic tokens.

    Spans are structs of ``start`` and ``end`` (code points, exclusive) and the token's
    ``probability``, from ``threshold`` on. Null and empty texts have no tokens and the model's
    score for that. Repeated rows and null ids stay rows of their own; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_scorer(shared, threshold), SCORED)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"), F.col("marginals").alias("probability"))
    return found.select(F.col("id").alias(id_col), "score", spans.alias("spans"))


def without_toxic(docs: DataFrame, tagger: Tagger, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """Documents with a score below ``least``, all columns; null texts stay as any text without tokens does."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Tagger = shared.value
        strengths, weights = _Strengths(held), np.array(held.document)
        for batch in batches:
            keep = []
            for text in text_bytes(batch.column(batch.schema.get_field_index(text_col))):
                tokens = words(text)
                z = float(np.dot(weights, _seen(held, len(tokens), *listed(strengths.of(tokens)))))
                keep.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) < least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

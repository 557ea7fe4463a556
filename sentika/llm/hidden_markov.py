"""A hidden Markov language model: latent states trained by Baum-Welch, exact forward scores.

A text is its words, lower-cased, and one end. The model walks through ``STATES`` latent states; a
state emits a class of words, and the class emits the word by its count:

* each of the ``FREQUENT`` most frequent words is a class of its own, and so is the end,
* all others, unknown ones included, fall into ``TAILS`` classes by their last three bytes, where a
  word of count ``c`` has the share ``(c + 1) / (tokens + words + 1)`` of its class.

So the states' tables have a fixed size, while the words within classes are counted over the whole
corpus and stay in Spark. Blocks of documents refer to their different words by number; counts are
summed by word, joined back to the blocks, and never pass the driver but for the frequent words.

Each round of Baum-Welch reads all training texts: tasks add up expected starts, moves and
emissions of their blocks, Spark sums them by class, and the driver normalises tables of
``STATES x (FREQUENT + TAILS + 1)`` numbers. Texts run through the recursion side by side in lanes,
one after the other within a lane, scaled at every token, so that no length underflows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentika.llm.common import ASCII_LOWER, blocks_of, written

STATES = 12
FREQUENT, TAILS = 8192, 4096
#: Rounds of Baum-Welch over all training texts.
ROUNDS = 4
#: Training rows are those whose remainder is another one.
FOLDS, HELD_OUT = 7, 2
#: Bytes of text in a block, and tokens that run through the recursion together (a longer text alone).
BLOCK_BYTES, RUN_TOKENS = 15 << 20, 1 << 17
#: Bytes of text that are cut into words at a time (a longer text alone): a word is an object of 40 bytes.
PIECE_BYTES = 1 << 20
#: Texts that run side by side.
LANES = 512
#: Weight, in tokens, of the corpus' own shares in each state's emissions, and of even moves.
PRIOR = 20.0
#: No word can be empty, so the end takes the empty string's place among the words.
END = b""
BLOCKS = "ids array<long>, held array<boolean>, lengths array<int>, tokens binary, words array<binary>, counts array<long>"
#: Rows of a block when it is scored: its words, then their counts, then its texts by ascending part.
KNOWN = "block long, part int, places binary, found binary"
PIECES = "words array<binary>, ids array<long>, held array<boolean>, lengths array<int>, tokens binary"
WORDS, COUNTS = -2, -1
#: Words whose counts a task puts together.
KNOWN_ROWS = 1 << 19


@dataclass(frozen=True)
class Tables:
    """The fixed-size part of the model."""

    frequent: dict[bytes, int]
    start: np.ndarray
    moves: np.ndarray
    emissions: np.ndarray  # states x classes

    @property
    def classes(self) -> int:
        return FREQUENT + TAILS + 1

    @cached_property
    def by_class(self) -> np.ndarray:
        """Emissions of all states side by side, one row a class."""
        return np.ascontiguousarray(self.emissions.T)

    @cached_property
    def best(self) -> np.ndarray:
        """Emission of each class by its best state."""
        return self.by_class.max(axis=1)


def class_of(words: pa.Array | list[bytes], frequent: dict[bytes, int]) -> np.ndarray:
    """Class number of each word: its own if it is frequent, else by its last three bytes."""
    words = pa.array(words, pa.binary()) if isinstance(words, list) else words.cast(pa.binary())
    own = pc.index_in(words, value_set=pa.array(list(frequent), pa.binary())).fill_null(-1).to_numpy()
    numbers = np.array([*frequent.values(), 0], np.int32)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes, ends = np.diff(offsets), offsets[1:]
    # the last bytes as a number, with how many there are: few differ
    tail = np.minimum(sizes, 3).astype(np.int64) << 24
    for k in range(3):
        longer = np.flatnonzero(sizes > k)
        tail[longer] |= data[ends[longer] - 1 - k].astype(np.int64) << (8 * k)
    different, place = np.unique(tail, return_inverse=True)
    last = [(t & 0xFFFFFF).to_bytes(3, "big")[3 - (t >> 24) :] for t in different.tolist()]
    rare = np.array([FREQUENT + zlib.crc32(t) % TAILS if t else FREQUENT + TAILS for t in last], np.int32)
    return np.where(own >= 0, numbers[own], rare[place]) if len(words) else np.zeros(0, np.int32)


class Lanes:
    """Tokens of several texts, laid out step by step: at each step one token of every lane still running."""

    def __init__(self, lengths: np.ndarray, lanes: int = LANES):
        """Texts go, longest first, to the lane with the fewest tokens."""
        count = max(1, min(lanes, len(lengths)))
        heap = [(0, k) for k in range(count)]
        put: list[list[int]] = [[] for _ in range(count)]
        for i in np.argsort(-lengths, kind="stable").tolist():
            held, k = heapq.heappop(heap)
            put[k].append(i)
            heapq.heappush(heap, (held + int(lengths[i]), k))
        sums = np.array([lengths[p].sum() for p in put])
        put = [put[k] for k in np.argsort(-sums, kind="stable")]
        sums = -np.sort(-sums)
        begins = np.cumsum(lengths) - lengths
        self.active = np.searchsorted(-sums, -np.arange(sums[0]), side="left")  # lanes longer than t
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        total = int(self.offset[-1])
        #: number of the token, in the order of the texts, that stands at each place
        self.token = np.empty(total, np.int64)
        self.first = np.zeros(total, bool)
        self.last = np.zeros(total, bool)
        # all lanes behind each other: the text of each token, and its step within its lane
        texts = np.array([i for p in put for i in p], np.int64)
        sizes = lengths[texts]
        ends = np.cumsum(sizes)
        numbers = np.arange(total)
        at = self.offset[numbers - np.repeat(np.cumsum(sums) - sums, sums)] + np.repeat(np.arange(count), sums)
        self.token[at] = numbers + np.repeat(begins[texts] - ends + sizes, sizes)
        self.first[at[ends - sizes]] = True
        self.last[at[ends - 1]] = True
        #: whether a text begins at a step
        self.begins = np.add.reduceat(self.first, self.offset[:-1]) > 0


def forward(lanes: Lanes, emitted: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables and the scale of each place; ``emitted`` is overwritten by the former."""
    scale = np.empty(len(emitted), emitted.dtype)
    before = emitted[:0]
    ones = np.ones(len(start), emitted.dtype)
    for lo, n, begins in zip(lanes.offset.tolist(), lanes.active.tolist(), lanes.begins.tolist(), strict=False):
        now = emitted[lo : lo + n]
        ahead = before[:n] @ moves if lo else np.empty_like(now)
        if begins:
            ahead[lanes.first[lo : lo + n]] = start
        now *= ahead
        total = np.matmul(now, ones, out=scale[lo : lo + n])
        now /= total[:, None]
        before = now
    return emitted, scale


def expectations(
    lanes: Lanes, classes: np.ndarray, tables: Tables, kind: type = np.float64
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions (states x classes) of texts, and their log-likelihood.

    ``kind`` is that of the numbers between tokens. Emissions are taken relative to the class' best
    state, which changes no expectation, so that single precision does not run out of range.
    """
    placed = np.take(classes, lanes.token).astype(np.int64)
    best = tables.best
    emitted = np.take((tables.by_class / best[:, None]).astype(kind), placed, axis=0)
    alpha, scale = forward(lanes, emitted.copy(), tables.start.astype(kind), tables.moves.astype(kind))
    emitted /= scale[:, None]
    states = len(tables.start)
    gamma = np.ones_like(alpha)  # backward variables at first
    moves = np.zeros((states, states))
    offset, active, begins = lanes.offset.tolist(), lanes.active.tolist(), lanes.begins.tolist()
    back = tables.moves.T.astype(kind)
    for t in range(len(active) - 1, 0, -1):
        n, lo, up = active[t], offset[t], offset[t - 1]
        behind = emitted[lo : lo + n]
        behind *= gamma[lo : lo + n]
        if begins[t]:
            behind[lanes.first[lo : lo + n]] = 0.0
        value = np.matmul(behind, back, out=gamma[up : up + n])
        if begins[t]:
            value[lanes.first[lo : lo + n]] = 1.0
        moves += alpha[up : up + n].T @ behind
    gamma *= alpha
    by_state = np.ascontiguousarray(gamma.T)
    counts = np.stack([np.bincount(placed, weights=own, minlength=tables.classes) for own in by_state])
    likelihood = float(np.log10(scale, dtype=np.float64).sum() + np.take(np.log10(best), placed).sum())
    return gamma[lanes.first].sum(axis=0, dtype=np.float64), moves * tables.moves, counts, likelihood


def normalised(start: np.ndarray, moves: np.ndarray, counts: np.ndarray, shares: np.ndarray, frequent: dict[bytes, int]) -> Tables:
    """Tables from expected counts; ``shares`` are those of the classes in the corpus."""
    states = len(start)
    start = (start + 1.0 / states) / (start.sum() + 1.0)
    moves = (moves + PRIOR / states) / (moves.sum(axis=1, keepdims=True) + PRIOR)
    emissions = (counts + PRIOR * shares) / (counts.sum(axis=1, keepdims=True) + PRIOR)
    return Tables(frequent, start, moves, emissions)


def first_tables(shares: np.ndarray, frequent: dict[bytes, int], states: int = STATES) -> Tables:
    """Lasting states whose emissions are the corpus' own, shaken by fixed noise."""
    noise = np.random.default_rng(11).normal(0.0, 1.0, (states, len(shares)))
    emissions = shares * np.exp(noise)
    emissions /= emissions.sum(axis=1, keepdims=True)
    moves = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    return Tables(frequent, np.full(states, 1.0 / states), moves, emissions)


def _remainder(doc_id: int | None, folds: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def _coded(texts: list[bytes]) -> tuple[list[int], pa.DictionaryArray]:
    """Tokens in each text, and the words of all as numbers."""
    parts = [[*t.translate(ASCII_LOWER).split(), END] for t in texts]
    return [len(p) for p in parts], pa.array([w for p in parts for w in p], pa.binary()).dictionary_encode()


def _block(ids: list, lengths: list[int], coded: list[pa.DictionaryArray], folds: int, held_out: int) -> pa.RecordBatch:
    """One block: its texts as numbers of its different words, which are counted over its training texts."""
    alike = pa.chunked_array(coded).unify_dictionaries()
    words = alike.chunk(0).dictionary
    flat = np.concatenate([c.indices.to_numpy() for c in alike.chunks])
    del alike
    # by length: texts that run side by side then end together
    ends = np.cumsum(lengths)
    order = np.argsort(-np.array(lengths), kind="stable").tolist()
    tokens = np.concatenate([flat[ends[i] - lengths[i] : ends[i]] for i in order])
    del flat
    ids, sizes = [ids[i] for i in order], np.array([lengths[i] for i in order], np.int32)
    held = np.array([_remainder(i, folds) == held_out for i in ids])
    counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words))
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.record_batch(
        {
            "ids": one(ids, pa.int64()),
            "held": one(held, pa.bool_()),
            "lengths": one(sizes, pa.int32()),
            "tokens": pa.array([tokens.data], pa.binary()),
            "words": one(words, pa.binary()),
            "counts": one(counts.astype(np.int64), pa.int64()),
        }
    )


def _blocks(folds: int, held_out: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, coded, held = [], [], [], 0
        # words are objects of Python for a piece of the texts at a time, and numbers from then on
        for batch, raw in blocks_of(batches, "text", BLOCK_BYTES):
            size = sum(map(len, raw))
            if ids and held + size > BLOCK_BYTES:
                block = _block(ids, lengths, coded, folds, held_out)
                ids, lengths, coded, held = [], [], [], 0
                yield block
                del block
            ids += batch.column(0).to_pylist()
            for texts in _runs(np.array([len(t) + 1 for t in raw]), PIECE_BYTES):
                found, numbers = _coded(raw[texts])
                lengths += found
                coded.append(numbers)
            held += size
        if ids:
            yield _block(ids, lengths, coded, folds, held_out)

    return run


def _values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _runs(lengths: np.ndarray, most: int = RUN_TOKENS) -> Iterator[slice]:
    """Neighbouring texts with ``most`` tokens at most, or one longer text."""
    first = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield slice(first, i)
            first, total = i, 0
        total += n
    if total:
        yield slice(first, len(lengths))


def _summed(tables: Tables):
    """Expected counts of a task's training texts: one row a class, then starts, moves and the likelihood."""
    states = len(tables.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, moves = np.zeros(states), np.zeros((states, states))
        counts, likelihood = np.zeros((states, tables.classes)), 0.0
        for batch in batches:
            for row in range(batch.num_rows):
                classes = class_of(batch.column("words")[row].values, tables.frequent)
                lengths = _values(batch, "lengths", row)
                trained = ~_values(batch, "held", row).astype(bool)
                tokens = np.frombuffer(batch.column("tokens")[row].as_buffer(), np.int32)[np.repeat(trained, lengths)]
                lengths = lengths[trained].astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                for texts in _runs(lengths):
                    own = classes[tokens[bounds[texts.start] : bounds[texts.stop]]]
                    found = expectations(Lanes(lengths[texts]), own, tables, np.float32)
                    start += found[0]
                    moves += found[1]
                    counts += found[2]
                    likelihood += found[3]
        seen = np.flatnonzero(counts.any(axis=0))
        rows = np.concatenate([counts[:, seen].T, start[None], moves, np.full((1, states), likelihood)])
        names = np.concatenate([seen, [-1], -2 - np.arange(states), [-2 - states]])
        yield pa.record_batch({"class": pa.array(names, pa.int64()), **{f"s{k}": pa.array(rows[:, k]) for k in range(states)}})

    return run


class Corpus:
    """Blocks of the documents and the counts of their words, written to shared storage."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, folds: int, held_out: int):
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        blocks = rows.mapInArrow(_blocks(folds, held_out), BLOCKS)
        self.blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "lm-blocks")
        used = self.blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.*").where("counts > 0")
        counts = used.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c"))
        self.counts = written(counts, "lm-counts")
        tail = F.crc32(F.expr("substring(word, greatest(length(word) - 2, 1), 3)")) % TAILS
        by_tail = self.counts.where("length(word) > 0").groupBy(tail.alias("tail"))
        sums = by_tail.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()  # TAILS rows at most
        best = self.counts.where("length(word) > 0").orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
        ends = self.counts.where("length(word) = 0").collect()
        self.frequent = {bytes(r.word): k for k, r in enumerate(best)}
        #: tokens and different words of each class
        self.tokens, self.words = np.zeros((2, FREQUENT + TAILS + 1), np.int64)
        for r in sums:
            self.tokens[FREQUENT + r.tail], self.words[FREQUENT + r.tail] = r.c, r.n
        for k, r in enumerate(best):
            self.tokens[k], self.words[k] = r.c, 1
            self.tokens[FREQUENT + zlib.crc32(bytes(r.word)[-3:]) % TAILS] -= r.c
            self.words[FREQUENT + zlib.crc32(bytes(r.word)[-3:]) % TAILS] -= 1
        for r in ends:
            self.tokens[-1], self.words[-1] = r.c, 1

    @property
    def shares(self) -> np.ndarray:
        return (self.tokens + 1.0) / (self.tokens.sum() + len(self.tokens))

    def round(self, tables: Tables) -> tuple[Tables, float]:
        """One round of Baum-Welch: new tables, and the likelihood under the old ones."""
        states = len(tables.start)
        columns = [f"s{k}" for k in range(states)]
        schema = ", ".join(["class long", *[f"{c} double" for c in columns]])
        found = self.blocks.select("held", "lengths", "tokens", "words").mapInArrow(_summed(tables), schema)
        counts, start, moves = np.zeros((states, tables.classes)), np.zeros(states), np.zeros((states, states))
        likelihood = 0.0
        # a row for each class, whatever the corpus
        for r in found.groupBy("class").agg(*[F.sum(c).alias(c) for c in columns]).collect():
            name, values = r[0], r[1:]
            if name >= 0:
                counts[:, name] = values
            elif name == -1:
                start[:] = values
            elif name == -2 - states:
                likelihood = values[0]
            else:
                moves[-2 - name] = values
        return normalised(start, moves, counts, self.shares, tables.frequent), likelihood

    def counted(self) -> DataFrame:
        """The blocks as rows of some 100,000 tokens, each block's behind its words and the training counts of those that have one."""
        words = self.blocks.select("block", F.posexplode("words").alias("i", "word"))
        known = words.join(self.counts, "word").select("block", "i", "c").mapInArrow(_known, KNOWN)
        rows = self.blocks.drop("counts").mapInArrow(_pieces, f"{KNOWN}, {PIECES}")
        return rows.unionByName(known, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "part")


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words' counts side by side, one row a block for every ``KNOWN_ROWS`` words."""

    def given(held: list[tuple]) -> pa.RecordBatch:
        block, place, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(block, kind="stable")
        numbers, first = np.unique(block[order], return_index=True)
        cut = lambda x: pa.array([v.tobytes() for v in np.split(x[order], first[1:])], pa.binary())
        return pa.record_batch(
            {
                "block": pa.array(numbers, pa.int64()),
                "part": pa.array(np.full(len(numbers), COUNTS), pa.int32()),
                "places": cut(place.astype(np.int32)),
                "found": cut(count.astype(np.int64)),
            }
        )

    held, rows = [], 0
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("block", "i", "c")))
        rows += batch.num_rows
        if rows >= KNOWN_ROWS:
            yield given(held)
            held, rows = [], 0
    if rows:
        yield given(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each block, then its texts, as many at a time as run through the recursion together."""
    kinds = {"block": pa.int64(), "part": pa.int32(), "places": pa.binary(), "found": pa.binary()}
    kinds |= {"words": pa.list_(pa.binary()), "ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_())}
    kinds |= {"lengths": pa.list_(pa.int32()), "tokens": pa.binary()}

    def row(**values) -> pa.RecordBatch:
        as_list = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        made = {n: as_list(v) if isinstance(v, pa.Array) else pa.array([v], kinds[n]) for n, v in values.items()}
        return pa.record_batch({n: made[n].cast(k) if n in made else pa.nulls(1, k) for n, k in kinds.items()})

    for batch in batches:
        for k in range(batch.num_rows):
            block = batch.column("block")[k].as_py()
            yield row(block=block, part=WORDS, words=batch.column("words")[k].values)
            ids, held, lengths = (batch.column(c)[k].values for c in ("ids", "held", "lengths"))
            tokens = batch.column("tokens")[k].as_buffer()
            ends = np.concatenate([[0], np.cumsum(lengths.to_numpy(), dtype=np.int64)]) * 4
            for part, texts in enumerate(_runs(lengths.to_numpy())):
                own = tokens.slice(ends[texts.start], ends[texts.stop] - ends[texts.start])
                yield row(block=block, part=part, ids=ids[texts], held=held[texts], lengths=lengths[texts], tokens=own.to_pybytes())


def _scored(tables: Tables, tokens: np.ndarray, words: np.ndarray):
    total, different = int(tokens.sum()), int(words.sum())
    within = np.log10(tokens + words + 1.0)
    alone = np.ones(len(tokens), bool)  # classes of one word
    alone[FREQUENT : FREQUENT + TAILS] = False

    def scores(batch: pa.RecordBatch, row: int, classes: np.ndarray, c: np.ndarray, share: np.ndarray, base: np.ndarray) -> pa.RecordBatch:
        lengths = _values(batch, "lengths", row).astype(np.int64)
        numbers = np.frombuffer(batch.column("tokens")[row].as_buffer(), np.int32)
        begins = np.cumsum(lengths) - lengths
        lanes = Lanes(lengths)
        placed = np.take(classes[numbers], lanes.token)
        _, scale = forward(lanes, np.take(tables.by_class, placed, axis=0), tables.start, tables.moves)
        text = np.repeat(np.arange(len(lengths)), lengths)[lanes.token]
        score = np.add.reduceat(share[numbers], begins)
        score += np.bincount(text, weights=np.log10(scale), minlength=len(lengths))
        return pa.record_batch(
            {
                "id": batch.column("ids")[row].values.cast(pa.int64()),
                "held_out": batch.column("held")[row].values,
                "n_tokens": pa.array(lengths),
                "n_known": pa.array(np.add.reduceat((c > 0)[numbers].astype(np.int64), begins)),
                "train_tokens": pa.array(np.full(len(lengths), total)),
                "base_score": pa.array(np.add.reduceat(base[numbers], begins)),
                "score": pa.array(score),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = c = share = base = np.zeros(0, np.int64)
        for batch in batches:
            for row, part in enumerate(batch.column("part").to_pylist()):
                if part == WORDS:
                    classes = class_of(batch.column("words")[row].values, tables.frequent)
                    c = np.zeros(len(classes), np.int64)
                elif part == COUNTS:
                    places, found = batch.column("places")[row].as_buffer(), batch.column("found")[row].as_buffer()
                    c[np.frombuffer(places, np.int32)] = np.frombuffer(found, np.int64)
                else:
                    if part == 0:
                        share = np.where(alone[classes], 0.0, np.log10(c + 1.0) - within[classes])
                        base = np.log10(c + 1.0) - np.log10(total + different + 1.0)
                    yield scores(batch, row, classes, c, share, base)

    return run


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, rounds: int = ROUNDS
) -> DataFrame:
    """One row for each input row: ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Rows whose CRC-32 of the id, as text, leaves ``held_out`` modulo ``folds`` are scored but not
    learned from. ``base_score`` is the unigram log10 probability with one added to every count, and
    ``score`` that of the hidden Markov model; both count the end of the text as a token. Null and
    blank texts are an end alone. A missing id counts as the empty string; repeated rows are rows of
    their own, and are learned as often as they stand. Without any training row both models give
    every word the share of an unknown one. Other columns are not read.
    """
    corpus = Corpus(docs, id_col, text_col, folds, held_out)
    tables = first_tables(corpus.shares, corpus.frequent)
    for _ in range(rounds):
        tables, _ = corpus.round(tables)
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = corpus.counted().mapInArrow(_scored(tables, corpus.tokens, corpus.words), schema)
    return scored.withColumnRenamed("id", id_col)

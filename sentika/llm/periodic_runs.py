"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words that repeats its first ``q`` words four times or more, as far as that
repetition reaches. Every text is searched by itself:

* Blocks of ``2**k`` words are named level by level, by pairs of the names of their halves. The last
  level orders all suffixes; a block's occurrences are a range of that order at every level.
* A run of period ``q`` holds, for the level with ``2**(k-1) < q <= 2**k``, a block that starts at a
  multiple of ``2**(k-1)`` and occurs again ``q`` words on. Its length is no less than ``q``, and what
  repeats is no power, so it occurs nowhere between: the occurrences in the window behind it form a
  progression, and the distance to the next one is the period.
* The next occurrence is a range successor: the least position above ``x`` in a range of the suffix
  array, answered by a wavelet tree (a rank, then a selection by that rank).
* Each candidate is stretched to both sides by comparing blocks of falling length.

Blocks that occur less often than a run of their level makes them are not asked about. Work for ``n``
words grows as ``n log n``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentika.llm.common import blocks_of

#: Least repetitions and least words of a run.
EXPONENT, LEAST_WORDS = 4, 6
#: Words that are searched together; a longer text is searched alone.
BATCH_WORDS = 1 << 15
RUN = "struct<start:long,length:long,period:long>"
OUT = f"id long, n_words long, runs array<{RUN}>, collapsed binary"


class SuffixBlocks:
    """Names of all blocks of ``2**k`` words and the suffix array, of texts laid in a row.

    ``names[k][i]`` is the first place, in suffix order, of the suffixes that begin with the block
    at ``i``; ``sizes[k][i]`` counts them. Equal names mean equal blocks within one text.
    """

    def __init__(self, words: np.ndarray, text_of: np.ndarray):
        """``words`` are numbers, each text followed by one number that is used nowhere else."""
        n = len(words)
        key = text_of.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable").astype(np.int32)
        name, size = np.empty(n, np.int32), np.empty(n, np.int32)
        self._set(name, size, order, key[order], np.zeros(n, np.int32))
        self.names, self.sizes = [name], [size]
        width = 1
        while True:
            open_ = np.flatnonzero(size > 1)
            if not len(open_):
                break
            key = name[open_].astype(np.int64) * n + name[open_ + width]
            order = np.argsort(key, kind="stable")
            name, size = name.copy(), size.copy()
            self._set(name, size, open_[order], key[order], self.names[-1])
            self.names.append(name)
            self.sizes.append(size)
            width *= 2
        self.suffixes = np.empty(n, np.int32)
        self.suffixes[name] = np.arange(n, dtype=np.int32)

    @staticmethod
    def _set(name: np.ndarray, size: np.ndarray, order: np.ndarray, keys: np.ndarray, before: np.ndarray) -> None:
        """Name positions in order of their keys: the group's place within its older group, and its size."""
        old = before[order]
        fresh = np.empty(len(keys), bool)
        fresh[:1] = True
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        starts = np.flatnonzero(fresh)
        parent = np.empty(len(keys), bool)
        parent[:1] = True
        np.not_equal(old[1:], old[:-1], out=parent[1:])
        parent_at = np.flatnonzero(parent)
        counts = np.diff(np.append(starts, len(keys)))
        shift = starts - parent_at[np.cumsum(parent)[starts] - 1]
        name[order] = old + np.repeat(shift, counts).astype(np.int32)
        size[order] = np.repeat(counts, counts).astype(np.int32)

    def stretch(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words from ``a`` and ``b`` on are equal, and how many before them."""
        ahead, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        n = len(self.suffixes)
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            x, y = a + ahead, b + ahead
            inside = (x < n) & (y < n)
            equal = inside & (name[np.minimum(x, n - 1)] == name[np.minimum(y, n - 1)]) & (x != y)
            ahead[equal] += 1 << k
            x, y = a - back - (1 << k), b - back - (1 << k)
            equal = (x >= 0) & (y >= 0) & (x != y)
            equal &= name[np.maximum(x, 0)] == name[np.maximum(y, 0)]
            back[equal] += 1 << k
        return ahead, back


class WaveletTree:
    """Positions in suffix order, split bit by bit; answers many questions at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b) & 1
            zero = np.zeros(len(values) + 1, np.int32)
            np.cumsum(one ^ 1, out=zero[1:])
            self.zeros.append(zero)
            values = np.concatenate([values[one == 0], values[one == 1]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value from ``x`` on among the places ``lo`` to ``hi - 1``; -1 if there is none."""
        # how many values of the range are below x
        below = np.zeros(len(lo), np.int32)
        a, b = lo.astype(np.int32), hi.astype(np.int32)
        for level, zero in enumerate(self.zeros):
            one = ((x >> (self.bits - 1 - level)) & 1).astype(bool)
            a0, b0 = zero[a], zero[b]
            below += np.where(one, b0 - a0, 0)
            a, b = np.where(one, zero[-1] + a - a0, a0), np.where(one, zero[-1] + b - b0, b0)
        there = (below < hi - lo) & (x >> self.bits == 0)
        # the value of that rank
        a, b, rank = lo[there].astype(np.int32), hi[there].astype(np.int32), below[there]
        value = np.zeros(len(a), np.int32)
        for zero in self.zeros:
            a0, b0 = zero[a], zero[b]
            one = rank >= b0 - a0
            rank = np.where(one, rank - (b0 - a0), rank)
            a, b = np.where(one, zero[-1] + a - a0, a0), np.where(one, zero[-1] + b - b0, b0)
            value = 2 * value + one
        out = np.full(len(lo), -1, np.int32)
        out[there] = value
        return out


def runs_of(words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs of texts laid in a row, by start and period."""
    blocks = SuffixBlocks(words, text_of)
    n = len(words)
    start, lo, hi, width = [], [], [], []
    for k, (name, size) in enumerate(zip(blocks.names, blocks.sizes, strict=True)):
        at = np.arange(0, n, max(1, 1 << k >> 1))
        # so often at least does a block of this width occur in a run of this level's shortest period
        period = (1 << k >> 1) + 1
        least = (max(LEAST_WORDS, EXPONENT * period) - (1 << k) + 1) // period
        at = at[size[at] >= least]
        start.append(at)
        lo.append(name[at])
        hi.append(name[at] + size[at])
        width.append(np.full(len(at), 1 << k))
    s, lo, hi, width = map(np.concatenate, (start, lo, hi, width))
    if not len(s):
        return s, s, s
    after = WaveletTree(blocks.suffixes).successor(lo, hi, s + 1)
    found = (after > 0) & (after - s <= width)
    a, b = s[found], after[found].astype(np.int64)
    ahead, back = blocks.stretch(a, b)
    first, period = a - back, b - a
    length = ahead + back + period
    good = length >= np.maximum(LEAST_WORDS, EXPONENT * period)
    rows = np.unique(np.stack([first[good], period[good], length[good]], axis=1), axis=0)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def _texts_found(texts: list[list[bytes]]) -> Iterator[tuple[list[dict], bytes]]:
    """Runs of each text, and the text without the repetitions."""
    sizes = np.array([len(t) for t in texts])
    flat = [w for t in texts for w in t]
    begins = np.cumsum(sizes + 1) - sizes - 1
    total = int(sizes.sum()) + len(texts)
    words = np.empty(total, np.int64)
    ends = begins + sizes
    inner = np.ones(total, bool)
    inner[ends] = False
    words[inner] = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    words[ends] = len(flat)
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    start, length, period = runs_of(words, text_of)
    dropped = np.zeros(total + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, start + length, -1)
    dropped = np.cumsum(dropped) > 0
    cut = np.searchsorted(start, np.append(begins, total))
    for i, own in enumerate(texts):
        own_runs = slice(cut[i], cut[i + 1])
        runs = [
            {"start": s - int(begins[i]), "length": n, "period": q}
            for s, n, q in zip(start[own_runs].tolist(), length[own_runs].tolist(), period[own_runs].tolist(), strict=True)
        ]
        if runs:
            gone = dropped[begins[i] : ends[i]]
            own = [own[j] for j in np.flatnonzero(~gone).tolist()]
        yield runs, b" ".join(own)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Words made periodic from some place on, in a tenth of the documents (by hash of the id)."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _runs(plant: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def solve(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = list(_texts_found(texts))
        return pa.record_batch(
            {
                "id": pa.array(ids, pa.int64()),
                "n_words": pa.array([len(t) for t in texts], pa.int64()),
                "runs": pa.array([r for r, _ in found], kind),
                "collapsed": pa.array([c for _, c in found], pa.binary()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0
        for batch, raw in blocks_of(batches, "text", 1 << 20):
            for doc_id, text in zip(batch.column(0).to_pylist(), raw, strict=True):
                words = text.split()  # bytes are split at blanks and at \x09-\x0D
                if texts and held + len(words) > BATCH_WORDS:
                    yield solve(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(planted(words, doc_id) if plant else words)
                held += len(words)
        if texts:
            yield solve(ids, texts)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row for each input row: the id, ``n_words``, its ``runs`` and its ``collapsed`` bytes.

    Words are separated by blanks and line breaks (bytes 9 to 13 and 32). ``runs`` hold start,
    length and period in words, by start and period; periods are least ones. ``collapsed`` keeps,
    joined by single blanks, the words that no run holds after its first period. ``plant`` makes
    the words of a tenth of the documents periodic first, which gives known runs to look for.

    Null and blank texts have no words and no runs; null and repeated ids are rows of their own
    (rows without an id are never planted); other columns are not read. A text is searched by one
    task, whatever its length, with about 100 bytes a word and level.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_runs(plant), OUT).withColumnRenamed("id", id_col)


def run_digest(runs: str = "runs") -> Column:
    """SHA-256 of every run as ``start,length,period`` and a line feed, as lowercase hex."""
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.sha2(F.array_join(line, "").cast("binary"), 256)


def longest_run(runs: str = "runs") -> Column:
    """The run of greatest length (the smallest start, then period, of equals); null without runs."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("k"), r["start"].alias("s"), r["period"].alias("p"), r.alias("r")))
    return F.array_min(ranked)["r"]


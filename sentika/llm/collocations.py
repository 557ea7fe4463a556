"""Phrase collocations: suffixes routed by their leading words, sorted by multikey quicksort.

A suffix is a word with the words behind it, three at most, within a piece of a text. Tasks count
equal suffixes of their own texts and send the counts off by their leading words: by two words,
and by three where both of these are frequent (``HOT`` of all words or more; at most ``1 / HOT``
words can be), so that no pair of words gathers a great part of all suffixes in one place. For
those pairs their own counts are sent too.

All suffixes that begin with a phrase then lie in one bucket, where pointers to them are sorted by a
three-way multikey quicksort: each partition is split by one word, into the smaller, the equal and
the larger ones; the equal ones go on with the next word, to the third at most. The weight of an
equal partition is the count of its phrase. A partition whose whole weight is below the least count
holds no phrase of that count and is abandoned. The partitions of a bucket are split side by side.

What remains are frequent phrases alone. Spark joins them with the counts of their parts, ranks
them and drops those that a longer one explains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentika.llm.common import blocks_of, mix64, written

LEAST_COUNT = 10
DEPTH = 3
#: Share of all words from which a word is frequent, for routing.
HOT = 1 / 4096
#: Suffixes of a bucket on average, and bytes of text that a task counts together.
BUCKET_SUFFIXES, BATCH_BYTES = 1 << 20, 16 << 20
#: Share of a phrase's occurrences within one longer phrase from which it is dropped.
WITHIN_PERCENT = 50
#: Language of rows without one.
NO_LANGUAGE = "und"
#: Capital letters to small ones, everything that ends a piece to a full stop, tabs to blanks.
_PIECES = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
SUFFIXES = "bucket long, lang string, kind int, words array<binary>, suffixes binary, weights binary"
PHRASES = "lang string, w1 string, w2 string, w3 string, a long"


def coded_words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words of several texts as numbers of different words; 0 ends a piece."""
    joined = b" . ".join(t.translate(_PIECES).replace(b".", b" . ") for t in texts)
    coded = pa.array([b".", *joined.split()], pa.large_binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False)[1:].astype(np.int64), coded.dictionary


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language each, gathered to ``BATCH_BYTES`` of all languages."""
    texts: dict[str, list[bytes]] = {}
    held = 0
    for batch, raw in blocks_of(batches, "text", BATCH_BYTES):
        for lang, text in zip(batch.column(0).to_pylist(), raw, strict=True):
            if text:
                texts.setdefault(lang, []).append(text)
                held += len(text)
        if held >= BATCH_BYTES:
            yield from texts.items()
            texts, held = {}, 0
    yield from texts.items()


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, texts in _by_language(batches):
        words, names = coded_words(texts)
        n = np.bincount(words, minlength=len(names))
        yield pa.record_batch(
            {
                "lang": pa.array([lang] * (len(names) - 1), pa.string()),
                "word": names[1:].cast(pa.large_string()).cast(pa.string()),
                "n": pa.array(n[1:].astype(np.int64)),
            }
        )


def counted_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different suffixes of two words or more, as rows of numbers (0 behind the end of a piece), with
    their counts; then the different pairs of leading words, with theirs."""
    size = int(words.max(initial=0)) + 1
    padded = np.append(words, [0, 0])
    at = np.flatnonzero((padded[:-2] > 0) & (padded[1:-1] > 0))
    pairs, pair_of, pair_counts = np.unique(padded[at] * size + padded[at + 1], return_inverse=True, return_counts=True)
    keys, counts = np.unique(pair_of * size + padded[at + 2], return_counts=True)
    pairs = np.stack([pairs // size, pairs % size], axis=1)
    rows = np.empty((len(keys), DEPTH), np.int64)
    rows[:, :2] = pairs[keys // size]
    rows[:, 2] = keys % size
    return rows, counts, pairs, pair_counts


def _routed(buckets: int, hot: dict[str, list[bytes]]):
    """Counted suffixes of a task's texts, one row for each bucket, language and kind.

    Kind 0 are suffixes that meet all others with their first two words; kind 1 are suffixes of
    frequent pairs, which meet only those with the same three.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_language(batches):
            words, names = coded_words(texts)
            rows, counts, pairs, pair_counts = counted_suffixes(words)
            if not len(rows):
                continue
            own = np.fromiter((xxhash.xxh3_64_intdigest(w.as_py()) for w in names), np.uint64, len(names))
            frequent = pc.is_in(names, pa.array(hot.get(lang, []), pa.large_binary())).to_numpy(zero_copy_only=False)
            both, pair_both = frequent[rows[:, 0]] & frequent[rows[:, 1]], frequent[pairs[:, 0]] & frequent[pairs[:, 1]]
            third = both & (rows[:, 2] > 0)
            whole = np.concatenate([pairs[pair_both], np.zeros((int(pair_both.sum()), 1), np.int64)], axis=1)
            parts = [(0, rows[~both], counts[~both]), (0, whole, pair_counts[pair_both]), (1, rows[third], counts[third])]
            seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
            for kind in (0, 1):
                rows = np.concatenate([r for k, r, _ in parts if k == kind])
                counts = np.concatenate([c for k, _, c in parts if k == kind])
                key = np.full(len(rows), seed)
                for d in range(DEPTH if kind else 2):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + own[rows[:, d]])
                bucket = (key % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rows, counts, bucket = rows[order], counts[order], bucket[order]
                edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    used, numbers = np.unique(np.append(rows[lo:hi].ravel(order="F"), 0), return_inverse=True)
                    width = np.uint16 if len(used) < 1 << 16 else np.uint32
                    yield pa.record_batch(
                        {
                            "bucket": pa.array([int(bucket[lo])], pa.int64()),
                            "lang": pa.array([lang], pa.string()),
                            "kind": pa.array([kind], pa.int32()),
                            "words": pa.array([names.take(pa.array(used)).cast(pa.binary())], pa.list_(pa.binary())),
                            "suffixes": pa.array([numbers[:-1].astype(width).tobytes()], pa.binary()),
                            "weights": pa.array([counts[lo:hi].astype(np.uint32).tobytes()], pa.binary()),
                        }
                    )

    return run


def multikey_quicksort(keys: list[np.ndarray], weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phrases of weight ``least`` or more: ``(words, a suffix that begins with it, its weight)``.

    ``keys`` hold one array of numbers for each depth; a phrase of ``d`` words ends with equal
    partitions of the ``d``-th. All open partitions are split by one word at a time, side by side.
    """
    pointers = np.arange(len(weights))
    starts, sizes, depths = np.array([0]), np.array([len(weights)]), np.array([0])
    stacked = np.stack(keys)
    while len(starts):
        # lay the open partitions in a row
        part = np.repeat(np.arange(len(starts)), sizes)
        fresh = np.cumsum(sizes) - sizes
        pointers = pointers[np.arange(len(part)) + np.repeat(starts - fresh, sizes)]
        starts = fresh
        depth = depths[part]
        key = stacked[depth, pointers]
        # the pivot is the middle one of three
        sample = np.sort(key[np.stack([starts, starts + sizes // 2, starts + sizes - 1])], axis=0)
        pivot = sample[1][part]
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        group = 3 * part + side
        counts = np.bincount(group, minlength=3 * len(starts))
        weight = np.bincount(group, weights=weights[pointers], minlength=3 * len(starts)).astype(np.int64)
        # stable three-way partition: the place of an element is its rank among its side
        begin = np.cumsum(counts) - counts
        place = np.empty(len(part), np.int64)
        for s in range(3):
            own = np.flatnonzero(side == s)
            rank = np.arange(len(own))
            first = np.concatenate([[0], np.cumsum(counts[s::3])[:-1]])
            place[own] = begin[group[own]] + rank - first[part[own]]
        moved = np.empty_like(pointers)
        moved[place] = pointers
        pointers = moved
        deeper = np.repeat(depths, 3)
        deeper[1::3] += 1
        heavy = weight >= least
        for d in range(1, len(keys) + 1):
            found = heavy & (deeper == d)
            found[0::3] = found[2::3] = False
            found = np.flatnonzero(found)
            if len(found):
                yield d, pointers[begin[found]], weight[found]
        open_ = heavy & (deeper < len(keys))
        starts, sizes, depths = begin[open_], counts[open_], deeper[open_]


def _sorted_buckets(least: int):
    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        names = pa.concat_arrays([r[2].cast(pa.large_binary()) for r in rows]).dictionary_encode()
        numbers, names = names.indices.to_numpy(zero_copy_only=False), names.dictionary
        langs = {lang: k for k, lang in enumerate(sorted({r[0] for r in rows}))}
        # an empty word stands behind the end of a piece
        parts, at = [], 0
        for lang, kind, words, suffixes, weights in rows:
            width = np.uint16 if len(words) < 1 << 16 else np.uint32
            own = numbers[at : at + len(words)][np.frombuffer(suffixes, width).reshape(DEPTH, -1)]
            at += len(words)
            n = np.frombuffer(weights, np.uint32)
            parts.append((np.full(len(n), 2 * langs[lang] + kind), own, n))
        keys = [np.concatenate([p[0] for p in parts]), *np.concatenate([p[1] for p in parts], axis=1)]
        weights = np.concatenate([p[2] for p in parts]).astype(np.int64)
        ended = names.index(pa.scalar(b".", pa.large_binary())).as_py()
        names = names.cast(pa.large_string()).cast(pa.string())
        labels = pa.array(sorted(langs), pa.string())
        for depth, suffix, weight in multikey_quicksort(keys, weights, least):
            # the first key is the language
            wanted = (keys[0][suffix] % 2 == 0) if depth == 3 else (keys[3][suffix] != ended) & (depth == 4)
            suffix, weight = suffix[wanted], weight[wanted]
            if len(suffix):
                column = lambda d: names.take(pa.array(keys[d][suffix]))  # noqa: B023, E731
                yield pa.record_batch(
                    {
                        "lang": labels.take(pa.array(keys[0][suffix] // 2)),
                        "w1": column(1),
                        "w2": column(2),
                        "w3": column(3) if depth == 4 else pa.nulls(len(suffix), pa.string()),
                        "a": pa.array(weight),
                    }
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current = None
        for batch in batches:
            for k in range(batch.num_rows):
                bucket = batch.column(0)[k].as_py()
                if rows and bucket != current:
                    yield from solve(rows)
                    rows = []
                current = bucket
                lang, kind, words, suffixes, weights = (batch.column(c)[k] for c in range(1, 6))
                rows.append((lang.as_py(), kind.as_py(), words.values, suffixes.as_py(), weights.as_py()))
        if rows:
            yield from solve(rows)

    return run


class Collocations:
    """The steps of one run; tables between them are written to shared storage."""

    def __init__(self, docs: DataFrame, lang_col: str, text_col: str, least: int):
        self.texts = docs.select(F.coalesce(lang_col, F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
        words = self.texts.mapInArrow(_counted_words, "lang string, word string, n long")
        self.words = written(words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "phrase-words")
        self.least = least

    def phrases(self) -> DataFrame:
        """``lang, w1, w2, w3, a`` of all phrases of two and three words with the least count."""
        total = self.words.agg(F.sum("f")).first()[0] or 0
        # at most 1 / HOT words have that share of all
        hot: dict[str, list[bytes]] = {}
        for r in self.words.where(F.col("f") >= max(total * HOT, 1)).select("lang", F.col("word").cast("binary")).collect():
            hot.setdefault(r.lang, []).append(bytes(r.word))
        buckets = -(-total // BUCKET_SUFFIXES) or 1
        routed = self.texts.mapInArrow(_routed(buckets, hot), SUFFIXES)
        in_order = routed.repartition("bucket").sortWithinPartitions("bucket")
        return written(in_order.mapInArrow(_sorted_buckets(self.least), PHRASES), "phrases")

    def scored(self) -> DataFrame:
        """``lang, phrase, size, a, l, r, n, score`` of the phrases that no longer one explains."""
        phrases = self.phrases()
        pairs = phrases.where("w3 IS NULL").select("lang", "w1", "w2", "a")
        triples = phrases.where("w3 IS NOT NULL")
        known = self.words.where(F.col("f") >= self.least)
        word = lambda name, f: known.select("lang", F.col("word").alias(name), F.col("f").alias(f))
        pair = lambda x, y, f: pairs.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(f))
        inside = triples.select("lang", "w1", "w2", "a").unionAll(triples.select("lang", "w2", "w3", "a"))
        longest = inside.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
        twos = (
            pairs.join(longest, ["lang", "w1", "w2"], "left")
            .where(f"longer IS NULL OR 100 * longer < {WITHIN_PERCENT} * a")
            .join(word("w1", "l"), ["lang", "w1"])
            .join(word("w2", "r"), ["lang", "w2"])
            .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.lit(2).alias("size"), "a", "l", "r", _score("l", "r"))
        )
        threes = (
            triples.join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"])
            .join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"])
            .join(word("w1", "l1"), ["lang", "w1"])
            .join(word("w3", "r2"), ["lang", "w3"])
            .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.lit(3).alias("size"), "a",
                    F.struct("l1", "r1", _score("l1", "r1")).alias("c1"), F.struct("l2", "r2", _score("l2", "r2")).alias("c2"))
        )
        first = F.col("c1.score") <= F.col("c2.score")
        cut = lambda x, y: F.when(first, F.col(f"c1.{x}")).otherwise(F.col(f"c2.{y}"))
        threes = threes.select("lang", "phrase", "size", "a", cut("l1", "l2").alias("l"), cut("r1", "r2").alias("r"),
                               cut("score", "score").alias("score"))
        n = self.words.groupBy("lang").agg(F.sum("f").alias("n"))
        return twos.unionByName(threes).join(n, "lang").select("lang", "phrase", "size", "a", "l", "r", "n", "score")


def _score(left: str, right: str) -> Column:
    """Occurrences squared over the product of the parts' counts, in millionths, rounded down."""
    whole = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    return F.expr(f"(1000000 * {whole('a')} * {whole('a')}) div ({whole(left)} * {whole(right)})").alias("score")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, top: int | None = 2000
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases of two and three words.

    Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends, and these into
    words at blanks and tabs. A phrase occurs ``a`` times, ``least`` at least; it is cut where its
    score is lowest (the earliest of equals) into parts that occur ``l`` and ``r`` times; ``n``
    counts the language's words. Dropped are phrases of two words half of whose occurrences or more
    lie within one phrase of three. Ranks go by score, then ``a``, then the phrase's bytes; ``top``
    is how many ranks are reported (None: all).

    Null texts have no words and null languages are one language, ``und``; repeated rows count as
    often as they stand; an empty table gives no rows. Other columns are not read. A word that no
    text ends is one word, whatever its length.
    """
    found = Collocations(docs, lang_col, text_col, least).scored()
    order = F.struct((-F.col("score")).alias("s"), (-F.col("a")).alias("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

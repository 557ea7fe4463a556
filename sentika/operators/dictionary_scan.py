"""Lexicons of any size as tables: automata, shared part by part, and counted hits.

The pattern form (:func:`sentika.functions.labels.hit_count`) tries its terms one after another at
every word; here all terms of a part are followed at once by an Aho-Corasick automaton whose steps
are pieces of text: a word, or one other character. Counts are those of the pattern: hits of one
label do not overlap, the leftmost wins, and of those that start together the first listed.

An automaton holds ``PART_TERMS`` terms at most, and the driver and every worker hold one. A larger
table stays a table: texts are read once, block by block; a block asks for each different window of
pieces that may be a term once, the terms answer by a join, and the matches are put together in their
block. So the work grows with texts and terms, not with their product.
"""

from __future__ import annotations

import uuid
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentika.functions.labels import detect_sentiment
from sentika.lexicons import GENERAL
from sentika.session import scratch_path

#: Terms of one automaton.
PART_TERMS = 200_000
#: A word is what the pattern's boundary test takes for one.
_WORD = r"\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200C\u200D"
_PIECES = regex.compile(rf"[{_WORD}]+|[^{_WORD}]", regex.DOTALL)
_IS_WORD = regex.compile(rf"[{_WORD}]")
#: Joins the pieces of a window; pieces are words or single characters, so no two windows look the same.
_JOINT = "\x1f"
_BLOCK = 1 << 20  # characters of a block of texts
_BITS = 1 << 26  # of the map that tells most windows that are no term, whatever the lexicon
_PAGE = 1 << 16  # bits of a row of the map
MATCH = "struct<start:int,ord:long,stop:int>"
FOUND = f"array<struct<label:string,matches:array<{MATCH}>>>"


def pieces(text: str) -> list[str]:
    """Words and single other characters, in small letters."""
    return [p.lower() for p in _PIECES.findall(text)]


class Automaton:
    """Follows all terms at once; a state is the longest run of pieces that begins a term."""

    def __init__(self, terms: Iterable[tuple[str, str, int]]):
        """``terms`` are rows of label, term and order."""
        self.labels: list[str] = []
        numbers: dict[str, int] = {}
        self.next: list[dict[str, int]] = [{}]
        #: per state the terms that end there: label, order, pieces
        self.ends: list[list[tuple[int, int, int]]] = [[]]
        for label, term, order in terms:
            steps = pieces(term or "")
            if not steps:
                continue
            if label not in numbers:
                numbers[label] = len(self.labels)
                self.labels.append(label)
            state = 0
            for step in steps:
                state = self.next[state].setdefault(step, len(self.next))
                if state == len(self.ends):
                    self.next.append({})
                    self.ends.append([])
            self.ends[state].append((numbers[label], order, len(steps)))
        # where to go on when a run cannot grow: its longest proper ending that begins a term
        self.fall = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            state = waiting.popleft()
            for step, child in self.next[state].items():
                back = self.fall[state]
                while back and step not in self.next[back]:
                    back = self.fall[back]
                self.fall[child] = self.next[back].get(step, 0)
                waiting.append(child)
            self.ends[state] = self.ends[state] + self.ends[self.fall[state]]

    def matches(self, text: str) -> dict[str, list[tuple[int, int, int]]]:
        """Per label all places where a term stands between word boundaries: start, order and stop, in pieces."""
        found: dict[str, list[tuple[int, int, int]]] = {}
        state, grow, fall, ends = 0, self.next, self.fall, self.ends
        parts = pieces(text)
        word: list[bool] | None = None
        for stop, step in enumerate(parts, 1):
            while state and step not in grow[state]:
                state = fall[state]
            state = grow[state].get(step, 0)
            for label, order, size in ends[state]:
                if word is None:
                    word = [False, *(_IS_WORD.match(p) is not None for p in parts), False]
                start = stop - size
                # a boundary lies between a word and what is none (or an end of the text)
                if word[start] != word[start + 1] and word[stop] != word[stop + 1]:
                    found.setdefault(self.labels[label], []).append((start, order, stop))
        return found


_FOUND = pa.list_(
    pa.struct(
        [
            ("label", pa.string()),
            ("matches", pa.list_(pa.struct([("start", pa.int32()), ("ord", pa.int64()), ("stop", pa.int32())]))),
        ]
    )
)


def _scan(automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton.value
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                hits = own.matches(text) if text else {}
                found.append(
                    [
                        {"label": a, "matches": [{"start": s, "ord": o, "stop": e} for s, o, e in m]}
                        for a, m in sorted(hits.items())
                    ]
                )
            yield pa.record_batch([batch.column(0), pa.array(found, _FOUND)], ["key", "found"])

    return run


def _counted(matches: Column) -> Column:
    """How many matches count: from the left, the first listed of each start, none within another."""
    start = F.struct(F.lit(0).alias("free"), F.lit(0).cast("long").alias("n"))

    def step(held: Column, m: Column) -> Column:
        taken = m["start"] >= held["free"]
        return F.struct(
            F.when(taken, m["stop"]).otherwise(held["free"]).alias("free"),
            (held["n"] + taken.cast("long")).alias("n"),
        )

    return F.aggregate(F.array_sort(matches), start, step, lambda held: held["n"])


class _IsWord(dict):
    """Whether a piece is a word, remembered."""

    def __missing__(self, piece: str) -> bool:
        self[piece] = found = _IS_WORD.match(piece) is not None
        return found


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms as windows, with their size and whether they begin and end with a word."""
    is_word = _IsWord()
    for batch in batches:
        split = [pieces(t) for t in batch.column(1).to_pylist()]
        yield pa.record_batch(
            {
                "label": batch.column(0),
                "steps": pa.array([_JOINT.join(p) for p in split], pa.string()),
                "ord": batch.column(2),
                "size": pa.array([len(p) for p in split], pa.int32()),
                "opens": pa.array([bool(p) and is_word[p[0]] for p in split], pa.bool_()),
                "closes": pa.array([bool(p) and is_word[p[-1]] for p in split], pa.bool_()),
            }
        )


def _bit(window: str) -> int:
    return zlib.crc32(window.encode()) % _BITS


def _window_map(table: DataFrame) -> np.ndarray:
    """One bit for the hash of each term, gathered page by page: ``_BITS`` bits at most."""
    bit = F.crc32(F.encode("steps", "utf-8")) % _BITS
    pages = table.select(F.floor(bit / _PAGE).cast("int").alias("page"), (bit % _PAGE).cast("int").alias("bit"))
    bits = np.zeros(_BITS // 8, np.uint8)
    for r in pages.groupBy("page").agg(F.collect_set("bit").alias("bits")).toLocalIterator():
        at = np.array(r.bits, np.int64) + r.page * _PAGE
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def _windows(shapes: list[tuple[int, bool, bool]], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = memoryview(shared.value)
        for batch in batches:
            texts, first = batch.column(1), 0
            while first < len(texts):
                numbers: dict[str, int] = {}  # of the windows asked for; -1 where the map says that there is none
                is_word, asked, rows, size = _IsWord(), [], [], 0
                while first + len(rows) < len(texts) and size < _BLOCK:
                    text = texts[first + len(rows)].as_py() or ""
                    size += len(text)
                    starts, stops, found = [], [], []
                    parts = pieces(text)
                    # a boundary lies between a word and what is none (or an end of the text)
                    word = [False, *[is_word[p] for p in parts], False]
                    for n, opens, closes in shapes:
                        for start in range(len(parts) - n + 1):
                            stop = start + n
                            if word[start + 1] != opens or word[start] == opens or word[stop] != closes or word[stop + 1] == closes:
                                continue
                            window = parts[start] if n == 1 else _JOINT.join(parts[start:stop])
                            number = numbers.get(window)
                            if number is None:
                                bit = _bit(window)
                                number = len(asked) if bits[bit >> 3] >> (bit & 7) & 1 else -1
                                numbers[window] = number
                                if number >= 0:
                                    asked.append(window)
                            if number >= 0:
                                starts.append(start)
                                stops.append(stop)
                                found.append(number)
                    rows.append((starts, stops, found))
                ints = pa.list_(pa.int32())
                yield pa.record_batch(
                    {
                        "block": pa.array([uuid.uuid4().hex] * len(rows), pa.string()),
                        "key": batch.column(0).slice(first, len(rows)),
                        "starts": pa.array([r[0] for r in rows], ints),
                        "stops": pa.array([r[1] for r in rows], ints),
                        "numbers": pa.array([r[2] for r in rows], ints),
                        "windows": pa.array([asked, *[None] * (len(rows) - 1)], pa.list_(pa.string())),
                    }
                )
                first += len(rows)

    return run


def _in_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """``key, found`` of the texts of a block from its windows that are terms."""
    ints = lambda name: np.concatenate([np.empty(0, np.int64), *[c.flatten().to_numpy(zero_copy_only=False) for c in texts[name].chunks]]).astype(np.int64)
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in texts["numbers"].chunks])
    text, start, stop, number = np.repeat(np.arange(len(sizes)), sizes), ints("starts"), ints("stops"), ints("numbers")
    answers = answers.sort_by("number")
    own = answers["number"].to_numpy()
    # the answers of each window stand side by side: every occurrence takes all of them
    low, high = np.searchsorted(own, number), np.searchsorted(own, number, "right")
    times = high - low
    at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
    text, start, stop = np.repeat(text, times), np.repeat(start, times), np.repeat(stop, times)
    names = answers["label"].combine_chunks().dictionary_encode()
    label = names.indices.to_numpy(zero_copy_only=False)[at] if len(own) else at
    order = np.lexsort((stop, start, label, text))
    text, label = text[order], label[order]
    heads = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    ends = lambda x: pa.array(x, pa.int32())
    matches = pa.StructArray.from_arrays(
        [pa.array(start[order], pa.int32()), answers["ord"].combine_chunks().take(pa.array(at[order])), pa.array(stop[order], pa.int32())],
        fields=list(_FOUND.value_type.field("matches").type.value_type),
    )
    of_label = pa.ListArray.from_arrays(ends(np.append(heads, len(text))), matches)
    told = names.dictionary.take(pa.array(label[heads], pa.int32())).cast(pa.string())
    per_text = pa.StructArray.from_arrays([told, of_label], fields=list(_FOUND.value_type))
    found = pa.ListArray.from_arrays(ends(np.searchsorted(text[heads], np.arange(len(sizes) + 1))), per_text)
    return pa.table({"key": texts["key"], "found": found.cast(_FOUND)})


def _found_by_join(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``key, found`` of every row, the terms being a table of any size."""
    spark, key = rows.sparkSession, rows.schema["key"].dataType.simpleString()
    path = scratch_path(spark, "lexicon-terms")
    split = listed.mapInArrow(_steps, "label string, steps string, ord long, size int, opens boolean, closes boolean").where("size > 0")
    # of equal terms of a label the first listed counts
    split.groupBy("steps", "label", "size", "opens", "closes").agg(F.min(F.struct("ord"))["ord"].alias("ord")).write.parquet(path)
    table = spark.read.parquet(path)
    shapes = sorted(tuple(r) for r in table.select("size", "opens", "closes").distinct().collect())  # lengths of terms
    shared = spark.sparkContext.broadcast(_window_map(table).tobytes())
    ints = "array<int>"
    shape = f"block string, key {key}, starts {ints}, stops {ints}, numbers {ints}, windows array<string>"
    path = scratch_path(spark, "lexicon-windows")
    rows.mapInArrow(_windows(shapes, shared), shape).write.parquet(path)  # texts are read once
    shared.unpersist()
    texts = spark.read.schema(shape).parquet(path)
    asked = texts.where("windows IS NOT NULL").select("block", F.posexplode("windows").alias("number", "steps"))
    answers = asked.join(table.select("steps", "label", "ord"), "steps").select(F.col("block").alias("of"), "number", "label", "ord")
    found = texts.drop("windows").groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_in_block, f"key {key}, found {FOUND}")
    none = F.array().cast(FOUND)
    if texts.groupBy("key").count().where("count > 1").isEmpty():
        return found.select("key", F.when(F.col("key").isNotNull(), F.col("found")).otherwise(none).alias("found"))
    labels = found.select("key", F.explode("found").alias("f")).groupBy("key", "f.label")
    merged = labels.agg(F.flatten(F.collect_list("f.matches")).alias("matches"))
    merged = merged.groupBy("key").agg(F.collect_list(F.struct("label", "matches")).alias("found"))
    return texts.select("key").join(merged, "key", "left").select("key", F.coalesce("found", none).alias("found"))


def _texts_found(df: DataFrame, terms: DataFrame, key: str, text_col: str, part_terms: int) -> DataFrame:
    """``key, found`` of every row: per label with a match all its matches."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    listed = terms.select("label", "term", F.col("ord").cast("long").alias("ord")).where("term IS NOT NULL AND label IS NOT NULL")
    if listed.count() > part_terms:
        return _found_by_join(rows, listed)
    automaton = spark.sparkContext.broadcast(Automaton(tuple(r) for r in listed.collect()))
    schema = f"key {df.schema[key].dataType.simpleString()}, found {FOUND}"
    return rows.mapInArrow(_scan(automaton), schema)


def lexicon_counts(df: DataFrame, terms: DataFrame, key: str, text_col: str, part_terms: int = PART_TERMS) -> DataFrame:
    """``key, label, hits`` of every text and every label with a hit in it.

    ``terms`` has the columns ``label, term, ord``. Counts equal those of the pattern of a label's
    terms in the order of ``ord``: whole words, any case, leftmost first, no overlaps. ``key`` is
    unique; null texts and terms hold nothing. Up to ``part_terms`` terms one scan tells
    all without a shuffle; beyond, texts ask a table of terms for their windows, block by block.
    """
    found = _texts_found(df, terms, key, text_col, part_terms)
    flat = found.select(F.col("key").alias(key), F.explode("found").alias("f"))
    return flat.select(key, "f.label", _counted(F.col("f.matches")).alias("hits"))


def label_reviews_by_table(
    df: DataFrame,
    lexicon: DataFrame,
    key: str = "review_id",
    text_col: str = "clean_text",
    rating_col: str | None = "rating",
    part_terms: int = PART_TERMS,
) -> DataFrame:
    """Labels of every review from a lexicon table of any size; see :func:`~sentika.functions.labels.label_reviews`.

    Returns the key with ``aspects`` (in the order of their first term), ``aspect_count``,
    ``sentiment_rule``, ``matched_keywords`` and ``is_multilabel``. The number of aspects is that of
    a report; their terms may be many.
    """
    kinds = lexicon.where("kind IN ('aspect', 'polarity')")
    terms = kinds.select(F.concat_ws(":", "kind", "label").alias("label"), "term", "ord")
    path = scratch_path(df.sparkSession, "texts-to-label")
    df.select(*dict.fromkeys([key, text_col, *([rating_col] if rating_col else [])])).write.parquet(path)  # texts are computed once
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    found = _texts_found(df, terms, key, text_col, part_terms)
    names = lexicon.where("kind = 'aspect'").groupBy("label").agg(F.min("ord").alias("first")).orderBy("first").collect()
    hits = F.map_from_arrays(F.transform("found", lambda f: f["label"]), F.transform("found", lambda f: _counted(f["matches"])))
    if rating_col:
        found = found.join(df.select(F.col(key).alias("key"), F.col(rating_col).alias("rating")), "key")
    counted = found.withColumn("hits", hits)
    of = lambda name: F.coalesce(F.element_at("hits", F.lit(name)), F.lit(0).cast("long"))
    aspects = F.array_compact(F.array(*[F.when(of(f"aspect:{r.label}") > 0, F.lit(r.label)) for r in names]))
    keywords = F.map_filter(
        F.create_map(*[x for r in names for x in (F.lit(r.label), of(f"aspect:{r.label}"))]), lambda _, n: n > 0
    )
    rating = F.col("rating") if rating_col else None
    return counted.select(
        F.col("key").alias(key),
        F.when(F.size(aspects) > 0, aspects).otherwise(F.array(F.lit(GENERAL))).alias("aspects"),
        F.greatest(F.size(aspects), F.lit(1)).alias("aspect_count"),
        detect_sentiment(of("polarity:positive"), of("polarity:negative"), rating).alias("sentiment_rule"),
        keywords.alias("matched_keywords"),
        (F.size(aspects) > 1).alias("is_multilabel"),
    )

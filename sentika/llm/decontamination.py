"""Benchmark decontamination by word n-grams.

The benchmark's windows of ``n`` normalised words are hashed into a set that every task holds.
Texts are scanned window by window; a hit of the hash is confirmed word by word, so no clean
document is flagged. Only words of the benchmark can be part of a window: all others are mapped
to one code, which rules out most windows before any hash is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentika.llm.common import ALNUM_LOWER, blocks_of, mix64, text_bytes

N = 10
#: Benchmark text held by a task at a time; a larger benchmark is scanned in several passes.
MAX_SET_BYTES = 8 << 20
SCAN_BYTES = 4 << 20
HITS = "id long, text string, n_words long, starts array<long>, ends array<long>, items array<long>"


def words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, with A-Z in lower case."""
    return text.translate(ALNUM_LOWER).split()


class WindowSet:
    """Windows of some benchmark items: by length, sorted hashes with their words and items.

    Takes about 64 bytes a window, and so about ten times the benchmark's text.
    """

    def __init__(self, n: int = N):
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self._codes: list[np.ndarray] = []
        #: length -> (hashes in order, words of each window, position of its item in ``ids``)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, item: int | None, text: bytes) -> None:
        codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
        if codes:
            self.ids.append(item)
            self._codes.append(np.array(codes, np.uint32))

    def seal(self) -> WindowSet:
        grids: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, codes in enumerate(self._codes):
            size = min(self.n, len(codes))
            grids.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(codes, size), k))
        for size, parts in grids.items():
            grid = np.concatenate([g for g, _ in parts])
            owner = np.repeat(np.array([k for _, k in parts]), [len(g) for g, _ in parts])
            hashes = _rolled(grid.T)
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], grid[order], owner[order]
        self._codes = []
        return self

    def scan(self, codes: np.ndarray, size: int) -> Iterator[tuple[int, list[int | None]]]:
        """Start and items of every window of ``size`` codes; code 0 is no benchmark word."""
        if len(codes) < size:
            return
        known = np.concatenate([[0], np.cumsum(codes != 0)])
        starts = np.flatnonzero(known[size:] - known[:-size] == size)
        if not len(starts):
            return
        hashes, grid, owner = self.windows[size]
        own = _rolled([codes[starts + k] for k in range(size)])
        low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        for k in np.flatnonzero(high > low).tolist():
            s, a, b = int(starts[k]), low[k], high[k]
            same = (grid[a:b] == codes[s : s + size]).all(axis=1)
            if same.any():
                yield s, [self.ids[i] for i in owner[a:b][same].tolist()]

    def find(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
        """Merged spans of hit words, and the ids of the items found."""
        spans: list[tuple[int, int]] = []
        items: set[int | None] = set()
        if self.windows:
            code_of = self.vocabulary.get
            codes = np.fromiter((code_of(w, 0) for w in tokens), np.uint32, len(tokens))
            for size in self.windows:
                for s, owners in self.scan(codes, size):
                    items.update(owners)
                    spans.append((s, s + size))
        return merge(spans), sorted(i for i in items if i is not None)


def _rolled(columns) -> np.ndarray:
    total = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += np.asarray(c, np.uint64)
    return mix64(total)


def window_sets(items: DataFrame, n: int, id_col: str, text_col: str, max_bytes: int) -> Iterator[WindowSet]:
    """The benchmark as window sets of at most ``max_bytes`` of text (or one item) each.

    Items stream to the driver partition by partition; one set is held at a time by a task.
    Rows without words have no windows.
    """
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    current, size = WindowSet(n), 0
    for r in rows.toLocalIterator():
        data = r.text.encode("utf-8", "surrogatepass")
        if size and size + len(data) > max_bytes:
            yield current.seal()
            current, size = WindowSet(n), 0
        current.add(r.id, data)
        size += len(data)
    yield current.seal()


def _scanner(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: WindowSet = shared.value
        for batch, texts in blocks_of(batches, "text", SCAN_BYTES):
            out: tuple[list, ...] = [], [], [], []
            for text in texts:
                tokens = words(text)
                spans, items = held.find(tokens)
                for column, value in zip(out, (len(tokens), [s for s, _ in spans], [e for _, e in spans], items), strict=True):
                    column.append(value)
            yield pa.record_batch(
                {
                    "id": batch.column(0),
                    "text": batch.column(1) if keep_text else pa.nulls(len(batch), pa.string()),
                    "n_words": pa.array(out[0], pa.int64()),
                    **{k: pa.array(v, pa.list_(pa.int64())) for k, v in zip(("starts", "ends", "items"), out[1:], strict=True)},
                }
            )

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = N,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    max_set_bytes: int = MAX_SET_BYTES,
    keep_text: bool = False,
) -> DataFrame:
    """One row for each document: words, hit words, spans of hit words and the items found.

    Columns: the id, ``n_words``, ``n_hit``, ``spans`` (structs of first and past-the-end word),
    ``items`` (ids, ascending) and, if asked for, the text. A null text has no words. An item
    without an id hits words but is not listed. An empty benchmark hits nothing. Repeated rows
    and null ids stay rows of their own; other columns are not read.

    A benchmark above ``max_set_bytes`` is scanned in passes, and the passes of a document are
    merged by id and text hash; repeated rows of the same id and text are then numbered apart.
    """
    sc = docs.sparkSession.sparkContext
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = [sc.broadcast(s) for s in window_sets(benchmark, n, item_id_col, item_text_col, max_set_bytes)]
    passes = [narrow.mapInArrow(_scanner(s, keep_text or len(sets) > 1), HITS) for s in sets]
    if len(passes) == 1:
        found = passes[0]
    else:
        found = _merged(passes)
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    out = found.select(
        F.col("id").alias(id_col),
        "n_words",
        F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        spans.alias("spans"),
        "items",
        *([F.col("text").alias(text_col)] if keep_text else []),
    )
    return out


def _merged(passes: list[DataFrame]) -> DataFrame:
    """Union of the passes of each row; equal rows give equal finds, so they are grouped and counted."""
    every = passes[0].withColumn("first", F.lit(1))
    for p in passes[1:]:
        every = every.unionByName(p.withColumn("first", F.lit(0)))
    grouped = every.groupBy("id", "text", "n_words").agg(
        F.sum("first").cast("int").alias("rows"),
        F.collect_set(F.when(F.size("starts") > 0, F.arrays_zip("starts", "ends"))).alias("spans"),
        F.collect_set(F.when(F.size("items") > 0, F.col("items"))).alias("lists"),
    )
    joined = F.udf(_join_spans, "struct<starts:array<bigint>,ends:array<bigint>>")
    return grouped.select(
        "id", "text", "n_words", joined(F.flatten("spans")).alias("s"),
        F.array_sort(F.array_distinct(F.flatten("lists"))).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("rows"))),
    ).select("id", "text", "n_words", "s.starts", "s.ends", "items")


def _join_spans(spans):
    merged = merge([(s["starts"], s["ends"]) for s in spans])
    return [s for s, _ in merged], [e for _, e in merged]


def items_digest(items: str = "items"):
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",").cast("binary"), 256)


def remove_spans(texts: list[bytes], spans: list[list[tuple[int, int]]]) -> list[bytes]:
    """Texts without the bytes from the first to the last hit word of each span."""
    out = []
    for text, own in zip(texts, spans, strict=True):
        flat, pos, at = text.translate(ALNUM_LOWER), 0, []
        for w in flat.split():
            pos = flat.index(w, pos)
            at.append((pos, pos + len(w)))
            pos += len(w)
        kept, last = [], 0
        for s, e in own:
            kept.append(text[last : at[s][0]])
            last = at[e - 1][1]
        out.append(b"".join([*kept, text[last:]]))
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "documents",
    n: int = N,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
) -> DataFrame:
    """Documents without hit ones, or with the hit spans cut out of their texts (``remove="spans"``).

    All columns stay. Clean rows are returned unchanged, null texts too. A benchmark of several
    passes cuts pass by pass.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    sets = [docs.sparkSession.sparkContext.broadcast(s) for s in window_sets(benchmark, n, item_id_col, item_text_col, MAX_SET_BYTES)]

    def cleaner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: WindowSet = shared.value
            code_of = held.vocabulary.get
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                texts = text_bytes(batch.column(at))
                found = [held.find(words(text))[0] for text in texts]
                if remove == "documents":
                    yield batch.filter(pa.array([not f for f in found], pa.bool_()))
                elif any(found):
                    new = [b.decode("utf-8") if f else None for b, f in zip(remove_spans(texts, found), found, strict=True)]
                    hit = pa.array([bool(f) for f in found], pa.bool_())
                    text = pc.if_else(hit, pa.array(new, pa.string()), batch.column(at))
                    yield batch.set_column(at, batch.schema.field(at), text)
                else:
                    yield batch

        return run

    for s in sets:
        docs = docs.mapInArrow(cleaner(s), docs.schema)
    return docs


def sha256_of(items: list[int]) -> str:
    """The digest of ``items_digest`` in plain Python, for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()

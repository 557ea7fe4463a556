"""Removal of long byte strings that occur more than once, by two-stage suffix sorting.

Every string of ``LENGTH`` bytes is filed under an anchor: the piece of 32 bytes within it that
has the smallest hash. Equal strings have equal anchors at equal places, so they meet in one
bucket, and a bucket whose anchor occurs once is dropped. The strings of one anchor occurrence
start in one run and form a context of bytes. Contexts that are equal as a whole are repeated as
a whole, and those of one text that touch are one row; only the different contexts of an anchor
have their suffixes sorted:

* suffixes smaller than their successors are sorted directly,
* the order of all others is induced from them by one scan of the buckets of first bytes,
* neighbours in that order with a common prefix of ``LENGTH`` bytes are repeated strings.

An anchor with more than ``MAX_CONTEXTS`` different contexts is not sorted in one task. Its
strings are filed again, ``RANGE`` neighbouring starts together, by all the bytes that these have
in common; equal strings still meet, and hardly any others do. Should more than ``MAX_REFINED``
different contexts meet even there, hashes of their strings are counted, which finds the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentika.llm.common import blocks_of, mix64, text_bytes, written

LENGTH = 400
GRAM = 32
#: Bytes of contexts that are sorted together.
SORT_BYTES = 512 << 10
#: Contexts of a bucket that are sorted at once: about 40 kB of sort keys each, so 40 MB.
MAX_CONTEXTS = 1000
#: Starts filed together under the bytes common to their strings, and the contexts sorted then: 7 kB each.
RANGE, MAX_REFINED = 32, 10_000
#: Starts handled at once in a very long text.
PIECE = (1 << 20) - 4096
ANCHORS = "id long, text_key long, key long, context long, lo int, hi int, end int, copies int"
REFINED = "key long, context long, id long, text_key long, lo int, hi int, part binary"
SPANS = "id long, text_key long, start int, end int"


def packed_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one integer (the first byte lowest)."""
    w = data.astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | (w[k:] << np.uint64(8 * k))
    return w


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from every position on."""
    w = packed_words(data)
    n = len(data) - GRAM + 1
    total = w[:n].copy()
    for k in range(8, GRAM, 8):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        total += w[k : k + n]
    return mix64(total)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    grid = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    grid[:n] = values
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(text: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """``(hash of the anchor, first start, last start)`` of each run of strings with one anchor."""
    whole = np.frombuffer(text, np.uint8)
    low = np.uint64((1 << 20) - 1)
    for base in range(0, len(whole) - length + 1, PIECE):
        data = whole[base : base + PIECE + length - 1]
        hashes = gram_hashes(data)
        # the leftmost of equal hashes wins: the place stands in the lowest bits
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        at = (window_minima(ranked, length - GRAM + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        last = np.append(first[1:], len(at)) - 1
        yield from zip(hashes[at[first]].view(np.int64).tolist(), (first + base).tolist(), (last + base).tolist(), strict=True)


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks_of(batches, "text", 2 << 20):
            which, columns = [], ([], [], [], [], [], [])
            ends, copies = columns[4:]
            for i, text in enumerate(texts):
                if len(text) < length:
                    continue
                view = memoryview(text)
                last: dict[tuple[int, int], int] = {}
                for key, lo, hi in anchor_runs(text, length):
                    context = xxhash.xxh3_64_intdigest(view[lo : hi + length])
                    at = last.get((key, context), -1)
                    if at >= 0 and lo <= ends[at]:  # a line that is repeated many times in a row
                        ends[at] = hi + length
                        copies[at] += 1
                        continue
                    last[key, context] = len(which)
                    which.append(i)
                    for column, value in zip(columns, (key, context, lo, hi, hi + length, 1), strict=True):
                        column.append(value)
            rows = pa.array(which, pa.int32())
            yield pa.record_batch(
                {
                    "id": batch.column(0).take(rows),
                    "text_key": batch.column(1).take(rows),
                    "key": pa.array(columns[0], pa.int64()),
                    "context": pa.array(np.array(columns[1], np.uint64).view(np.int64)),
                    "lo": pa.array(columns[2], pa.int32()),
                    "hi": pa.array(columns[3], pa.int32()),
                    "end": pa.array(ends, pa.int32()),
                    "copies": pa.array(copies, pa.int32()),
                }
            )

    return run


def suffix_order(parts: list[bytes], starts: list[int], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two-stage suffix array of the first ``starts[i]`` suffixes of each part.

    Returns their positions in suffix order, and the parts' bytes in a row with a separator after
    each. A part ends in a separator below every byte. Suffixes are put in order to ``depth``
    bytes at least. Sorted as well, though not returned, are the few suffixes behind a part's last
    start that the induction begins from.
    """
    sizes = np.array([len(p) for p in parts])
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    joined = b"\0".join(parts) + b"\0"
    data = np.frombuffer(joined, np.uint8).astype(np.int16)
    ends = base + sizes
    data[ends] = -1
    n = len(data)

    # a suffix is smaller than its successor if the next different byte is larger
    step = np.sign(np.diff(data, append=-1))
    differs = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(differs[::-1])[::-1]
    smaller = step[following] > 0
    smaller[ends] = False
    stop = smaller.copy()
    stop[ends] = True
    next_stop = np.minimum.accumulate(np.where(stop, np.arange(n), n - 1)[::-1])[::-1]

    counts = np.array(starts)
    until = next_stop[base + counts - 1]
    wanted = np.zeros(n + 1, np.int32)
    np.add.at(wanted, base, 1)
    np.add.at(wanted, until + 1, -1)
    wanted = np.cumsum(wanted[:-1]) > 0

    # first stage: sort the suffixes smaller than their successors
    direct = np.flatnonzero(wanted & smaller)
    last = np.repeat(ends, sizes + 1)[direct]
    text = joined.decode("latin-1")
    keys = [text[p:e] for p, e in zip(direct.tolist(), np.minimum(last, direct + depth + GRAM).tolist(), strict=True)]
    direct = direct[np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if len(keys) else direct
    del keys
    split = np.searchsorted(data[direct], np.arange(257))

    # second stage: induce the others, which precede a suffix that is already placed
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def place(scanned: np.ndarray, above: int) -> None:
        before = scanned[scanned > 0] - 1
        before = before[wanted[before] & (data[before] > above)]
        if not len(before):
            return
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts):
            induced[data[part[0]]].append(part)

    place(ends[wanted[ends]], -1)
    out = []
    for c in range(256):
        own = current = np.concatenate(induced[c]) if induced[c] else direct[:0]
        runs = [own]
        while len(current):  # a run of one byte: each induces the one before it
            before = current[current > 0] - 1
            current = before[wanted[before] & (data[before] == c)]
            runs.append(current)
        scanned = np.concatenate([*runs, direct[split[c] : split[c + 1]]])
        if len(scanned):
            place(scanned, c)
            out.append(scanned)
    order = np.concatenate(out) if out else direct
    is_start = np.zeros(n, bool)
    for b, k in zip(base.tolist(), counts.tolist(), strict=True):
        is_start[b : b + k] = True
    return order[is_start[order]], np.frombuffer(joined, np.uint8)


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order, up to ``cap``.

    Every suffix must have ``cap`` bytes, a multiple of eight; the first has 0.
    """
    out = np.zeros(len(order), np.int64)
    words = packed_words(np.concatenate([data, np.zeros(8, np.uint8)]))
    alive = np.arange(1, len(order))
    for at in range(0, cap, 8):
        change = words[order[alive] + at] ^ words[order[alive - 1] + at]
        equal = change == 0
        ended = change[~equal]
        lowest = np.frexp((ended & (~ended + np.uint64(1))).astype(np.float64))[1] - 1
        out[alive[~equal]] = at + lowest // 8
        alive = alive[equal]
        if not len(alive):
            break
    out[alive] = cap
    return out


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, the starts of strings of ``length`` bytes that start elsewhere too, in any part."""
    starts = [len(p) - length + 1 for p in parts]
    order, data = suffix_order(parts, starts, length)
    twin = common_prefixes(data, order, length) >= length
    twin[:-1] |= twin[1:]
    found = np.sort(order[twin])
    base = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    cut = np.searchsorted(found, base)
    return [found[cut[i] : cut[i + 1]] - base[i] for i in range(len(parts))]


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered runs of bytes; runs that touch are one."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    first, last = starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])]
    return list(zip(first.tolist(), (last + length).tolist(), strict=True))


def _sorted_buckets(length: int):
    """Spans found among contexts that arrive in the order of their anchors."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[4] for r in rows], length)
        out = [
            (r[1], r[2], r[3] + s, r[3] + e) for r, starts in zip(rows, found, strict=True) for s, e in _spans(starts, length)
        ]
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32()
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        return pa.record_batch({n: pa.array(list(v), k) for n, v, k in zip(("id", "text_key", "start", "end"), columns, kinds, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        bucket: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if bucket and row[0] != bucket[0][0]:
                    rows += bucket
                    bucket = []
                    if held >= SORT_BYTES:
                        yield solve(rows)
                        rows, held = [], 0
                bucket.append(row)
                held += len(row[4])
        rows += bucket
        if rows:
            yield solve(rows)

    return run


def refined_runs(part: bytes, key: int, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """``(key, first start, last start)`` of each range of starts in a context of the anchor ``key``.

    Ranges are measured from the anchor, so that equal strings are in ranges of one number.
    """
    hashes = gram_hashes(np.frombuffer(part, np.uint8))[: length - GRAM + 1].view(np.int64)
    anchor = int(np.flatnonzero(hashes == key)[0])
    last = len(part) - length
    for k in range((anchor - last) // RANGE, anchor // RANGE + 1):
        common = part[anchor - RANGE * k : anchor - RANGE * k + length - RANGE + 1]
        digest = xxhash.xxh3_64_intdigest(common, seed=(key + k) & (1 << 64) - 1)
        yield digest - (1 << 63), max(0, anchor - RANGE * k - RANGE + 1), min(last, anchor - RANGE * k)


def _refined(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, doc, text_key, lo, part in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                for own, first, last in refined_runs(part, key, length):
                    piece = part[first : last + length]
                    rows.append((own, xxhash.xxh3_64_intdigest(piece) - (1 << 63), doc, text_key, lo + first, lo + last, piece))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary()]
            names = [f.split()[0] for f in REFINED.split(", ")]
            yield pa.record_batch({n: pa.array(list(c), k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return run


def _string_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                view = memoryview(row[4])
                n = len(view) - length + 1
                digests = b"".join(xxhash.xxh3_128_digest(view[i : i + length]) for i in range(n))
                pairs = np.frombuffer(digests, np.int64).reshape(-1, 2)
                yield pa.record_batch(
                    {
                        "id": pa.array([row[1]] * n, pa.int64()),
                        "text_key": pa.array([row[2]] * n, pa.int64()),
                        "start": pa.array(np.arange(row[3], row[3] + n, dtype=np.int32)),
                        "h1": pa.array(pairs[:, 0]),
                        "h2": pa.array(pairs[:, 1]),
                    }
                )

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, text_key, start, end`` of byte spans covered by repeated strings; spans may overlap.

    Rows that repeat an id and a text share all their spans (and repeat each other).
    """
    if length < GRAM + 8 or length % 8:
        raise ValueError("length is a multiple of 8 from 40 on")
    keyed = _keyed(docs, id_col, text_col)
    anchors = written(keyed.mapInArrow(_anchors(length), ANCHORS), "anchors")
    # written, so that the join below has plain shuffles on both sides and a hot anchor can be split
    shared = written(anchors.groupBy("key").agg(F.sum("copies").alias("n")).where("n > 1").select("key"), "shared-keys")
    runs = written(anchors.join(shared, "key"), "shared-anchors")
    contexts = runs.groupBy("key", "context").agg(
        F.sum("copies").alias("copies"), F.min(F.struct("id", "text_key", "lo", "hi")).alias("one")
    )
    contexts = written(contexts, "contexts")
    whole = runs.join(contexts.where("copies > 1").select("key", "context"), ["key", "context"]).select(
        "id", "text_key", F.col("lo").alias("start"), "end"
    )
    several = contexts.groupBy("key").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    open_ = contexts.join(several, "key").select("key", "different", "one.*")
    same = F.expr("d.id <=> o.id AND d.text_key = o.text_key")
    once = open_.groupBy("id", "text_key").agg(F.collect_list(F.struct("key", "different", "lo", "hi")).alias("cuts"))
    # the contexts of one text are cut out together, and of one of its rows only
    cut = (
        keyed.alias("d").join(once.alias("o"), same)
        .select("o.id", "o.text_key", F.col("d.text").cast("binary").alias("bytes"), F.explode("o.cuts").alias("c"))
        .select("c.key", "c.different", "id", "text_key", "c.lo", F.expr(f"substring(bytes, c.lo + 1, c.hi - c.lo + {length})").alias("part"))
    )
    cut = written(cut, "open-contexts")
    columns = "key", "id", "text_key", "lo", "part"
    small = cut.where(F.col("different") <= MAX_CONTEXTS).select(*columns)
    fine = written(cut.where(F.col("different") > MAX_CONTEXTS).select(*columns).mapInArrow(_refined(length), REFINED), "refined")
    groups = fine.groupBy("key", "context").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "text_key", "lo", "part")).alias("one")
    )
    groups = written(groups, "refined-contexts")
    again = fine.join(groups.where("copies > 1").select("key", "context"), ["key", "context"]).select(
        "id", "text_key", F.col("lo").alias("start"), (F.col("hi") + length).alias("end")
    )
    several = groups.groupBy("key").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    left = groups.join(several, "key").select("different", "key", "one.*")
    small = small.unionByName(left.where(F.col("different") <= MAX_REFINED).select(*columns))
    in_order = small.repartition("key").sortWithinPartitions("key", "id", "text_key", "lo")
    hashed = left.where(F.col("different") > MAX_REFINED).select(*columns).mapInArrow(
        _string_hashes(length), "id long, text_key long, start int, h1 long, h2 long"
    )
    twice = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    counted = hashed.join(twice, ["h1", "h2"]).select("id", "text_key", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(again).unionByName(in_order.mapInArrow(_sorted_buckets(length), SPANS)).unionByName(counted)


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = text_bytes(batch.column(1))
        spans, kept = [], []
        for text, found in zip(texts, batch.column(2).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in found or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            edges = [0, *[x for s in merged for x in s], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"start": s, "end": e} for s, e in merged])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.record_batch(
            {
                "id": batch.column(0),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "spans": pa.array(spans, kind),
                "kept": pa.array(kept, pa.binary()),
            }
        )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each input row: the id, ``n_bytes``, removed ``spans`` and the ``kept`` bytes.

    Removes every byte covered by a string of ``length`` bytes that starts anywhere else too, in
    the same text or another; strings do not cross texts, and are judged on the input. Null texts
    are empty; null and repeated ids stay rows of their own; other columns are not read. Kept
    bytes are bytes: a span may begin or end within a character.
    """
    found = repeated_spans(docs, id_col, text_col, length)
    listed = found.groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    same = F.expr("d.id <=> s.id AND d.text_key = s.text_key")
    joined = _keyed(docs, id_col, text_col).alias("d").join(listed.alias("s"), same, "left").select("d.id", "d.text", "s.spans")
    spans = "array<struct<start:int,end:int>>"
    return joined.mapInArrow(_cutter, f"id long, n_bytes long, spans {spans}, kept binary").withColumnRenamed("id", id_col)

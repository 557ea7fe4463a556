"""Exact token counts that encode every distinct pre-token once.

A byte-pair tokenizer never merges across pre-tokens, so the length of a text is the sum over
its pre-tokens of the pieces of each. Texts are reduced to pre-token frequencies block by
block; the pre-tokens of all blocks meet by value, each is encoded once, and its number of
pieces goes back to the blocks that hold it. Ids are never kept.

A block is a bounded run of documents: its distinct pre-tokens are listed once and each
document refers to them by position, which keeps what is shuffled near the size of the
vocabulary instead of the size of the text.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentika.llm.common import blocks_of, written

#: Text of a block; one longer document makes a block of its own.
BLOCK_BYTES = 16 << 20
#: The pre-token pattern of the byte-level family (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters below this code point are classed alike by the pattern and by the library (tested);
#: texts with others are cut by the library itself.
AGREED = 0x250
_BEYOND = re.compile(f"[^\0-{chr(AGREED - 1)}]")
BLOCKS = "block long, ids array<long>, n_bytes array<long>, tokens array<string>, lengths binary, refs binary, times binary"


@lru_cache(maxsize=2)
def _library(path: str):
    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    pre = conf["pre_tokenizer"]
    if conf["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or conf["model"].get("dropout"):
        raise ValueError("only byte-level tokenizers without a normalizer are supported")
    tokens = [t for t in conf["added_tokens"]]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in tokens):
        raise ValueError("added tokens that take in their surroundings are not supported")
    special = sorted((t["content"] for t in tokens), key=len, reverse=True)
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    return Tokenizer.from_file(path), regex.compile(PATTERN), cut, frozenset(special)


def pretokens(path: str) -> Callable[[str], list[str]]:
    """Cutter of a text into its pre-tokens; special strings in the text are pre-tokens of their own."""
    library, pattern, cut, special = _library(path)

    def plain(text: str) -> list[str]:
        if _BEYOND.search(text) is None:
            return pattern.findall(text)
        return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]

    def cutter(text: str) -> list[str]:
        if cut is None or (parts := cut.split(text)) == [text]:
            return plain(text)
        return list(chain.from_iterable([p] if p in special else plain(p) for p in parts if p))

    return cutter


def pieces(path: str) -> Callable[[list[str]], list[int]]:
    """Number of pieces of each pre-token, as the library encodes it."""
    library = _library(path)[0]
    return lambda words: [len(e.ids) for e in library.encode_batch_fast(words, add_special_tokens=False)]


def _gathered(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of several batches together, up to about ``max_bytes`` of text."""
    ids: list = []
    held: list[bytes] = []
    size = 0
    for batch, texts in blocks_of(batches, "text", max_bytes):
        own = sum(map(len, texts))
        if held and size + own > max_bytes:
            yield ids, held
            ids, held, size = [], [], 0
        ids += batch.column(0).to_pylist()
        held += texts
        size += own
    if held:
        yield ids, held


def _blocks(path: str, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pretokens(path)
        for ids, texts in _gathered(batches, max_bytes):
            at: dict[str, int] = {}
            lengths, refs, times = [], [], []
            for b in texts:
                counts = Counter(cutter(b.decode("utf-8", "replace")))
                lengths.append(len(counts))
                new = [w for w in counts if w not in at]
                at.update(zip(new, range(len(at), len(at) + len(new)), strict=True))
                own = np.fromiter(map(at.__getitem__, counts), np.int32, len(counts))
                order = np.argsort(own)
                refs.append(np.diff(own[order], prepend=np.int32(0)))
                times.append(np.fromiter(counts.values(), np.int32, len(counts))[order])
            flat = [np.concatenate(x).astype(np.int32) for x in ([np.array(lengths)], refs, times)]
            yield pa.record_batch(
                {
                    "block": pa.array([uuid.uuid4().int >> 65], pa.int64()),  # files hold one attempt's number
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "n_bytes": pa.array([[len(b) for b in texts]], pa.list_(pa.int64())),
                    "tokens": pa.array([list(at)], pa.list_(pa.string())),
                    **{k: pa.array([_packed(v)], pa.binary()) for k, v in zip(("lengths", "refs", "times"), flat, strict=True)},
                }
            )

    return run


def _packed(values: np.ndarray) -> bytes:
    """Number of bytes a value needs, then all lowest bytes, all second bytes and so on.

    High bytes are mostly zero, so that each kind by itself compresses well.
    """
    split = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    width = max(1, 4 - int(np.argmax([*split[:, ::-1].any(axis=0), True])))
    return bytes([width]) + split[:, :width].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u4").ravel().astype(np.int64)


def _encode_once(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = pieces(path), ("", 0)
        for batch in batches:
            runs = pc.run_end_encode(batch.column(2))
            words = runs.values.to_pylist()
            if words and words[0] == last[0]:
                n = [last[1], *count(words[1:])]
            else:
                n = count(words)
            if words:
                last = words[-1], n[-1]
            each = np.repeat(np.array(n, np.int64), np.diff(np.array(runs.run_ends), prepend=0))
            block, at = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            code = np.asarray(block.indices)
            order = np.lexsort((at, code))
            ends = np.cumsum(np.bincount(code, minlength=len(block.dictionary)))
            parts = np.split(order, ends[:-1])
            yield pa.record_batch(
                {
                    "block": block.dictionary,
                    "at": pa.array([_packed(np.diff(at[p], prepend=0)) for p in parts], pa.binary()),
                    "pieces": pa.array([_packed(each[p]) for p in parts], pa.binary()),
                }
            )

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            size = np.zeros(r["n_tokens"], np.int64)
            for part in r["parts"] or ():
                size[np.cumsum(_unpacked(part["at"]))] = _unpacked(part["pieces"])
            lengths, refs, times = (_unpacked(r[k]) for k in ("lengths", "refs", "times"))
            ends = np.cumsum(lengths)
            if len(refs):
                # references are differences within a document: take off the running sum at its start
                run = np.cumsum(refs)
                base = np.concatenate([[0], run])[ends - lengths]
                total = np.concatenate([[0], np.cumsum(size[run - np.repeat(base, lengths)] * times)])
                tokens = total[ends] - total[ends - lengths]
            else:
                tokens = np.zeros(len(lengths), np.int64)
            yield pa.record_batch(
                {"id": pa.array(r["ids"], pa.int64()), "n_bytes": pa.array(r["n_bytes"], pa.int64()), "n_tokens": pa.array(tokens)}
            )


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each input row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``).

    A null or empty text has no bytes and no tokens; repeated rows and null ids stay rows of
    their own; other columns are not read; an empty table gives no rows. Special strings inside
    a text count as the library's default has it, as one token.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = written(narrow.mapInArrow(_blocks(tokenizer_path, block_bytes), BLOCKS), "token-blocks")
    listed = blocks.select("block", F.posexplode("tokens").alias("at", "token"))
    sized = (
        listed.repartition("token")
        .sortWithinPartitions("token")
        .mapInArrow(_encode_once(tokenizer_path), "block long, at binary, pieces binary")
    )
    # one list for each block, as long as the block's own vocabulary
    back = sized.groupBy("block").agg(F.collect_list(F.struct("at", "pieces")).alias("parts"))
    joined = blocks.withColumn("n_tokens", F.size("tokens")).drop("tokens").join(back, "block", "left")
    counts = joined.mapInArrow(_sums, "id long, n_bytes long, n_tokens long")
    return counts.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

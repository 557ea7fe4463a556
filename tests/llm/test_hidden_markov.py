"""The language model against plain recursions, enumeration and counted words."""

from __future__ import annotations

import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sentika.llm import catalog
from sentika.llm import hidden_markov as H


def some_tables(states=3, classes=6, seed=5):
    rnd = np.random.default_rng(seed)
    part = lambda *shape: (x := rnd.random(shape) + 0.05) / x.sum(axis=-1, keepdims=True)

    class Small(H.Tables):
        @property
        def classes(self):
            return classes

    return Small({}, part(states), part(states, states), part(states, classes))


def by_paths(tables, text):
    """Probability of a text and expected counts, over all paths of states."""
    states = len(tables.start)
    start, moves, counts = np.zeros(states), np.zeros((states, states)), np.zeros(tables.emissions.shape)
    total = 0.0
    for path in itertools.product(range(states), repeat=len(text)):
        p = tables.start[path[0]]
        for k, c in enumerate(text):
            p *= tables.emissions[path[k], c] * (tables.moves[path[k - 1], path[k]] if k else 1.0)
        total += p
        start[path[0]] += p
        for k, c in enumerate(text):
            counts[path[k], c] += p
            if k:
                moves[path[k - 1], path[k]] += p
    return total, start / total, moves / total, counts / total


@pytest.mark.parametrize("lanes", [1, 2, 7])
def test_expected_counts_equal_enumeration(monkeypatch, lanes):
    monkeypatch.setattr(H, "LANES", lanes)
    tables = some_tables()
    texts = [[0, 1, 2, 3], [5], [4, 4, 1, 0, 2, 5], [3, 5], [1, 1, 1]]
    lengths = np.array([len(t) for t in texts])
    classes = np.array([c for t in texts for c in t])
    start, moves, counts, likelihood = H.expectations(H.Lanes(lengths, lanes), classes, tables)
    expected = [by_paths(tables, t) for t in texts]
    assert likelihood == pytest.approx(sum(math.log10(e[0]) for e in expected))
    for found, k in ((start, 1), (moves, 2), (counts, 3)):
        np.testing.assert_allclose(found, sum(e[k] for e in expected), rtol=1e-9, atol=1e-12)


def test_lanes_hold_every_token_once_in_order():
    lengths = np.array([5, 1, 1, 9, 2, 2, 7, 1])
    for count in (1, 3, 8, 100):
        lanes = H.Lanes(lengths, count)
        assert sorted(lanes.token.tolist()) == list(range(28))
        assert lanes.first.sum() == lanes.last.sum() == 8
        assert set(lanes.token[lanes.first].tolist()) == set((np.cumsum(lengths) - lengths).tolist())


def test_long_texts_do_not_underflow():
    tables = some_tables()
    classes = np.tile(np.arange(6), 20_000)
    _, scale = H.forward(H.Lanes(np.array([len(classes)])), tables.emissions.T[classes], tables.start, tables.moves)
    assert np.isfinite(np.log10(scale)).all() and np.log10(scale).sum() < -50_000


@pytest.fixture(scope="module")
def found(spark):
    return catalog.op11_hidden_markov(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return {r.doc_id: [*(r.text or "").encode().translate(lower).split(), b""] for r in rows}


def test_counts_and_base_score(found, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    total, different = sum(c.values()), len(c)
    assert 5 < sum(held.values()) < len(held) / 4
    for i, t in texts.items():
        r = found.loc[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[i], len(t), total)
        assert r.n_known == sum(c[w] > 0 for w in t)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + different + 1)) for w in t))


def test_model_is_better_than_the_base_on_held_out_texts(found):
    held = found[found.held_out]
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.15


def test_shuffled_words_are_less_likely_to_hold_together(spark, texts):
    """The score depends on the order of words, as the base does not."""
    rows = [(i, b" ".join(t).decode()) for i, t in sorted(texts.items())]
    a, b = rows[0][1].split(), next(t for i, t in rows if i > 0 and t.split()[0] not in rows[0][1]).split()
    mixed = [w for pair in zip(a, b, strict=False) for w in pair]
    apart = [*a[: len(mixed) // 2], *b[: len(mixed) // 2]]
    held = [k for k in range(10**6, 10**6 + 99) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    df = spark.createDataFrame([*rows, (held[0], " ".join(mixed)), (held[1], " ".join(apart))], "doc_id long, text string")
    got = {r.doc_id: r for r in H.score(df).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score != pytest.approx(got[held[1]].score)


def test_rounds_raise_the_likelihood(docs, texts, spark):
    df = spark.createDataFrame([(i, b" ".join(t).decode()) for i, t in texts.items()], "doc_id long, text string")
    corpus = H.Corpus(df, "doc_id", "text", H.FOLDS, H.HELD_OUT)
    tables = H.first_tables(corpus.shares, corpus.frequent)
    seen = []
    for _ in range(4):
        tables, likelihood = corpus.round(tables)
        seen.append(likelihood)
        assert tables.emissions.sum(axis=1) == pytest.approx(1) and tables.moves.sum(axis=1) == pytest.approx(1)
    assert seen == sorted(seen) and seen[-1] > seen[0]


def test_shares_of_a_class_and_one_unknown_word_sum_to_one(docs):
    corpus = H.Corpus(docs, "doc_id", "text", H.FOLDS, H.HELD_OUT)
    words = {bytes(r.word): r.c for r in corpus.counts.collect()}
    assert corpus.tokens.sum() == sum(words.values()) and corpus.words.sum() == len(words)
    tails = Counter()
    for w, k in zip(words, H.class_of(list(words), corpus.frequent), strict=True):
        if H.FREQUENT <= k < H.FREQUENT + H.TAILS:
            tails[k] += words[w] + 1
    for k, n in tails.items():
        assert n == corpus.tokens[k] + corpus.words[k]


def test_edges(docs, empty, spark):
    rows = H.score(docs, rounds=1).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id in (4, 5, 6):
            assert r.n_tokens == 1
        assert r.score < 0 and r.base_score < 0
    same = [r for r in rows if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]
    assert H.score(empty, rounds=1).count() == 0
    # nothing to learn from
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 7 == 2)
    alone = H.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), rounds=1).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score) == (3, 0, 0, 0.0)
    assert math.isfinite(alone.score)


def test_classes_equal_those_word_by_word():
    words = [b"", b"\0", b"\0\0", b"ab", b"abc", b"xabc", "élan".encode(), b"frequent", b"a" * 100]
    frequent = {b"frequent": 0, b"ab": 1}
    want = [
        frequent.get(w, H.FREQUENT + (zlib.crc32(w[-3:]) % H.TAILS if w else H.TAILS)) for w in words
    ]
    assert H.class_of(words, frequent).tolist() == want
    # part of a longer array, as a block of several hands it over
    inner = pa.array([[b"before"], words], pa.list_(pa.binary()))[1].values
    assert H.class_of(inner, frequent).tolist() == want
    assert H.class_of([], {}).tolist() == [] and H.class_of([b"q"], {}).tolist() == [H.FREQUENT + zlib.crc32(b"q") % H.TAILS]


def test_lanes_are_laid_out_without_a_call_for_each_text(monkeypatch):
    calls, arange = [], np.arange
    monkeypatch.setattr(np, "arange", lambda *a, **k: calls.append(1) or arange(*a, **k))
    lanes = H.Lanes(np.full(500, 3), 40)
    assert len(calls) < 20 and sorted(lanes.token.tolist()) == list(range(1500))


def test_words_of_a_block_are_objects_for_a_piece_at_a_time(monkeypatch):
    rnd = np.random.default_rng(3)
    texts = [" ".join(map(str, rnd.integers(0, 5_000, n))) for n in (60_000, 3, 40_000, 0, 90_000, 110_000) * 4]
    texts[5] = None
    batches = lambda: iter([pa.record_batch({"id": pa.array(range(24)), "text": pa.array(texts)})])
    monkeypatch.setattr(H, "PIECE_BYTES", 1 << 18)
    tracemalloc.start()
    (block,) = H._blocks(7, 2)(batches())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * sum(len(t or "") for t in texts)  # an object of 40 bytes a word makes 10 or more
    words = block.column("words")[0].as_py()
    tokens = np.frombuffer(block.column("tokens")[0].as_py(), np.int32).tolist()
    ids, lengths, held = (block.column(c)[0].as_py() for c in ("ids", "lengths", "held"))
    assert lengths == sorted(lengths, reverse=True) and sorted(ids) == list(range(24))
    used = Counter()
    for i, n, out in zip(ids, lengths, held, strict=True):
        own, tokens = tokens[:n], tokens[n:]
        assert [words[k] for k in own] == [*(texts[i] or "").encode().split(), b""]
        assert out == (zlib.crc32(str(i).encode()) % 7 == 2)
        used.update([] if out else own)
    assert not tokens and len(set(words)) == len(words)
    assert block.column("counts")[0].as_py() == [used[k] for k in range(len(words))]

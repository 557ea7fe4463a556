"""Phrase collocations against plain counting."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from sentika.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least=10, top=2000):
    """Reported rows of (lang, text) rows."""
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c if len(p) == 1 else 0
    out = {}
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((10**6 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        inside = [c for (g, q), c in f.items() if g == lang and len(q) == 3 and len(p) == 2 and c >= least and p in (q[:2], q[1:])]
        if any(100 * c >= 50 * a for c in inside):
            continue
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, l, r, score))
    found = []
    for lang, ps in out.items():
        for rank, (_, _, p, a, l, r, score) in enumerate(sorted(ps)[:top], 1):
            found.append((lang, rank, p.decode(), a, l, r, n[lang], score))
    return sorted(found)


def random_rows(seed, n=60):
    rnd = np.random.default_rng(seed)
    vocabulary = ["a", "B", "c", "Äh", "éé", "d.", "e,f", "g\th", "i\nj", "k", "the", "The"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for k in range(n):
        words = rnd.choice(vocabulary, rnd.integers(0, 80), p=weights / weights.sum())
        rows.append((["en", "de", None][k % 3], " ".join(words)))
    return [*rows, ("en", None), (None, ""), ("fr", "...,\n;"), ("en", "x y " * 40), ("en", "same same same " * 30)]


@pytest.mark.parametrize("hot", [1 / 4096, 1 / 16])
@pytest.mark.parametrize("size", [1 << 20, 50])
def test_equals_counting(spark, monkeypatch, hot, size):
    """Whatever is routed by three words, and into however many buckets."""
    monkeypatch.setattr(C, "HOT", hot)
    monkeypatch.setattr(C, "BUCKET_SUFFIXES", size)
    rows = random_rows(int(size + 1 / hot))
    df = spark.createDataFrame(rows, "lang string, text string")
    found = sorted(tuple(r) for r in C.collocations(df).collect())
    assert found == brute_force(rows) and len(found) > 20
    assert sorted(tuple(r) for r in C.collocations(df, least=3, top=7).collect()) == brute_force(rows, 3, 7)


def test_quicksort_counts_equal_partitions():
    rnd = np.random.default_rng(8)
    keys = [rnd.integers(0, m, 3000) for m in (2, 5, 9, 14)]
    weights = rnd.integers(1, 4, 3000)
    expected = Counter()
    for row, w in zip(zip(*keys, strict=True), weights, strict=True):
        for d in range(1, 5):
            expected[row[:d]] += w
    found = {}
    for d, suffix, weight in C.multikey_quicksort(keys, weights, 10):
        for i, w in zip(suffix.tolist(), weight.tolist(), strict=True):
            phrase = tuple(int(k[i]) for k in keys[:d])
            assert phrase not in found
            found[phrase] = w
    assert found == {p: w for p, w in expected.items() if w >= 10}


def test_exact_scores_beyond_64_bits(spark):
    a, l, r = 3 * 10**9, 4 * 10**9 + 1, 3 * 10**9 + 7
    score = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(C._score("l", "r")).first()[0]
    assert score == 10**6 * a * a // (l * r)


def test_edges(docs, empty):
    assert C.collocations(empty).count() == 0
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in C.collocations(docs).collect()) == brute_force(rows)

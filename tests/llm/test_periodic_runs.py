"""Periodic runs against a search of every period at every place."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentika.llm import catalog
from sentika.llm import periodic_runs as P


def brute_force(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q):
                if not any(all(words[i + t] == words[i + t + p] for t in range(n - p)) for p in range(1, q)):
                    found.append((i, n, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def random_text(rnd):
    n, letters = rnd.randint(0, 70), rnd.randint(1, 4)
    words = [b"%d" % rnd.randrange(letters) for _ in range(n)]
    if n and rnd.random() < 0.6:
        s = rnd.randrange(n)
        p = 1 + rnd.randrange(max(1, (n - s) // 3))
        words = [words[i] if i < s else words[s + (i - s) % p] for i in range(n)]
        if rnd.random() < 0.5:
            words[rnd.randrange(n)] = b"x"
    return words


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        texts = [random_text(rnd) for _ in range(rnd.randint(1, 5))] + [[b"end"]]
        for words, (runs, kept) in zip(texts, P._texts_found(texts), strict=True):
            expected = brute_force(words)
            assert [(r["start"], r["length"], r["period"]) for r in runs] == expected
            assert kept == collapsed(words, expected)


def test_successor_equals_a_scan():
    rnd = np.random.default_rng(4)
    values = rnd.permutation(333).astype(np.int32)
    lo = rnd.integers(0, 333, 500)
    hi = np.minimum(333, lo + rnd.integers(0, 90, 500))
    x = rnd.integers(0, 340, 500)
    expected = [min((v for v in values[a:b] if v >= t), default=-1) for a, b, t in zip(lo, hi, x, strict=True)]
    assert P.WaveletTree(values).successor(lo, hi, x).tolist() == expected


def test_rows_and_edges(docs, empty):
    rows = P.periodic_runs(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].n_words == 0 and by_id[4].runs == [] and bytes(by_id[4].collapsed) == b""
    # the long text repeats 397 words about 150 times
    assert [tuple(r) for r in by_id[10].runs] == [(0, 60_000, 397)]
    assert len(bytes(by_id[10].collapsed).split()) == 397
    assert P.periodic_runs(empty).count() == 0


def test_longest_run_prefers_the_first_start_then_the_shortest_period(spark):
    kind = "runs array<struct<start:long,length:long,period:long>>"
    df = spark.createDataFrame([([(9, 8, 2), (3, 8, 2), (3, 8, 1), (0, 6, 1)],), ([],)], kind)
    first, none = df.select(P.longest_run().alias("r"), P.run_digest().alias("d")).collect()
    assert tuple(first.r) == (3, 8, 1) and none.r is None
    assert none.d == hashlib.sha256(b"").hexdigest()


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    short = {k for k, t in texts.items() if len((t or "").split()) < 500}
    assert len(short) > 100
    found = catalog.op13_periodic_runs(spark, sf).where(F.col("doc_id").isin(sorted(short))).collect()
    planted = 0
    for r in found:
        words = (texts[r.doc_id] or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        if words and h % 10 == 0:
            g, n = h // 10, len(words)
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_force(words)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        expected = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.start, r.length, r.period, r.exponent_milli) == expected
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs)).hexdigest()
    assert planted > 5

"""Near duplicates, repeated strings, components and nearest neighbours against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import BASE, ROWS, WORDS, documents
from pyspark.sql import functions as F

from sentika.llm import near_dedup, substring_dedup, vector_search
from sentika.llm.components import connected_components


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _shingles(text):
    words = [w for w in _lower(text or "").replace("\x1c", "x").split() if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _groups(rows):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    lowest = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        lowest[find(k)].append(i)
    named = [min((i for i in lowest[find(k)] if i is not None), default=None) for k in range(len(rows))]
    return Counter((i, len(s), n, i == n) for (i, _), s, n in zip(rows, sets, named, strict=True))


def _chain_rows():
    """A group held together by links of neighbours only, and many near copies beside it."""
    rnd, rows = random.Random(3), []
    text = [f"c{k}" for k in range(80)]
    for i in range(30):
        text = [w if k != (7 * i) % 80 else f"d{i}" for k, w in enumerate(text)]
        rows.append((100 + i, " ".join(text)))
    for i in range(60):
        own = list(WORDS[:80])
        own[rnd.randrange(80)] = f"e{i}"
        rows.append((200 + i, " ".join(own)))
    return rows


def test_near_duplicates_equal_brute_force(spark, docs, empty):
    rows = [*ROWS, *_chain_rows()]
    got = near_dedup.near_duplicates(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == _groups(rows)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_one_row_of_each_group_stays(docs):
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.select("doc_id").collect())
    groups = {n for i, s, n, _ in _groups(ROWS) if s}
    blank = Counter(i for i, t in ROWS if not (t or "").strip())
    assert ids == Counter(groups) + blank


def test_circulant_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 600, dtype=np.uint64)
    for share in (0.5, 0.75, 0.9):
        k = round(600 * share)
        pair = [np.unique(base[:k + (600 - k) // 2]), np.unique(np.concatenate([base[:k], base[k + (600 - k) // 2 :]]))]
        a, b = near_dedup.signatures(pair, 2000)
        assert abs((a == b).mean() - share) < 0.05
    alone = near_dedup.signatures([pair[0]])
    assert (alone[0] == near_dedup.signatures(pair)[0]).all()


def test_components_of_paths_stars_and_loops(spark):
    rnd, links = random.Random(5), []
    nodes = list(range(1, 400))
    rnd.shuffle(nodes)
    links += list(zip(nodes[:150], nodes[1:150], strict=False))
    links += [(nodes[200], n) for n in nodes[201:300]] + [(nodes[201], nodes[202]), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[n] for n in nodes[:150]} == {min(nodes[:150])}
    assert {got[n] for n in nodes[200:300]} == {min(nodes[200:300])}
    assert len(got) == 250
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(b for b, h in zip(d, hit, strict=True) if not h)
        spans = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(d), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _passages():
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("ab cdé") for _ in range(n))
    shared, line = text(300), text(90)
    rows = [(i, text(rnd.randrange(200)) + shared[: rnd.randrange(60, 300)] + text(rnd.randrange(100))) for i in range(40)]
    rows += [(100 + i, text(50) + line + text(50)) for i in range(40)]
    return [*rows, (200, "a" * 500), (201, "a" * 70), (202, "xy" * 200), (203, text(3000)), (204, None), (204, None)]


def test_repeated_strings_equal_brute_force(spark, docs, empty, monkeypatch):
    rows = [*ROWS[:10], *_passages()]
    df = documents(spark, rows)
    want = Counter((i, *x) for (i, _), x in zip(rows, _removed([t for _, t in rows], 64), strict=True))
    # buckets above the first bound are filed again, above the second counted by hashes
    for most, refined in ((1000, 10_000), (2, 10_000), (2, 1)):
        monkeypatch.setattr(substring_dedup, "MAX_CONTEXTS", most)
        monkeypatch.setattr(substring_dedup, "MAX_REFINED", refined)
        got = substring_dedup.without_repeats(df, length=64).collect()
        seen = Counter(
            (r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got
        )
        assert seen == want
    assert substring_dedup.without_repeats(empty).count() == 0


def test_touching_repeats_of_a_text_are_one_row(spark):
    """A line repeated in a row gave a row for each time, all of them under one key."""
    line, other = "Is onhe. ", "and another line, of some more letters than the first one; "
    texts = [line * 100, other + line * 60 + other + line * 60, "x" * 3000, other * 40, (line + other) * 20, other + line * 9]
    batch = pa.record_batch({"id": range(6), "text_key": range(6), "text": texts}, pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("text", pa.string())]))
    rows = pa.Table.from_batches(substring_dedup._anchors(64)(iter([batch]))).to_pylist()
    runs = [len(list(substring_dedup.anchor_runs(t.encode(), 64))) for t in texts]
    for i in (0, 2, 3):
        own = [r for r in rows if r["id"] == i]
        assert runs[i] > 30 and len(own) < 8 and sum(r["copies"] for r in own) == runs[i]
    table = [*enumerate(texts), (9, texts[1]), (9, texts[1])]
    want = Counter((i, *x) for (i, _), x in zip(table, _removed([t for _, t in table], 64), strict=True))
    got = substring_dedup.without_repeats(documents(spark, table), length=64).collect()
    assert want == Counter(
        (r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got
    )


def test_a_shared_passage_counts_by_its_bytes(spark):
    """Sixty words of 399 bytes stay, those of 400 bytes go, whatever the length of the documents."""
    rnd = random.Random(8)
    words = lambda n, size: " ".join("".join(rnd.choice("abcdefgh") for _ in range(size)) for _ in range(n))
    short = words(59, 5) + " " + words(1, 45)  # 399 bytes
    long = words(59, 5) + " " + words(1, 46)
    rows = [(i, "<" + words(20, 4) + "[" + p + "]" + words(30, 3) + ">") for i, p in enumerate((short, short, long, long))]
    # what stands beside the passages differs in its first and last byte
    rows = [(i, t.replace("[", "[({"[i % 2]).replace("]", "])}"[i % 2])) for i, t in rows]
    got = {r.doc_id: [s["end"] - s["start"] for s in r.spans] for r in substring_dedup.without_repeats(documents(spark, rows)).collect()}
    assert len(short) == 399 and got == {0: [], 1: [], 2: [400], 3: [400]}


def test_suffix_order_is_sorted_and_prefixes_are_true():
    rnd = random.Random(4)
    for letters in (b"ab", b"a", bytes(range(256))):
        parts = [bytes(rnd.choice(letters) for _ in range(rnd.randrange(40, 200))) for _ in range(5)]
        starts = [len(p) - 39 for p in parts]
        order, data = substring_dedup.suffix_order(parts, starts, 40)
        assert len(order) == sum(starts) == len(set(order.tolist()))
        keys = [bytes(data[p : p + 40]) for p in order.tolist()]
        assert keys == sorted(keys)
        for k, n in enumerate(substring_dedup.common_prefixes(data, order, 40).tolist()[1:], 1):
            a, b = keys[k - 1], keys[k]
            assert n == next((i for i in range(40) if a[i] != b[i]), 40)


def test_long_texts_are_handled_in_pieces(monkeypatch):
    rnd = random.Random(6)
    text = bytes(rnd.choice(b"abcd") for _ in range(5000))
    whole = {s for _, lo, hi in substring_dedup.anchor_runs(text) for s in range(lo, hi + 1)}
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    pieces = [(lo, hi) for _, lo, hi in substring_dedup.anchor_runs(text)]
    assert whole == {s for lo, hi in pieces for s in range(lo, hi + 1)} == set(range(4601))
    assert sum(hi - lo + 1 for lo, hi in pieces) == 4601


def _vectors(spark):
    rnd = np.random.default_rng(7)
    centres = rnd.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.2 * rnd.normal(size=8)).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[100][1]) for i in range(40)]  # ties
    odd = [(None, rows[0][1]), (6000, None), (6100, [0.0] * 8), (6200, [float("nan")] * 8), (6300, [1.0]), (6400, [None] + [1.0] * 7), (6500, [float("inf")] * 8)]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS leaf")


def test_neighbours_reach_the_recall(spark):
    rows, table = _vectors(spark)
    got = defaultdict(list)
    for r in vector_search.nearest_neighbours(table).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, data = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        distance = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, distance)) if k != q][:10]
        found = sorted(got[int(ids[q])])
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(abs(s - distance[list(ids).index(v)]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {int(ids[k]) for k in order})
        total += 10
    assert len(got) == 31 and hits / total >= 0.95


def test_product_of_matrices_loses_no_neighbour():
    rng = np.random.default_rng(3)
    near = np.repeat(rng.normal(size=(40, 6)), 5, axis=0)  # ties, and rows that differ in the last bits
    near[::7] *= 1 + 2**-50
    for data in (near, 1e8 + near, 1e-200 * near, 1e200 * near, rng.normal(size=(500, 6)), near[:9]):
        ids = rng.permutation(len(data)) // 2  # ids come twice
        queries, own = data[::11], ids[::11]
        got = vector_search.nearest_of_each(queries, own, data, ids, 7)
        assert len(got) == len(queries)
        for (q, i, d), v, o in zip(got, queries, own):
            with np.errstate(over="ignore"):
                want_i, want_d = vector_search.nearest_of(v, o, data, ids, 7)
            assert q == o and (i == want_i).all() and (d == want_d).all()


def test_few_or_no_candidates(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (100, [1.0, 3.0])]
    got = vector_search.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 0.0), (0, 2, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 1, 1.0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_search.nearest_neighbours(none).count() == 0


def test_driver_gets_one_sample_from_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "MAX_SAMPLE", 500)
    many = spark.range(0, 20_000, 1, 40).selectExpr("id AS vec_id", "transform(sequence(1, 64), k -> sin(id * k)) AS embedding").where("vec_id > 0")
    rows = many.selectExpr("xxhash64(vec_id) AS h", "vec_id", "embedding").collect()
    want = np.array([r.embedding for r in sorted(rows, key=lambda r: (r.h, r.vec_id))[:500]])
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "2m")  # a sample has 256 kB
    try:
        index = vector_search.Index(many)
        assert index.calibrate(index.rows.where("id % 1000 = 0"), 5) >= 1
        assert (vector_search._sample(many.selectExpr("vec_id AS id", "embedding AS v"), 19_999, 64) == want).all()
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert index.rows.count() == 19_999


def test_sample_of_ids_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "MAX_SAMPLE", 50)
    top = max(range(100), key=lambda i: spark.range(i, i + 1).selectExpr("xxhash64(id)").first()[0])  # its hash is dropped first
    same = spark.range(0, 400).selectExpr(f"{top}L AS id", "array(cast(id AS double), 1d) AS v")
    assert vector_search._sample(same, 400, 2).shape == (50, 2)
    assert vector_search._sample(same.where("v[0] < 30"), 30, 2)[:, 0].sum() == sum(range(30))
    assert vector_search._sample(same.limit(0), 0, 2).shape == (0, 2)


def test_base_text_is_near_its_copy():
    assert _groups([(1, BASE), (2, BASE + " more")])[(2, 57, 1, False)] == 1


@pytest.mark.parametrize("edits, pairs_per_copy", [(1, 12), (3, 15)])
def test_near_copies_of_one_text_are_compared_in_proportion(spark, monkeypatch, edits, pairs_per_copy):
    """Every link is kept, and compared pairs do not grow with the square of a group."""
    compared = []
    confirm = near_dedup.NearDuplicates.confirm

    def counting(self, pairs):
        compared.append(pairs.count())
        return confirm(self, pairs)

    monkeypatch.setattr(near_dedup.NearDuplicates, "confirm", counting)
    for n in (250, 1000):
        rnd = random.Random(edits)
        texts = []
        for i in range(n):
            words = [f"b{k}" for k in range(60)]
            for e in rnd.sample(range(60), edits if i else 0):
                words[e] = f"e{i}x{e}"
            texts.append(words)
        sets = [frozenset(tuple(w[k : k + 5]) for k in range(56)) for w in texts]
        name = list(range(n))
        for b in range(n):  # the smallest reachable number
            linked = {name[a] for a in range(b) if 175 * len(sets[a] & sets[b]) >= 75 * 112}
            if linked:
                least = min(linked)
                name = [least if x in linked or k == b else x for k, x in enumerate(name)]
        compared.clear()
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == dict(enumerate(name))
        assert sum(compared) <= pairs_per_copy * n


def test_classes_that_no_pivot_joins_are_found_by_their_prefixes(spark):
    """Pairs among open classes are joined exactly: nothing is left to bands or bits."""
    rnd = random.Random(9)
    vocabulary = [f"v{k}" for k in range(30)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 25))) for _ in range(40)]
    for k in range(160):
        words = texts[k].split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(" ".join(words[: len(words) - rnd.randint(0, 1)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    run = near_dedup.NearDuplicates(df, "doc_id", "text")
    members = run.classes.select("c", "n").withColumn("label", F.col("c"))
    none = spark.createDataFrame([], "a long, b long")
    found = run.confirm(run.prefix_pairs(members, none)).collect()
    sets = {r.c: set(near_dedup.shingle_hashes(texts[r.id].encode()).tolist()) for r in run.classes.select("c", "holder.id").collect()}
    expected = {
        (a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    }
    assert {(r.a, r.b) for r in found} == expected and len(expected) > 30

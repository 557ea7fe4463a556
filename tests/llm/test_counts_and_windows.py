"""Token counts, decontamination, sharding and mixing: edge rows, and brute force."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from llm_rows import ROWS, documents

from sentika.llm import decontamination, mixing, sharding, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    odd = [(20, "a<|endoftext|>b  c"), (21, "日本語 text １２ ½ x"), (22, "it's\n\n  we'LL"), (23, "͸\U0001fae8 x")]
    both = documents(spark, [*ROWS, *odd])
    for block in (64, 1 << 20):
        got = token_counts.token_counts(both, PATH, block_bytes=block).collect()
        want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*ROWS, *odd])
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_pattern_and_library_agree_below_the_bound():
    library, pattern, *_ = token_counts._library(PATH)
    for cp in range(token_counts.AGREED):
        text = f"a{chr(cp)}1{chr(cp)} {chr(cp)}b {chr(cp)}"
        assert [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)] == pattern.findall(text)


def test_token_counts_of_nothing(empty):
    assert token_counts.token_counts(empty, PATH).count() == 0


def _hits(text, items):
    words = decontamination.words((text or "").encode())
    hit, found = set(), set()
    for i, item in items:
        own = decontamination.words((item or "").encode())
        size = min(10, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for s in range(len(words) - size + 1):
                if words[s : s + size] == own[k : k + size]:
                    hit |= set(range(s, s + size))
                    found |= {i} - {None}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [8 << 20, 40])
def test_contamination_equals_brute_force(spark, docs, bound):
    items = [(1, " ".join(f"W{k}" for k in range(20, 34))), (2, "ONE, two"), (3, None), (4, ""), (None, "tail"), (5, "one two"), (6, "zz")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS id", "2 AS doc_id")
    got = decontamination.contamination(docs, bench, max_set_bytes=bound).select(
        "doc_id", "n_words", "n_hit", "items", decontamination.items_digest().alias("d")
    ).collect()
    want = Counter((i, n, h, tuple(f)) for i, t in ROWS for n, h, f in [_hits(t, items)])
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert all(r.d == decontamination.sha256_of(r["items"]) for r in got)


def test_decontaminate_drops_or_cuts(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20, 34)))], "item_id long, text string")
    left = decontamination.decontaminate(docs, bench)
    assert left.columns == docs.columns
    gone = {1, 2, 3, 10}
    assert Counter(r.doc_id for r in left.select("doc_id").collect()) == Counter(i for i, _ in ROWS if i not in gone and i is not None) + Counter({None: 1})
    cut = decontamination.decontaminate(docs, bench, remove="spans")
    texts = dict(cut.where("doc_id in (1, 7)").select("doc_id", "text").collect())
    assert "w19  w34" in texts[1] and texts[7] == dict(ROWS)[7]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(docs, none).count() == len(ROWS)
    assert decontamination.contamination(docs, none).where("n_hit > 0").count() == 0


def test_shards_hold_every_row_once(docs, empty):
    placed = sharding.shard_documents(docs, n_shards=4, n_slots=64)
    assert {"lang", "source", "n_chars", "key"} <= set(placed.columns)
    rows = placed.select("doc_id", "text", "shard", "slot", "size", "text_crc32", "law").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(ROWS)
    for s in range(4):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    for r in rows:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "bytes")
    assert sharding.shard_documents(empty).count() == 0


def test_rebalancing_edits_the_map_and_keeps_versions(spark, tmp_path):
    docs = documents(spark, [(i, "x" * (i % 50)) for i in range(3000)])
    path = str(tmp_path / "map")
    before = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 4, 512, map_path=None).select("doc_id", "shard").collect()}
    sizes = sharding.slot_bytes(sharding.slotted(docs.drop("size", "vslot"), 512))
    sharding.store_map(sharding.build_map(sizes, 4, 512), path)
    after = sharding.shard_documents(docs, 5, 512, map_path=path)
    moved = {r.doc_id: r.shard for r in after.select("doc_id", "shard").collect()}
    assert {moved[i] for i in moved if moved[i] != before[i]} == {4}
    load = [r[0] for r in after.groupBy("shard").agg({"size": "sum"}).select("sum(size)").collect()]
    assert len(load) == 5 and max(load) - min(load) < 0.02 * max(load)
    assert sharding.load_map(spark, path).first().version == 2
    assert sharding.load_map(spark, path, 1).where("shard = 4").count() == 0


def _fill(total, kids):
    """Budgets of children (capacity, weight) by water filling in rounds."""
    out, left, live = {}, total, dict(kids)
    while live:
        weight = sum(w for _, w in live.values())
        full = {k: c for k, (c, w) in live.items() if c * weight <= left * w}
        if not full:
            return out | {k: left * w // weight for k, (_, w) in live.items()}
        out |= full
        left -= sum(full.values())
        live = {k: v for k, v in live.items() if k not in full}
    return out


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 100), ("a", "y", 1000), ("b", "x", 3000), ("b", None, 50), (None, "z", 10)], "domain string, lang string, tokens long"
    )
    weights = {"domain": {"a": 2, "b": 1}, "lang": {"x": 3}}
    got = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(leaves, ("domain", "lang"), weights, 0.5, 2).collect()}
    top = _fill(2080, {"a": (2200, 2), "b": (6100, 1), None: (20, 1)})
    a, b = _fill(top["a"], {"x": (200, 3), "y": (2000, 1)}), _fill(top["b"], {"x": (6000, 3), None: (100, 1)})
    assert got == {("a", "x"): a["x"], ("a", "y"): a["y"], ("b", "x"): b["x"], ("b", None): b[None], (None, "z"): 20}
    assert a["x"] == 200 and a["y"] == top["a"] - 200


def test_mixing_takes_whole_epochs_and_a_prefix(docs, empty):
    tree = docs.withColumn("domain", mixing.domain_of())
    mixed = mixing.mix(tree, mixing.LEVELS, mixing.WEIGHTS, budget_share=0.7, max_epochs=3)
    assert mixed.count() == len(ROWS) and {"budget", "copies", "tokens", "key"} <= set(mixed.columns)
    for r in mixed.groupBy(*mixing.LEVELS).agg({"budget": "max", "tokens": "sum"}).collect():
        own = mixed
        for c in mixing.LEVELS:
            own = own.where(own[c].eqNullSafe(r[c]))
        used = own.selectExpr("sum(tokens * copies)", "max(copies)", "min(copies)").first()
        assert used[0] <= r["max(budget)"] and used[1] - used[2] <= 1
    assert mixing.mix(empty.withColumn("domain", mixing.domain_of()), mixing.LEVELS, mixing.WEIGHTS).count() == 0
    assert mixing.repeated(mixed).count() == mixed.agg({"copies": "sum"}).first()[0]

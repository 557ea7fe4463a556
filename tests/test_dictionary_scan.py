"""Large lexicons: automata against the pattern form and plain search."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from small_lexicon import SMALL

from sentika.functions import labels as L
from sentika.functions.text import clean_reviews
from sentika.lexicons.sample import sample_lexicon
from sentika.operators import dictionary_scan as A


def texts_of(vocabulary, rnd, n=150):
    glue = [" ", " ", ", ", "-", "_", "é", "", ". ", "\n", "́ "]
    out = []
    for _ in range(n):
        words = [(w.upper() if rnd.random() < 0.2 else w) + rnd.choice(glue) for w in rnd.choices(vocabulary, k=rnd.randint(0, 14))]
        out.append("".join(words))
    return [*out, None, ""]


def terms_table(spark, lists):
    rows = [(label, t, i) for label, ts in lists.items() for i, t in enumerate(ts)]
    return spark.createDataFrame([*rows, ("none", None, 0), ("empty", "", 1)], "label string, term string, ord long")


#: Terms that overlap, begin alike, begin or end with no word character, and repeat.
ODD = {
    "a": ["b c", "b", "b c d", "c d", "d", "b"],
    "z": ["c d", "b c d", "b c", "c", "-c", "c-", "b-c", ", b", "é"],
}


@pytest.mark.parametrize("part_terms", [1000, 4])
@pytest.mark.parametrize("lists", [dict(SMALL.aspects), dict(sample_lexicon().aspects), ODD], ids=["small", "sample", "odd"])
def test_counts_equal_the_pattern_form(spark, lists, part_terms):
    vocabulary = sorted({t for ts in lists.values() for t in ts} | {"b", "c", "d"})
    df = spark.createDataFrame(list(enumerate(texts_of(vocabulary, random.Random(part_terms)))), "id int, t string").repartition(3)
    found = A.lexicon_counts(df, terms_table(spark, lists), "id", "t", part_terms).collect()
    columns = [L.hit_count(F.coalesce("t", F.lit("")), ts).alias(f"h{i}") for i, ts in enumerate(lists.values())]
    expected = {(r.id, a): r[f"h{i}"] for r in df.select("id", *columns).collect() for i, a in enumerate(lists) if r[f"h{i}"]}
    assert {(r.id, r.label): r.hits for r in found} == expected and len(expected) > 100
    assert len(found) == len(expected)


def test_a_hundred_thousand_terms(spark):
    """Two parts; what counts equals the alternation of the terms that can stand in the texts."""
    rnd = random.Random(6)
    words = [f"{a}{b}{c}" for a in "bcdfgklm" for b in "aeiou" for c in range(60)]
    phrases = {" ".join(rnd.choices(words, k=rnd.choice([1, 2, 2, 3]))) for _ in range(150_000)}
    terms = rnd.sample(sorted(phrases), 100_000)
    rows = [(f"l{k % 3}", t, k) for k, t in enumerate(terms)]
    texts = [" ".join(rnd.choices(words, k=40)) + ". " + " ".join(rnd.choices(terms, k=5)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    table = spark.createDataFrame(rows, "label string, term string, ord int")
    found = {(r.id, r.label): r.hits for r in A.lexicon_counts(df, table, "id", "t", 60_000).collect()}
    expected = {}
    for i, text in enumerate(texts):
        inside = [(label, t) for label, t, _ in rows if t in text]
        for label in ("l0", "l1", "l2"):
            pattern = "|".join(re.escape(t) for a, t in inside if a == label)
            if pattern and (n := len(re.findall(rf"\b(?:{pattern})\b", text))):
                expected[i, label] = n
    assert found == expected and sum(found.values()) > 1000


def test_automaton_shares_beginnings_and_falls_back():
    one = A.Automaton([("x", "a b a c", 0), ("x", "b a", 1), ("y", "a", 2)])
    assert one.matches("a b a b a c") == {"x": [(2, 1, 5), (6, 1, 9), (4, 0, 11)], "y": [(0, 2, 1), (4, 2, 5), (8, 2, 9)]}
    assert one.matches("aa b") == {} and A.Automaton([]).matches("a") == {}


def test_labels_equal_the_pattern_form(spark):
    lexicon = sample_lexicon()
    vocabulary = [*[t for ts in lexicon.aspects.values() for t in ts], *lexicon.positive, *lexicon.negative]
    texts = texts_of(vocabulary, random.Random(2))
    df = spark.createDataFrame([(i, t, [None, 1, 3, 5][i % 4]) for i, t in enumerate(texts)], "review_id int, t string, rating int")
    clean = clean_reviews(df, "t")
    columns = ["review_id", "aspects", "aspect_count", "sentiment_rule", "matched_keywords", "is_multilabel"]
    for rating in ("rating", None):
        expected = {r.review_id: r for r in L.label_reviews(clean, lexicon, rating_col=rating).select(*columns).collect()}
        got = A.label_reviews_by_table(clean, lexicon.to_table(spark), rating_col=rating).collect()
        assert {r.review_id: r for r in got} == expected


def test_a_large_table_is_not_dealt_to_automata(spark, monkeypatch):
    """Texts are read once however many times ``part_terms`` the table holds."""
    made = []
    monkeypatch.setattr(A, "Automaton", lambda terms: made.append(1))
    table = terms_table(spark, {"a": [f"w{k}" for k in range(400)], "b": [f"w{k} w{k + 1}" for k in range(400)]})
    df = spark.createDataFrame([(k, f"w{k} w{k + 1} x w{k}") for k in range(300)], "id int, t string")
    found = A.lexicon_counts(df, table, "id", "t", part_terms=5)
    assert {(r.id, r.label, r.hits) for r in found.collect()} == {x for k in range(300) for x in ((k, "a", 3), (k, "b", 1))}
    assert not made


def test_repeated_and_null_keys_beyond_one_part(spark):
    table = terms_table(spark, {"a": ["b", "c d"]})
    df = spark.createDataFrame([(1, "b c d"), (1, "b c d"), (2, "b b"), (None, "b")], "id int, t string")
    found = A.lexicon_counts(df, table, "id", "t", part_terms=1)
    assert sorted((r.id, r.hits) for r in found.collect()) == [(1, 2), (1, 2), (2, 2)]

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from small_lexicon import SMALL

from sentika.functions import labels as L
from sentika.functions.text import clean_reviews
from sentika.lexicons import Lexicon
from sentika.lexicons.sample import sample_lexicon


# Cleaned text, hits per aspect, positive and negative hits, sentiment without stars.
GOLDEN = [
    ("easy to find my way, with a clear menu. my refund came too", {"EASE": 2, "DELIVERY": 2}, "Netral"),
    ("the shop is offline again and i am angry", {"UPTIME": 1}, "Negatif"),
    ("it asks for my pin, then my pin and face-id again", {"TRUST": 3}, "Netral"),
    ("parcel arrived, refund arrived, great, very good", {"DELIVERY": 3}, "Positif"),
    ("great that it feels safe, awful that it is not good", {"TRUST": 1}, "Negatif"),
    ("locked out", {"UPTIME": 1, "TRUST": 1}, "Netral"),
    ("spin and pinned are other words", {}, "Netral"),
    (None, {}, "Netral"),
    ("", {}, "Netral"),
]


def test_golden_labels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "id int, clean_text string")
    rows = L.label_reviews(df, SMALL, rating_col=None).orderBy("id").collect()
    for row, (_, hits, mood) in zip(rows, GOLDEN):
        assert row.matched_keywords == hits
        assert row.aspects == (list(a for a in SMALL.aspects if a in hits) or ["GENERAL"])
        assert row.sentiment_rule == mood
        assert row.aspect_count == len(row.aspects)
        assert row.is_multilabel == (len(row.aspects) > 1)


def test_stars_and_words(spark):
    lexicon = Lexicon({"A": ["x"]}, ["good"], ["bad"])
    cases = [
        (5, "good", "Positif"), (5, "", "Positif"), (4, "bad", "Netral"), (1, "bad", "Negatif"),
        (1, "", "Negatif"), (2, "good", "Netral"), (3, "good", "Positif"), (3, "bad", "Negatif"),
        (3, "good bad", "Netral"), (None, "good", "Positif"), (None, "bad bad good", "Negatif"), (None, "", "Netral"),
    ]
    df = spark.createDataFrame(cases, "rating int, clean_text string, want string")
    for row in L.label_reviews(df, lexicon).collect():
        assert row.sentiment_rule == row.want, row


def plain_pattern(terms):
    return re.compile(r"\b(" + "|".join(re.escape(t) for t in terms) + r")\b", re.IGNORECASE)


@pytest.mark.parametrize("lexicon", [SMALL, sample_lexicon()], ids=["small", "sample"])
def test_hits_equal_the_plain_alternation(spark, lexicon):
    lists = [*lexicon.aspects.values(), lexicon.positive, lexicon.negative]
    vocabulary = sorted({t for ts in lists for t in ts})
    glue = st.sampled_from([" ", ", ", "-", "_", "é", "", ". "])

    @settings(max_examples=4, phases=[Phase.generate], derandomize=True, deadline=None, suppress_health_check=list(HealthCheck))
    @given(
        st.lists(
            st.lists(st.tuples(st.sampled_from(vocabulary), glue, st.booleans()), max_size=12),
            min_size=80,
            max_size=80,
        )
    )
    def check(samples):
        texts = ["".join((w.upper() if up else w) + g for w, g, up in s) for s in samples]
        df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
        clean = clean_reviews(df, "t")
        columns = [L.hit_count(F.col("t"), ts).alias(f"h{i}") for i, ts in enumerate(lists)]
        columns += [L.hit_count(F.col("clean_text"), ts, cleaned=True).alias(f"c{i}") for i, ts in enumerate(lists)]
        for row in clean.select("t", "clean_text", *columns).collect():
            for i, ts in enumerate(lists):
                assert row[f"h{i}"] == len(plain_pattern(ts).findall(row.t)), (row.t, ts)
                assert row[f"c{i}"] == len(plain_pattern(ts).findall(row.clean_text)), (row.clean_text, ts)

    check()


def test_lexicon_table_round_trip(spark):
    lexicon = sample_lexicon()
    again = Lexicon.from_table(lexicon.to_table(spark))
    assert again == Lexicon(
        {a: list(t) for a, t in lexicon.aspects.items()},
        list(lexicon.positive), list(lexicon.negative), dict(lexicon.slang), dict(lexicon.stems),
    )


def test_lexicon_check_finds_unreachable_terms():
    assert set(dict(SMALL.unreachable_terms())) == {"zzz", "looove", "quick"}


def test_encodings(spark):
    df = spark.createDataFrame(
        [(["A", "C"], "Negatif"), (["GENERAL"], "Positif"), (["B"], "other")], "aspects array<string>, mood string"
    )
    names = ["A", "B", "C"]
    a, m = F.col("aspects"), F.col("mood")
    rows = df.select(
        L.aspect_multihot(a, names).alias("hot"),
        L.aspect_sentiment_ids(a, m, names).alias("ids"),
        L.sentiment_score(m).alias("score"),
        L.split_aspects(L.join_aspects(a)).alias("again"),
        L.has_aspect_joined(L.join_aspects(a), "C").alias("has_c"),
        a.alias("aspects"),
        L.summary_string(a, F.create_map(F.lit("A"), m)).alias("summary"),
    ).collect()
    assert [r.hot for r in rows] == [[1, 0, 1], [0, 0, 0], [0, 1, 0]]
    assert [r.ids for r in rows] == [[2, -1, 2], [-1, -1, -1], [-1, 1, -1]]
    assert [r.score for r in rows] == [-1, 1, 0]
    assert all(r.again == r.aspects for r in rows)
    assert [r.has_c for r in rows] == [True, False, False]
    assert [r.summary for r in rows] == ["A=Negatif | C=-", "GENERAL=-", "B=-"]


def test_scalars(spark):
    row = spark.range(1).select(
        L.priority_tier(F.lit(40.0)).alias("t40"),
        L.priority_tier(F.lit(40.01)).alias("t41"),
        L.priority_tier(F.lit(25.0)).alias("t25"),
        L.aspect_title(F.lit("SYSTEM_AVAILABILITY")).alias("title"),
        L.coef_direction(F.lit(0.0)).alias("zero"),
        L.argmax_class(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))).alias("first_max"),
        L.passes_threshold(F.lit(0.5)).alias("at"),
        L.passes_threshold(F.lit(0.5), inclusive=False).alias("above"),
        L.text_preview(F.lit("x" * 100)).alias("preview"),
        L.sigmoid(F.lit(0.0)).alias("half"),
    ).first()
    assert (row.t40, row.t41, row.t25) == ("watch", "high", "good")
    assert row.title == "System Availability"
    assert row.zero.startswith("Negatif")
    assert (row.first_max, row["at"], row.above, row.half) == (1, True, False, 0.5)
    assert row.preview == "x" * 80 + "..."

"""Lexicon labelling as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentika.functions.text import KEPT_PUNCTUATION
from sentika.lexicons import GENERAL, NEGATIVE, NEUTRAL, POSITIVE, SENTIMENT_IDS, Lexicon
from sentika.session import evaluate_once

# Texts the coefficient table and the report carry.
DIRECTIONS = ("Positif (↑ Rating)", "Negatif (↓ Rating)")
TIER_TEXTS = (
    "🔴 PRIORITAS TINGGI — Perlu perbaikan segera",
    "🟡 PERHATIAN — Monitoring ketat diperlukan",
    "🟢 BAIK — Pertahankan dan tingkatkan",
)


def lexicon_pattern(terms: Iterable[str], cleaned: bool = False) -> str:
    """Case-insensitive whole-word pattern; the first listed term wins at a position.

    Terms are grouped by first letter behind a look-ahead, so most word starts are
    rejected by one character test. Only terms that share a first letter can
    compete at a position, and their listed order is kept inside the group.

    ``cleaned`` is for text from the cleaning chain with a blank put in front: all its
    characters but a dozen separators belong to words, so a separator before the term
    replaces the general and slower word-boundary test.
    """
    terms = list(terms)
    groups: dict[str, list[str]] = {}
    for term in terms:
        if term:
            groups.setdefault(term[0].lower(), []).append(term[1:])
    if not groups:
        return r"(?!)"
    first = "".join(re.escape(c) for c in groups)
    branches = "|".join(
        f"{re.escape(c)}(?:{'|'.join(re.escape(rest) for rest in tails)})"
        for c, tails in groups.items()
    )
    if cleaned and all(_in_word(t[0]) and _in_word(t[-1]) for t in terms if t):
        return rf"(?iu)[ {KEPT_PUNCTUATION}](?=[{first}])(?:{branches})(?=[ {KEPT_PUNCTUATION}]|$)"
    return rf"(?iuU)\b(?=[{first}])(?:{branches})\b"


def _in_word(char: str) -> bool:
    return char == "_" or char.isalnum()


def hit_count(text: Column, terms: Iterable[str], cleaned: bool = False) -> Column:
    """Non-overlapping hits, leftmost first; see :func:`lexicon_pattern` for ``cleaned``."""
    searched = F.concat(F.lit(" "), text) if cleaned else text
    return F.regexp_count(searched, F.lit(lexicon_pattern(terms, cleaned)))


def naive_sentiment(rating: Column) -> Column:
    """Sentiment by stars alone; a missing rating is neutral."""
    return (
        F.when(rating >= 4, F.lit(POSITIVE))
        .when(rating <= 2, F.lit(NEGATIVE))
        .otherwise(F.lit(NEUTRAL))
    )


def detect_aspects(hits: dict[str, Column]) -> Column:
    """Aspects with at least one hit in lexicon order, else the general one."""
    found = F.array_compact(F.array(*[F.when(n > 0, F.lit(a)) for a, n in hits.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(GENERAL)))


def matched_keywords(hits: dict[str, Column]) -> Column:
    pairs = [x for a, n in hits.items() for x in (F.lit(a), n)]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def detect_sentiment(positive: Column, negative: Column, rating: Column | None = None) -> Column:
    """Stars decide first and need the words not to contradict them; without
    stars, or at three of them, the larger word count decides."""
    by_words = (
        F.when(positive > negative, F.lit(POSITIVE))
        .when(negative > positive, F.lit(NEGATIVE))
        .otherwise(F.lit(NEUTRAL))
    )
    if rating is None:
        return by_words
    return (
        F.when(rating >= 4, F.when(positive >= negative, F.lit(POSITIVE)).otherwise(F.lit(NEUTRAL)))
        .when(rating <= 2, F.when(negative >= positive, F.lit(NEGATIVE)).otherwise(F.lit(NEUTRAL)))
        .otherwise(by_words)
    )


def lexicon_hits(
    df: DataFrame, lexicon: Lexicon, text_col: str = "clean_text", cleaned: bool = False
) -> DataFrame:
    """Add one hit count per aspect (``hits_0``, ``hits_1``, ...) and ``hits_positive``,
    ``hits_negative``; each pattern runs once per row. Set ``cleaned`` only for text that
    came out of the cleaning chain."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lists = {f"hits_{i}": terms for i, terms in enumerate(lexicon.aspects.values())}
    lists |= {"hits_positive": lexicon.positive, "hits_negative": lexicon.negative}
    counts = {name: hit_count(text, terms, cleaned) for name, terms in lists.items()}
    return evaluate_once(df, counts)


def label_reviews(
    df: DataFrame,
    lexicon: Lexicon,
    text_col: str = "clean_text",
    rating_col: str | None = "rating",
    cleaned: bool = False,
) -> DataFrame:
    """Add aspects, aspect_count, sentiment_rule, matched_keywords, is_multilabel.

    ``rating_col=None`` labels from words alone; ``cleaned`` as in :func:`lexicon_hits`.
    """
    counted = lexicon_hits(df, lexicon, text_col, cleaned)
    hits = {a: F.col(f"hits_{i}") for i, a in enumerate(lexicon.aspects)}
    rating = F.col(rating_col) if rating_col and rating_col in df.columns else None
    helper = [c for c in counted.columns if c.startswith("hits_") and c not in df.columns]
    return (
        counted.withColumns(
            {
                "aspects": detect_aspects(hits),
                "sentiment_rule": detect_sentiment(
                    F.col("hits_positive"), F.col("hits_negative"), rating
                ),
                "matched_keywords": matched_keywords(hits),
            }
        )
        .withColumns(
            {"aspect_count": F.size("aspects"), "is_multilabel": F.size("aspects") > 1}
        )
        .drop(*helper)
    )


# ---- encodings --------------------------------------------------------------

def has_aspect(aspects: Column, aspect: str) -> Column:
    return F.array_contains(aspects, aspect)


def join_aspects(aspects: Column) -> Column:
    return F.array_join(aspects, "|")


def split_aspects(joined: Column) -> Column:
    return F.split(joined, r"\|")


def has_aspect_joined(joined: Column, aspect: str) -> Column:
    """Membership in the pipe-joined form."""
    return F.array_contains(split_aspects(joined), aspect)


def sentiment_id(sentiment: Column) -> Column:
    """Positive 0, neutral 1, negative 2; an unknown label counts as neutral."""
    return _switch(sentiment, SENTIMENT_IDS, 1)


def sentiment_score(sentiment: Column) -> Column:
    """Positive +1, negative -1, neutral or unknown 0."""
    return _switch(sentiment, {POSITIVE: 1, NEGATIVE: -1}, 0)


def aspect_multihot(aspects: Column, names: Sequence[str]) -> Column:
    return F.array(*[has_aspect(aspects, a).cast("int") for a in names])


def aspect_sentiment_ids(aspects: Column, sentiment: Column, names: Sequence[str]) -> Column:
    """Sentiment id where the aspect is present, -1 where it is absent."""
    return F.array(
        *[F.when(has_aspect(aspects, a), sentiment_id(sentiment)).otherwise(-1) for a in names]
    )


def aspect_regression_features(
    aspects: Column, sentiment: Column, names: Sequence[str]
) -> dict[str, Column]:
    """Presence 0/1 and signed sentiment per aspect, as named columns."""
    features = {}
    for a in names:
        present = has_aspect(aspects, a)
        features[f"{a}_present"] = F.when(present, 1).otherwise(0)
        features[f"{a}_sentiment"] = F.when(present, sentiment_score(sentiment)).otherwise(0)
    return features


def coef_direction(coefficient: Column) -> Column:
    """Sign label; zero counts as negative."""
    rising, falling = DIRECTIONS
    return F.when(coefficient > 0, F.lit(rising)).otherwise(F.lit(falling))


def priority_tier(negative_pct: Column, labels: Sequence[str] = ("high", "watch", "good")) -> Column:
    """Above 40 % negative is high priority, above 25 % is to be watched."""
    high, watch, good = labels
    return (
        F.when(negative_pct > 40, F.lit(high))
        .when(negative_pct > 25, F.lit(watch))
        .otherwise(F.lit(good))
    )


def aspect_title(aspect: Column) -> Column:
    return F.initcap(F.replace(aspect, F.lit("_"), F.lit(" ")))


def text_preview(text: Column, width: int = 80) -> Column:
    return F.concat(F.left(text, F.lit(width)), F.lit("..."))


def summary_string(aspects: Column, sentiments: Column) -> Column:
    """``A=Positif | B=-`` with a dash where the map has no entry."""
    part = lambda a: F.concat(a, F.lit("="), F.coalesce(F.element_at(sentiments, a), F.lit("-")))
    return F.array_join(F.transform(aspects, part), " | ")


def round_half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


# ---- scores -----------------------------------------------------------------

def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def passes_threshold(probability: Column, threshold: float = 0.5, inclusive: bool = True) -> Column:
    return probability >= threshold if inclusive else probability > threshold


def argmax_class(scores: Column) -> Column:
    """Zero-based position of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _switch(value: Column, table: dict[str, int], default: int) -> Column:
    (key, result), *rest = table.items()
    chain = F.when(value == key, result)
    for key, result in rest:
        chain = chain.when(value == key, result)
    return chain.otherwise(default)

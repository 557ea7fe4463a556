"""Dictionary work: large token dictionaries, lexicon joins, languages, terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sentika.functions.labels import sentiment_id, sentiment_score
from sentika.functions.text import WORD, replace_words_join, word_tokens  # noqa: F401
from sentika.session import broadcast_if_small, evaluate_once


def lexicon_match_join(
    df: DataFrame, terms: DataFrame, lengths: Sequence[int], key: str, text_col: str
) -> DataFrame:
    """(key, aspect) pairs where some term of the aspect occurs, by an equi-join.

    For lexicons too large for one pattern. A term is compared as a run of pieces,
    a piece being a word or one other character; ``lengths`` lists the piece counts
    of the terms (see :func:`piece_count`). Runs are made distinct inside the row
    before they are exploded, so a repeated word travels once.
    """
    piece = rf"[{WORD}]+|[^{WORD}]"
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    pieces = evaluate_once(
        df.select(key, text_col), {"__pieces": F.regexp_extract_all(text, F.lit(f"(?s){piece}"), F.lit(0))}
    )
    runs = [_runs(F.col("__pieces"), n) for n in sorted(set(lengths))]
    distinct = F.array_distinct(F.concat(*runs)) if len(runs) > 1 else F.array_distinct(runs[0])
    grams = pieces.select(key, F.explode(distinct).alias("term"))
    lexicon = broadcast_if_small(terms.select("term", F.col("label").alias("aspect")))
    hits = grams.join(lexicon, "term")
    return hits.select(key, "aspect").distinct()


def piece_count(term: str) -> int:
    """Words and single other characters in a term."""
    count, inside = 0, False
    for c in term:
        word = c == "_" or c.isalnum()
        count += not (word and inside)
        inside = word
    return count


def _runs(pieces: Column, n: int) -> Column:
    """Every run of n neighbouring pieces, written together."""
    if n == 1:
        return pieces
    shifted = [F.slice(pieces, i + 1, F.size(pieces)).alias(f"p{i}") for i in range(n)]
    whole = F.slice(F.arrays_zip(*shifted), F.lit(1), F.greatest(F.size(pieces) - (n - 1), F.lit(0)))
    return F.transform(whole, lambda run: F.concat(*[run[f"p{i}"] for i in range(n)]))


def label_codes(df: DataFrame, sentiment_col: str = "sentiment_rule") -> DataFrame:
    """Add sentiment_score (+1 / 0 / -1) and sentiment_id (0 / 1 / 2)."""
    mood = F.col(sentiment_col)
    return df.withColumns({"sentiment_score": sentiment_score(mood), "sentiment_id": sentiment_id(mood)})


def aspect_side(df: DataFrame, name: str = "side") -> DataFrame:
    """Both halves in one pass: ``with`` at least one specific aspect, or ``without``."""
    side = F.when(F.array_contains("aspects", "GENERAL"), "without").otherwise("with")
    return df.withColumn(name, side)


def with_aspect(df: DataFrame) -> DataFrame:
    """Reviews with at least one specific aspect (a semi-join on the long form)."""
    return df.where(~F.array_contains("aspects", "GENERAL"))


def without_aspect(df: DataFrame) -> DataFrame:
    """Reviews without any specific aspect (an anti-join on the long form)."""
    return df.where(F.array_contains("aspects", "GENERAL"))


def detect_language(
    df: DataFrame,
    profiles: Mapping[str, Sequence[str]],
    text_col: str = "clean_text",
    out_col: str = "lang",
) -> DataFrame:
    """Language whose frequent words occur most often; first by code on ties,
    ``unknown`` without any. Counted inside the row, so nothing is shuffled."""
    codes = sorted(profiles)
    tokens = evaluate_once(df, {"__words": word_tokens(F.coalesce(F.col(text_col), F.lit("")))})
    counts = {f"__hits_{c}": _count_in(F.col("__words"), profiles[c]) for c in codes}
    scored = evaluate_once(tokens, counts).drop("__words")
    best = F.greatest(*counts) if len(codes) > 1 else F.col(*counts)
    guess = F.when(best == 0, F.lit("unknown"))
    for c in codes:
        guess = guess.when(F.col(f"__hits_{c}") == best, F.lit(c))
    return scored.withColumn(out_col, guess).drop(*counts)


def _count_in(tokens: Column, chosen: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*chosen)))


def term_frequencies(
    labeled: DataFrame,
    stop_words: Sequence[str] = (),
    group_col: str = "aspects",
    text_col: str = "clean_text",
    min_length: int = 1,
) -> DataFrame:
    """Occurrences of each word per aspect (or per value of a scalar group column).

    Words are counted per label combination first; only those counts are spread
    over the single aspects.
    """
    is_array = labeled.schema[group_col].dataType.typeName() == "array"
    tokens = labeled.select(F.col(group_col).alias("__group"), F.explode(word_tokens(F.col(text_col))).alias("term"))
    kept = F.length("term") >= min_length
    if stop_words:
        kept = kept & ~F.col("term").isin(*stop_words)
    counts = tokens.where(kept).groupBy("__group", "term").agg(F.count(F.lit(1)).alias("n"))
    name = "aspect" if is_array else group_col
    if not is_array:
        return counts.withColumnRenamed("__group", name)
    return (
        counts.select(F.explode("__group").alias(name), "term", "n")
        .groupBy(name, "term")
        .agg(F.sum("n").alias("n"))
    )


def top_terms_per_group(counts: DataFrame, group: str, k: int) -> DataFrame:
    """The k most frequent terms of each group, alphabetical on ties.

    The rank filter keeps at most k rows of a group per task before the shuffle.
    """
    w = Window.partitionBy(group).orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

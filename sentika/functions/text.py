"""Text cleaning as Spark columns.

Each ``Column -> Column`` function is one cleaning rule. :func:`clean_reviews`
applies the whole chain to a DataFrame, guarding every rare rule with a cheap
byte search so that most rows never enter the regular expression.

Character classes are written out instead of using ``\\w`` and ``\\s``: their
meaning differs between regex engines, and the explicit sets match the Unicode
words and white space of the cleaning contract.
"""

from __future__ import annotations

import unicodedata
import warnings
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from sentika.session import broadcast_if_small, evaluate_once

# Character sets, patterns and emoji ranges of the cleaning contract.
WORD = r"\p{L}\p{N}_"
# The first line is one bitmap lookup; the wide blanks sit behind a single range
# test that ordinary letters fail at once.
SPACE_NOT_BLANK = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x{85}\x{a0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
SPACE = " " + SPACE_NOT_BLANK
KEPT_PUNCTUATION = r".,!?;:()\-'"
HTML_TAG = r"<[^>]+>"
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F9FF}"
    r"\x{2600}-\x{27BF}\x{1F1E0}-\x{1F1FF}\x{200D}\x{FE0F}]+"
)
URL = rf"(?:https?://|www\.)[^{SPACE}]+"
MENTION = rf"[@#][{WORD}]+"
REPEATED = r"(?d)(.)\1{2,}"
REPEATED_PUNCTUATION = r"([!?.]){2,}"
PUNCTUATION_PAIRS = [a + b for a in "!?." for b in "!?."]
SPECIAL = rf"[^{WORD}{SPACE}{KEPT_PUNCTUATION}]"
SENTENCE_END = r"[.!?]+"


# Parts a frequent word is dealt over where a large dictionary is joined.
SALTS = 16


# ---- single rules ---------------------------------------------------------

def blank_to_empty(text: Column) -> Column:
    """Missing or white-space-only text becomes the empty string."""
    return F.when(F.coalesce(text, F.lit("")).rlike(rf"[^{SPACE}]"), text).otherwise(F.lit(""))


@lru_cache(maxsize=1)
def composable() -> tuple[int, ...]:
    """Code points of all that composition (NFC) may change: combining marks, the vowels
    and final consonants of Hangul, and characters with another canonical form. None lies
    below 0x300."""
    found = {
        c
        for c in range(0x300, 0x110000)
        if not 0xAC00 <= c < 0xD7A4
        and not 0xD800 <= c < 0xE000
        and (unicodedata.category(chr(c))[0] == "M" or unicodedata.normalize("NFC", chr(c)) != chr(c))
    }
    return tuple(sorted(found | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}))


@lru_cache(maxsize=1)
def not_composed() -> str:
    """Character class of the composable characters, block by block: a character is tested
    against the ranges of its own block only, and most letters fail the first test."""
    blocks: dict[int, list[list[int]]] = {}
    for c in composable():
        ranges = blocks.setdefault(c >> 10, [])
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    span = lambda x, y: f"\\x{{{x:x}}}-\\x{{{y:x}}}"
    parts = [
        f"[{span(b << 10, (b << 10) + 0x3FF)}&&[{''.join(span(x, y) for x, y in ranges)}]]" for b, ranges in blocks.items()
    ]
    return f"[{span(0x300, 0x10FFFF)}&&[{''.join(parts)}]]"


def _composer():
    """Arrow function for the texts that need composing; workers need nothing but it."""

    def compose(texts):
        import unicodedata

        import pyarrow

        return pyarrow.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pyarrow.string())

    with warnings.catch_warnings():  # type hints would tie the function to this module
        warnings.simplefilter("ignore", UserWarning)
        return F.arrow_udf(compose, "string", ArrowUDFType.SCALAR)


def normalize_unicode(text: Column) -> Column:
    """Canonical composition (NFC).

    Only texts with a character that composition may change are sent to a Python worker;
    the function is deterministic, so filters pass it on their way to the scan.
    """
    odd = F.when(~_is_ascii(text) & text.rlike(not_composed()), text)
    return F.coalesce(_composer()(odd), text)


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def strip_emoji(text: Column) -> Column:
    return F.regexp_replace(text, EMOJI, "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def strip_mentions(text: Column) -> Column:
    return F.regexp_replace(text, MENTION, "")


def collapse_repeats(text: Column) -> Column:
    """Runs of three or more equal characters become two."""
    return F.regexp_replace(text, REPEATED, "$1$1")


def collapse_punctuation(text: Column) -> Column:
    """A run of ``!``, ``?`` and ``.`` becomes its last character."""
    return F.regexp_replace(text, REPEATED_PUNCTUATION, "$1")


def replace_special(text: Column) -> Column:
    return F.regexp_replace(text, SPECIAL, " ")


def strip_space(text: Column) -> Column:
    """Without white space at the ends: from the first other character to the last."""
    return F.regexp_extract(text, rf"(?s)[^{SPACE}](?:.*[^{SPACE}])?", 0)


def normalize_space(text: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def fallback_clean(text: Column) -> Column:
    """Cleaning without the chain: lower case, stripped."""
    return strip_space(F.lower(text))


def words(text: Column) -> Column:
    """Tokens between white space, empties dropped."""
    return F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD}]+"), F.lit(0))


def replace_words(tokens: Column, mapping: dict[str, str], lowered: bool = False) -> Column:
    """Look every token up in a dictionary; a miss keeps the token.

    The membership test is a hash-set probe, so the linear search of a map
    literal is paid only by tokens that are in the dictionary. ``lowered`` says
    that the tokens are in lower case already. The entries become literals of the
    plan; a dictionary kept as a table is joined by :func:`replace_words_join`.
    """
    usable = {k: v for k, v in mapping.items() if k == k.lower()}
    if not usable:
        return tokens
    table = F.create_map(*[F.lit(x) for pair in usable.items() for x in pair])
    keys = list(usable)

    def look_up(w: Column) -> Column:
        key = w if lowered else F.lower(w)
        return F.when(key.isin(keys), F.element_at(table, key)).otherwise(w)

    return F.transform(tokens, look_up)


def normalize_slang(text: Column, slang: dict[str, str], lowered: bool = False) -> Column:
    """One pass of dictionary lookups over the white-space tokens; empty results drop out."""
    table = {k: v if v.strip() else "" for k, v in slang.items()}
    blanks_only = F.regexp_replace(text, f"[{SPACE_NOT_BLANK}]", " ")
    tokens = replace_words(F.split(blanks_only, " "), table, lowered)
    return F.array_join(F.filter(tokens, lambda w: w != ""), " ")


def replace_words_join(
    df: DataFrame, table: DataFrame, key: str, text_col: str, out_col: str
) -> DataFrame:
    """Dictionary lookup of every token, the dictionary being a table of any size.

    ``table`` has ``term`` (lower case, unique) and ``replacement``; ``key`` must be
    unique in ``df``. The result is that of :func:`normalize_slang` with the same
    entries. Each row sends its distinct words once and gets back those that are in the
    dictionary, which is broadcast after a check of its size. Beyond that it is joined
    by shuffle, and frequent words are dealt over ``SALTS`` parts of a key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = F.array_distinct(F.transform(words(text), lambda w: F.lower(w)))
    asked = df.select(key, F.explode(each).alias("__term"))
    dictionary = table.where(F.col("term") == F.lower("term")).select(
        F.col("term").alias("__term"), F.when(F.trim("replacement") != "", F.col("replacement")).otherwise("").alias("__new")
    )
    small = broadcast_if_small(dictionary)
    if small is dictionary:
        asked = asked.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
        small = dictionary.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = asked.join(small, ["__term", "__salt"])
    else:
        found = asked.join(small, "__term")
    entries = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__term", "__new"))).alias("__found"))
    joined = df.join(entries, key, "left")
    put = F.transform(words(text), lambda w: F.coalesce(F.try_element_at("__found", F.lower(w)), w))
    new = F.when(F.col("__found").isNull(), F.array_join(words(text), " ")).otherwise(
        F.array_join(F.filter(put, lambda w: w != ""), " ")
    )
    return joined.withColumn(out_col, new).drop("__found")


# ---- text statistics --------------------------------------------------------

def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sent_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE_END))


def text_stats(df: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """Add char_count, word_count and sent_count of any text column."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns(
        {
            "char_count": char_count(text),
            "word_count": word_count(text),
            "sent_count": sent_count(text),
        }
    )


# ---- the chain --------------------------------------------------------------

def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _has(text: Column, *needles: str) -> Column:
    found = F.contains(text, F.lit(needles[0]))
    for needle in needles[1:]:
        found = found | F.contains(text, F.lit(needle))
    return found


def _guarded(condition: Callable[[Column], Column], rule: Callable[[Column], Column]):
    return lambda text: F.when(condition(text), rule(text)).otherwise(text)


def _tidy(text: Column) -> Column:
    """``replace_special`` then ``normalize_space`` for text whose only white space
    is single blanks: each run of disallowed characters and blanks becomes one blank."""
    run = rf" ?[^{WORD} {KEPT_PUNCTUATION}][^{WORD}{KEPT_PUNCTUATION}]*"
    return F.trim(F.regexp_replace(text, run, " "))


def _one_space(mapping: dict[str, str]) -> dict[str, str]:
    return {k: " ".join(v.split()) for k, v in mapping.items()}


def cleaning_steps(
    slang: dict[str, str] | DataFrame | None = None,
    stems: dict[str, str] | DataFrame | None = None,
    lowercase: bool = True,
) -> list[Callable[[Column], Column] | DataFrame]:
    """The chain in its fixed order, each rule guarded where a cheap test exists; a
    dictionary given as a table stands for its lookup."""
    steps: list[Callable[[Column], Column] | DataFrame] = [
        normalize_unicode,
        _guarded(lambda t: _has(t, "<") & _has(t, ">"), strip_html),
        _guarded(lambda t: ~_is_ascii(t) & t.rlike(r"[\x{200d}-\x{10ffff}]"), strip_emoji),
        _guarded(lambda t: _has(t, "://", "www."), strip_urls),
        _guarded(lambda t: _has(t, "@", "#"), strip_mentions),
        collapse_repeats,
        _guarded(lambda t: _has(t, *PUNCTUATION_PAIRS), collapse_punctuation),
    ]
    if lowercase:
        steps.append(F.lower)
    if isinstance(slang, DataFrame):
        steps.append(slang)
    else:
        steps.append(lambda t: normalize_slang(t, _one_space(slang or {}), lowered=lowercase))
    steps.append(_tidy)
    if isinstance(stems, DataFrame):
        steps.append(stems)
    elif stems:
        steps.append(lambda t: normalize_slang(t, _one_space(stems)))
    return steps


def clean_reviews(
    df: DataFrame,
    text_col: str = "review_text",
    out_col: str = "clean_text",
    slang: dict[str, str] | DataFrame | None = None,
    stems: dict[str, str] | DataFrame | None = None,
    lowercase: bool = True,
    stats: bool = False,
    key: str = "review_id",
) -> DataFrame:
    """Run the whole cleaning chain; ``stats`` adds the three text counts.

    ``stems`` is the statistics profile: a token-to-stem table applied to the
    cleaned words. A dictionary is a dict, which becomes literals of the plan, or a table
    of ``term`` and ``replacement``, which is joined by ``key``, unique in ``df``; the
    text is the same. The result is computed once per row however often later filters
    and expressions use it.
    """
    step_col = "__cleaning"
    work = df.withColumn(step_col, F.coalesce(F.col(text_col), F.lit("")))
    for step in cleaning_steps(slang, stems, lowercase):
        if isinstance(step, DataFrame):
            tidy = step.withColumn("replacement", normalize_space(F.col("replacement")))
            work = replace_words_join(work, tidy, key, step_col, step_col)
        else:
            work = work.withColumn(step_col, step(F.col(step_col)))
    text = F.col(step_col)
    added = {out_col: text}
    if stats:
        blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
        added["char_count"] = char_count(text)
        added["word_count"] = F.when(text == "", F.lit(0)).otherwise(blanks + 1)
        added["sent_count"] = sent_count(text)
    return evaluate_once(work, added).drop(step_col)

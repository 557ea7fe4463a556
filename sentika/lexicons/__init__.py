"""Lexicons: what to look for in a review, given by the user as tables.

A lexicon table has the columns ``kind, label, term, ord, replacement``; kinds are
``aspect`` (label = aspect), ``polarity`` (label = positive / negative), ``slang``
and ``stem`` (term -> replacement). ``ord`` fixes the order of aspects and terms.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentika.schemas import LEXICON

# Label names and the ids used by models and metrics.
GENERAL = "GENERAL"
POSITIVE, NEUTRAL, NEGATIVE = "Positif", "Netral", "Negatif"
SENTIMENTS = (POSITIVE, NEUTRAL, NEGATIVE)
SENTIMENT_IDS = {POSITIVE: 0, NEUTRAL: 1, NEGATIVE: 2}


@dataclass(frozen=True)
class Lexicon:
    aspects: Mapping[str, Sequence[str]]
    positive: Sequence[str] = ()
    negative: Sequence[str] = ()
    slang: Mapping[str, str] = field(default_factory=dict)
    stems: Mapping[str, str] = field(default_factory=dict)

    @property
    def aspect_names(self) -> list[str]:
        return list(self.aspects)

    @property
    def labels(self) -> list[str]:
        """Every label a review can carry, the general one last."""
        return [*self.aspects, GENERAL]

    @classmethod
    def from_table(cls, table: DataFrame, max_rows: int = 100_000) -> "Lexicon":
        """Read a lexicon table into the driver, where it becomes literals of the plan.

        Tables of any size can stay tables: ``clean_reviews`` joins slang and stems, and
        ``dictionary_scan.label_reviews_by_table`` finds aspects and polarity with the same counts.
        A table of more than ``max_rows`` rows is therefore not read.
        """
        read = table.select(*LEXICON.fieldNames()).limit(max_rows + 1).collect()
        if len(read) > max_rows:
            raise ValueError("too large for literals: label with dictionary_scan.label_reviews_by_table")
        rows = sorted(read, key=lambda r: r.ord)
        aspects: dict[str, list[str]] = {}
        polarity: dict[str, list[str]] = {"positive": [], "negative": []}
        slang, stems = {}, {}
        for r in rows:
            if r.kind == "aspect":
                aspects.setdefault(r.label, []).append(r.term)
            elif r.kind == "polarity":
                polarity[r.label].append(r.term)
            elif r.kind == "slang":
                slang[r.term] = r.replacement or ""
            elif r.kind == "stem":
                stems[r.term] = r.replacement or ""
            else:
                raise ValueError(f"unknown lexicon kind {r.kind!r}")
        return cls(aspects, polarity["positive"], polarity["negative"], slang, stems)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [("aspect", a, t, None) for a, terms in self.aspects.items() for t in terms]
        rows += [("polarity", "positive", t, None) for t in self.positive]
        rows += [("polarity", "negative", t, None) for t in self.negative]
        rows += [("slang", None, t, r) for t, r in self.slang.items()]
        rows += [("stem", None, t, r) for t, r in self.stems.items()]
        data = [(kind, label, t, i, r) for i, (kind, label, t, r) in enumerate(rows)]
        return spark.createDataFrame(data, LEXICON)

    def unreachable_terms(self) -> list[tuple[str, str]]:
        """Terms the cleaning chain can never leave in a text, with the reason.

        A run of three equal characters is shortened before the slang lookup, and
        a word the slang table rewrites is gone before the labels are matched.
        """
        found = []
        for key in self.slang:
            if any(a == b == c for a, b, c in zip(key, key[1:], key[2:])):
                found.append((key, "slang key has a run the cleaning shortens"))
        terms = [t for ts in self.aspects.values() for t in ts]
        for term in [*terms, *self.positive, *self.negative]:
            if self.slang.get(term.lower(), term).lower() != term.lower():
                found.append((term, "rewritten by the slang table"))
        return found


def lexicon_terms(table: DataFrame, kind: str) -> DataFrame:
    """The (label, term) rows of one kind with the term in lower case."""
    return table.where(F.col("kind") == kind).select("label", F.lower("term").alias("term"))

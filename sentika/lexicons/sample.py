"""Small lexicon for the synthetic sample tables, plus their stop words."""

from __future__ import annotations

from sentika.lexicons import Lexicon


def sample_lexicon() -> Lexicon:
    """Has phrases, a term in two aspects, and a term that starts a longer phrase."""
    return Lexicon(
        aspects={
            "EFFICIENCY": ["thing", "ering", "of the", "des"],
            "SYSTEM_AVAILABILITY": ["thnt", "erre", "erat", "und die"],
            "FULFILLMENT": ["thou", "ersh", "que"],
            "PRIVACY": ["onan", "anon", "ering", "que la"],
        },
        positive=["than", "then", "with the", "est"],
        negative=[
            "trash", "idiot", "moron", "stupid", "pathetic", "worthless",
            "disgusting", "loser", "ther", "not", "nicht", "pas",
        ],
        slang={
            "thnt": "thing", "esen": "des", "hein": "not ok", "inan": "than",
            "ouè": "", "sch": "", "la": "la", "erer": "ERAT", "anan": "que  la",
        },
        stems={"thing": "th", "ering": "er", "thou": "th", "queque": "que", "reau": "eau"},
    )


# Frequent function words per language, used to guess the language of a text.
LANGUAGE_PROFILES = {
    "de": ["der", "die", "das", "und", "nicht", "ist", "für", "ein", "den", "von", "zu", "mit", "auch", "im"],
    "en": ["the", "and", "of", "to", "in", "is", "that", "it", "for", "with", "was", "this", "you", "are"],
    "es": ["el", "los", "las", "del", "que", "y", "es", "una", "por", "con", "para", "como", "en", "la"],
    "fr": ["le", "les", "des", "et", "est", "dans", "pour", "une", "pas", "que", "qui", "avec", "sur", "la"],
    "id": ["yang", "dan", "di", "tidak", "ini", "itu", "untuk", "dengan", "saya", "bisa", "sudah", "juga"],
}

STOP_WORDS = sorted({w for ws in LANGUAGE_PROFILES.values() for w in ws})

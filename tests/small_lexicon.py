"""A small lexicon of app reviews, for tests."""

from sentika.lexicons import Lexicon

SMALL = Lexicon(
    {
        "EASE": ["easy", "clear menu", "quick"],
        "UPTIME": ["crash", "offline", "will not open", "locked out"],
        "DELIVERY": ["arrived", "refund", "clear menu"],
        "TRUST": ["safe", "pin", "face-id", "locked out"],
    },
    ["great", "very good", "thanks"],
    ["awful", "not good", "angry"],
    {"gr8": "great", "thx": "thanks", "krash": "crash", "zzz": "", "offlinee": "offline", "looove": "love", "quick": "fast"},
)

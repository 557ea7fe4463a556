"""Rows of the tests: the cases every operator must handle."""

from __future__ import annotations

CLASH = "id, key, tokens, budget, copies, shard, slot, size, vslot, text_key, h, bucket, block, c, n, label, sha, spans, kept, _id, _row"


def documents(spark, rows):
    """Rows of (doc_id, text) as documents with every other column, and extra ones with names used inside."""
    full = [(i, t, "en" if k % 2 else None, f"src{k % 3}" if k % 4 else None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASH.split(", "):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


WORDS = [f"w{k}" for k in range(400)]
BASE = " ".join(WORDS[:60])
NEAR = " ".join([*WORDS[:58], "other", "end"])
FAR = " ".join(WORDS[100:160])
LONG = " ".join(WORDS[k % 397] for k in range(60_000))
#: Nulls, empties, ties, repeated rows, rows without an id, and a very long text.
ROWS = [
    (1, BASE), (2, NEAR), (3, BASE), (3, BASE), (4, None), (5, ""), (6, " \t\n"), (7, FAR), (None, BASE), (None, None),
    (8, "one two"), (9, "one  two"), (10, LONG), (11, "é" * 30), (12, "password: abcdefghijkl0 AKIA12345678901234 0123456789abcdef0"),
    (13, "PASSWORD = \"secret=token: abcdefghijklmnop"), (-5, "Tail."),
]

"""Fitted language model: counts, weights and guesses against plain Python, edges, saving."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sentika.operators import languages as G

TEXTS = {
    "en": ["the cat and the dog", "that THE other then 42 there"],
    "de": ["der Hund und die Katze", "das ist über ßtraße"],
}
CONFIG = G.LanguageConfig(n=3, max_runs=20, margin=0.05)


def runs(text: str) -> list[str]:
    plain = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    padded = f" {plain} " if plain else ""
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(lang, t) for lang, ts in TEXTS.items() for t in ts]
    return spark.createDataFrame([*rows, (None, "mystery words"), ("en", None), ("de", " ... 12")], "lang string, clean_text string")


@pytest.fixture(scope="module")
def model(labelled):
    return G.fit_languages(labelled, config=CONFIG)


def brute(text: str) -> dict[str, float]:
    counts = {lang: Counter(r for t in ts for r in runs(t)) for lang, ts in TEXTS.items()}
    kept = {r for c in counts.values() for r, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:20]}
    return {
        lang: sum(math.log(((c[r] if r in kept else 0) + 1) / (sum(c.values()) + len(kept) + 1)) for r in runs(text))
        for lang, c in counts.items()
    }


def test_counts_equal_python(labelled):
    got = {(r.lang, r.run): r.n for r in G.run_counts(labelled).collect()}
    assert got == {(lang, r): n for lang, ts in TEXTS.items() for r, n in Counter(x for t in ts for x in runs(t)).items()}


def test_guesses_equal_python(spark, model):
    texts = ["the dog there", "die Katze über dem Haus", "zzz qqq", "x", "", None, "!!! 1", "the " * 20_000 + "und", "\U0001f600 und 𝒳 der"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, clean_text string")
    for r in model.detect(rows, out_col="guess").collect():
        scores, n = brute(r.clean_text or ""), len(runs(r.clean_text or ""))
        if not n:
            assert (r.guess, r.guess_margin) == ("unknown", None)
            continue
        best, second = sorted(scores, key=lambda x: -scores[x])
        margin = (scores[best] - scores[second]) / n
        assert r.guess_margin == pytest.approx(margin, abs=1e-9)
        assert r.guess == (best if margin >= CONFIG.margin else "unknown"), r.clean_text[:30]


def test_saved_model_guesses_alike(spark, model, labelled, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    again = G.LanguageModel.load(spark, str(tmp_path / "m"), CONFIG)
    want, got = (sorted(map(str, m.detect(labelled, out_col="g").collect())) for m in (model, again))
    assert want == got


def test_edges(spark, labelled, model):
    with pytest.raises(ValueError):
        G.fit_languages(labelled.where("lang IS NULL"), config=CONFIG)
    one = G.fit_languages(labelled.where("lang = 'en'"), config=CONFIG)
    assert {(r.g, r.g_margin) for r in one.detect(labelled.where("clean_text LIKE '%und%'"), out_col="g").collect()} == {("en", None)}
    empty = model.detect(labelled.where("false"), out_col="lang")
    assert empty.columns == ["clean_text", "lang", "lang_margin"] and empty.count() == 0


def test_quality_counts(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "unknown"), (None, "a"), ("b", "b")], "lang string, guess string")
    assert sorted(map(tuple, G.detection_quality(rows).collect())) == [("a", 3, 1, 1), ("b", 1, 1, 0)]


def test_held_out_accuracy(spark):
    from sentika.plans import catalog

    n, right = catalog.fitted_language_quality(spark, "/root/testdata/sf0.01").agg(F.sum("n"), F.sum("n_right")).first()
    assert n > 100 and right / n > 0.9


def test_runs_are_counted_some_at_a_time(monkeypatch):
    """The counts do not depend on how many runs a task holds, and it holds few."""
    import numpy as np
    import pyarrow as pa

    texts = [f" wort {'ab' * (k % 7)} text " for k in range(200)]
    batch = pa.record_batch([pa.array(["de", "en"] * 100), pa.array(texts)], ["lang", "text"])
    tell = lambda: {(r["lang"], r["run"]): r["n"] for b in G._counting(3)([batch]) for r in b.to_pylist()}
    whole, longest, unique = tell(), [], np.unique
    monkeypatch.setattr(G, "_HELD", 50)
    monkeypatch.setattr(G.np, "unique", lambda x, **k: longest.append(len(x)) or unique(x, **k))
    assert tell() == whole and max(longest) < 200

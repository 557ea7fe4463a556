from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentika.lexicons import Lexicon, lexicon_terms
from sentika.lexicons.sample import LANGUAGE_PROFILES, sample_lexicon
from sentika.operators import distributions as D
from sentika.operators import lookups as J
from sentika.operators import metrics as M
from sentika.operators import regression as R
from sentika.operators import selection as S

ASPECTS = ["A", "B"]


@pytest.fixture(scope="module")
def labeled(spark):
    rng = np.random.default_rng(3)
    moods = ["Positif", "Netral", "Negatif"]
    rows = []
    for i in range(400):
        aspects = [a for a in ASPECTS if rng.random() < 0.5] or ["GENERAL"]
        stars = None if i % 13 == 0 else int(rng.integers(1, 6))
        rows.append((f"r{i}", i, stars, aspects, moods[int(rng.integers(0, 3))]))
    df = spark.createDataFrame(rows, "review_id string, pos long, rating int, aspects array<string>, sentiment_rule string")
    return df, rows


# ---- selection --------------------------------------------------------------

def test_dedup_keeps_the_first_of_a_hot_key(spark):
    df = spark.range(0, 9000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (-F.col("id")).alias("o")
    )
    out = S.dedup_keep_first(df, "k", ["o"])
    assert out.count() == 6001
    assert out.where("k = 'hot'").first().o == -8997
    plan = out._jdf.queryExecution().executedPlan().toString()
    before_shuffle = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle  # rows are dropped ahead of the shuffle


def test_dedup_treats_null_keys_as_one(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, o int")
    assert sorted(r.o for r in S.dedup_keep_first(df, "k", ["o"]).collect()) == [1, 3]


@pytest.mark.parametrize("n", [0, 1, 4, 5, 17, 1000])
def test_ordinals_and_contiguous_folds(spark, n):
    df = spark.range(0, n, 1, 7).select(F.xxhash64("id").alias("key"))
    order = sorted(r.key for r in df.collect())
    got = {r.key: r.ordinal for r in S.dense_ordinal(df, ["key"]).collect()}
    assert got == {k: i for i, k in enumerate(order)}
    folds = {r.key: r.fold for r in S.kfold_contiguous(df, ["key"]).collect()}
    want = [f for f, part in enumerate(np.array_split(np.arange(n), 5)) for _ in part]
    assert [folds[k] for k in order] == want


def test_hashed_folds_and_splits_are_stable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("review_id"))
    assert sorted({r.fold for r in S.kfold_hashed(df, "review_id").collect()}) == [0, 1, 2, 3, 4]
    first = {r.review_id: r.split for r in S.train_val_test_split(df).collect()}
    again = {r.review_id: r.split for r in S.train_val_test_split(df.repartition(13)).collect()}
    assert first == again
    sizes = Counter(first.values())
    assert sum(sizes.values()) == 5000
    assert abs(sizes["train"] / 5000 - 0.70) < 0.03 and abs(sizes["val"] / 5000 - 0.15) < 0.03


def test_stratified_sample_sizes(spark, labeled):
    df, rows = labeled
    sample = S.stratified_sample(df, n=200).collect()
    per = Counter(r.rating for r in sample)
    have = Counter(r[2] for r in rows if r[2] is not None)
    assert per == {k: min(v, 40) for k, v in have.items()}
    assert len({r.review_id for r in sample}) == len(sample)


def test_samples_are_the_first_rows_in_hash_order(spark):
    import hashlib

    rows = [(str(i), i % 3 if i % 7 else 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, g int").repartition(11)
    digest = lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest()
    order = sorted(rows, key=lambda r: digest(r[0]))
    for n in (1, 7, 200, 2999, 3000, 9000):
        assert [r.k for r in S.random_sample(df, n, "k").collect()] == [k for k, _ in order[:n]]
    want = {k for g in range(3) for k in [k for k, h in order if h == g][:20]}
    assert {r.k for r in S.stratified_sample(df, 60, "g", "k", groups=3).collect()} == want
    assert S.random_sample(df.where("false"), 5, "k").count() == 0


def test_random_sample_is_reproducible(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    one = [r.k for r in S.random_sample(df, 50, "k").collect()]
    assert one == [r.k for r in S.random_sample(df.repartition(9), 50, "k").collect()]
    assert len(S.random_sample(df, 5000, "k").collect()) == 1000


@pytest.mark.parametrize("sizes", [{"a": 5}, {"a": 10, "b": 3}, {"a": 700, "b": 199, "c": 1}])
def test_oversampling_levels_every_class(spark, sizes):
    rows = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "id string, label string")
    out = S.oversample_minority(df, "label", "id").collect()
    largest = max(sizes.values())
    assert Counter(r.label for r in out) == {c: largest for c in sizes}
    copies = Counter((r.label, r.id) for r in out)
    for c, n in sizes.items():
        each = sorted(v for (label, _), v in copies.items() if label == c)
        assert len(each) == n and each[-1] - each[0] <= 1


def test_filter_audit_counts_once(spark):
    df = spark.range(100)
    audit = S.filter_audit(df, {"even": F.col("id") % 2 == 0, "small": F.col("id") < 10, "null": F.lit(None).cast("boolean")})
    rows = [(r["filter"], r.rows_before, r.rows_after, r.rows_removed) for r in audit.orderBy("step").collect()]
    assert rows == [("even", 100, 50, 50), ("small", 50, 5, 45), ("null", 5, 0, 5)]


def test_shapes(spark):
    df = spark.createDataFrame([("1", "hi", None, "x")], "reviewId string, content string, score int, extra string")
    assert S.conform_schema(df).columns == ["review_id", "review_text", "rating", "extra"]
    filled = S.fill_defaults(S.conform_schema(df), {"rating": 3, "sentiment_rule": "Netral"}).first()
    assert (filled.rating, filled.sentiment_rule) == (3, "Netral")
    projected = S.annotation_projection(S.conform_schema(df))
    assert projected.columns[:3] == ["review_id", "review_text", "rating"] and projected.columns[-1] == "notes"


# ---- distributions ----------------------------------------------------------

def test_distributions_equal_python(spark, labeled):
    df, rows = labeled
    dist = {r.aspect: (r.n, r.percentage) for r in D.aspect_distribution(df, ["A", "B", "C", "GENERAL"]).collect()}
    for a in ["A", "B", "C", "GENERAL"]:
        n = sum(a in r[3] for r in rows)
        assert dist[a] == (n, pytest.approx(100 * n / len(rows)))
    shares = D.aspect_sentiment_pct(df, [*ASPECTS, "C"]).collect()
    assert len(shares) == 9
    for r in shares:
        inside = [x[4] for x in rows if r.aspect in x[3]]
        assert r.n == inside.count(r.sentiment)
        assert r.pct == pytest.approx(100 * r.n / len(inside) if inside else 0)
    wide = D.aspect_ratio_features(df, [*ASPECTS, "C"]).first()
    scores = [{"Positif": 1, "Negatif": -1}.get(x[4], 0) for x in rows if "A" in x[3]]
    assert wide.A_score == pytest.approx(np.mean(scores)) and wide.C_score == 0


def test_distribution_of_nothing(spark, labeled):
    empty = labeled[0].where("false")
    assert [(r.n, r.percentage) for r in D.aspect_distribution(empty, ["A"]).collect()] == [(0, 0.0)]
    assert {(r.n, r.pct) for r in D.aspect_sentiment_pct(empty, ["A"]).collect()} == {(0, 0.0)}


def test_class_weights(spark, labeled):
    df, rows = labeled
    got = {r.sentiment_id: (r.n, r.weight) for r in D.class_weights(df, ASPECTS).collect()}
    ids = {"Positif": 0, "Netral": 1, "Negatif": 2}
    counts = Counter(ids[r[4]] for r in rows for a in r[3] if a in ASPECTS)
    raw = np.array([1 / (counts[c] + 1e-9) for c in range(3)])
    assert [got[c][0] for c in range(3)] == [counts[c] for c in range(3)]
    assert [got[c][1] for c in range(3)] == pytest.approx(list(raw / raw.sum()))
    assert sum(w for _, w in got.values()) == pytest.approx(1)


def test_word_count_summary(spark):
    df = spark.createDataFrame([(i,) for i in [3, 3, 4, 10, 20, 5]], "word_count int")
    row = D.word_count_summary(df).first()
    assert (row.total, row.mean_words, row.median_words) == (6, 7.5, 4.5)


# ---- lookups ----------------------------------------------------------------

def test_dictionary_join_equals_inline_lookup(spark):
    from sentika.functions.text import normalize_slang

    slang = {"gak": "tidak", "sih": "", "tf": "transfer uang"}
    texts = ["Gak bisa TF sih", "", "sih", None, "  a\tgak\n", "x " * 50 + "tf"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    table = spark.createDataFrame(list(slang.items()), "term string, replacement string")
    joined = J.replace_words_join(df, table, "id", "t", "out").orderBy("id").collect()
    inline = df.select("id", F.coalesce(normalize_slang(F.col("t"), slang), F.lit("")).alias("out")).orderBy("id").collect()
    assert [r.out for r in joined] == [r.out for r in inline]


def test_lexicon_join_equals_patterns(spark):
    from sentika.functions.labels import lexicon_hits

    lexicon = sample_lexicon()
    texts = ["of the thing", "of, the", "que la", "Ering-onan", "und  die", "und die", "", None, "thing thing thou"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    lengths = [J.piece_count(t) for ts in lexicon.aspects.values() for t in ts]
    terms = lexicon_terms(lexicon.to_table(spark), "aspect")
    got = {(r.id, r.aspect) for r in J.lexicon_match_join(df, terms, lengths, "id", "t").collect()}
    counted = lexicon_hits(df, lexicon, "t").collect()
    assert got == {(r.id, a) for r in counted for i, a in enumerate(lexicon.aspects) if r[f"hits_{i}"] > 0}


def test_language_guess_on_the_sample(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 200")
    guess = J.detect_language(df, LANGUAGE_PROFILES, "text", "guess")
    right = guess.agg(F.avg((F.col("guess") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.9
    odd = spark.createDataFrame([("",), (None,), ("zzz",)], "clean_text string")
    assert {r.lang for r in J.detect_language(odd, LANGUAGE_PROFILES).collect()} == {"unknown"}


def test_terms_and_top_k(spark):
    df = spark.createDataFrame(
        [(["A", "B"], "b b a"), (["A"], "a c"), (["B"], "the")], "aspects array<string>, clean_text string"
    )
    counts = J.term_frequencies(df, ["the"])
    assert {(r.aspect, r.term): r.n for r in counts.collect()} == {
        ("A", "b"): 2, ("A", "a"): 2, ("A", "c"): 1, ("B", "b"): 2, ("B", "a"): 1,
    }
    top = J.top_terms_per_group(counts, "aspect", 2).collect()
    assert {(r.aspect, r.term, r["rank"]) for r in top} == {("A", "a", 1), ("A", "b", 2), ("B", "b", 1), ("B", "a", 2)}


# ---- metrics ----------------------------------------------------------------

@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(300):
        for a in ASPECTS:
            at, ap = int(rng.random() < 0.4), int(rng.random() < 0.5)
            rows.append((a, at, ap, int(rng.integers(0, 2)) if at else -1, int(rng.integers(0, 3))))
    schema = "aspect string, aspect_true int, aspect_pred int, sentiment_true int, sentiment_pred int"
    return spark.createDataFrame(rows, schema), rows


def binary_f1(true, pred):
    tp = sum(t and p for t, p in zip(true, pred))
    total = sum(true) + sum(pred)
    return 2 * tp / total if total else 0.0


def test_f1_scores_equal_python(spark, predictions):
    df, rows = predictions
    aspect = [binary_f1([r[1] for r in rows if r[0] == a], [r[2] for r in rows if r[0] == a]) for a in ASPECTS]
    assert M.aspect_f1_macro(df).first()[0] == pytest.approx(np.mean(aspect))
    mood = {}
    for a in ASPECTS:
        known = [(r[3], r[4]) for r in rows if r[0] == a and r[3] != -1]
        classes = {c for pair in known for c in pair}
        mood[a] = np.mean([binary_f1([t == c for t, _ in known], [p == c for _, p in known]) for c in classes])
    got = {r.aspect: r.sentiment_f1 for r in M.sentiment_f1_per_aspect(df).collect()}
    assert got == {a: pytest.approx(v) for a, v in mood.items()}
    both = M.combined_f1(df).first()
    assert M.combined_f1(M.outcome_counts(df)).first() == both
    assert both.sentiment_f1_avg == pytest.approx(np.mean([round(v, 4) for v in mood.values()]))
    assert both.combined_f1 == pytest.approx((both.aspect_f1_macro + both.sentiment_f1_avg) / 2)


def test_confusion_rows_add_up(spark, predictions):
    df, rows = predictions
    cells = defaultdict(int)
    for a, _, _, t, p in rows:
        if t != -1:
            cells[a, t, p] += 1
    for r in M.confusion_matrix(df).collect():
        assert [r[f"n_{c}"] for c in range(3)] == [cells[r.aspect, r.sentiment_true, c] for c in range(3)]
        assert sum(r[f"rate_{c}"] for c in range(3)) == pytest.approx(1)


def test_no_support_gives_no_aspect(spark):
    df = spark.createDataFrame([("A", 0, 1, -1, 0)], "aspect string, aspect_true int, aspect_pred int, sentiment_true int, sentiment_pred int")
    assert M.sentiment_f1_per_aspect(df).count() == 0
    assert M.aspect_f1_macro(df).first()[0] == 0.0


def test_best_checkpoint_rules(spark):
    log = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, 0.0)], "epoch int, combined_f1 double")
    assert M.best_checkpoint(log).first().epoch == 2
    assert M.best_checkpoint(log.where("epoch = 4")).count() == 0


def test_log_loss_equals_python(spark):
    rows = [(1, 0.8, 0, [0.7, 0.2, 0.1]), (0, 0.3, -1, [0.1, 0.1, 0.8]), (1, 0.6, 2, [0.2, 0.2, 0.6])]
    df = spark.createDataFrame(rows, "aspect_true int, aspect_prob double, sentiment_true int, sentiment_probs array<double>")
    got = M.log_loss(df, (0.2, 0.3, 0.5)).first()
    bce = -np.mean([math.log(0.8), math.log(0.7), math.log(0.6)])
    ce = -(0.2 * math.log(0.7) + 0.5 * math.log(0.6)) / 0.7
    assert (got.aspect_loss, got.sentiment_loss) == (pytest.approx(bce), pytest.approx(ce))


def test_agreement(spark):
    df = spark.createDataFrame(
        [("A", "P", "A", "P"), ("A", "P", "B", "P"), ("A", "P", None, "P")],
        "aspect_annotator_1 string, sentiment_annotator_1 string, aspect_annotator_2 string, sentiment_annotator_2 string",
    )
    assert [r.agreement for r in M.annotator_agreement(df).collect()] == ["Y", "N", "N"]
    assert M.agreement_share(M.annotator_agreement(df)).first().agreement_share == pytest.approx(1 / 3)


# ---- regression -------------------------------------------------------------

def numpy_ridge(x, y, folds, alphas):
    """Closed-form twin on the full matrix."""
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1
    x = (x - mean) / spread

    def fit(x, y, alpha):
        xm, ym = x.mean(0), y.mean()
        coef = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
        return coef, ym - xm @ coef

    def r2(x, y, coef, b):
        return 1 - ((y - x @ coef - b) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    cv = [np.mean([r2(x[folds == f], y[folds == f], *fit(x[folds != f], y[folds != f], a)) for f in range(5)]) for a in alphas]
    best = int(np.argmax(cv))
    coef, b = fit(x, y, alphas[best])
    return coef, {"r2": r2(x, y, coef, b), "rmse": np.sqrt(((y - x @ coef - b) ** 2).mean()), "cv_r2": cv[best], "alpha": alphas[best]}


def test_ridge_equals_the_closed_form(spark, labeled):
    df, rows = labeled
    names = R.feature_names([*ASPECTS, "C"])  # C never occurs: constant columns
    table = S.kfold_contiguous(R.regression_table(df, [*ASPECTS, "C"], "pos"), ["pos"])
    coefs, metrics = R.ridge_cv(table, names)
    data = sorted(table.collect(), key=lambda r: r.pos)
    x = np.array([[r[n] for n in names] for r in data], float)
    want, scores = numpy_ridge(x, np.array([r.rating for r in data], float), np.array([r.fold for r in data]), R.ALPHAS)
    got = {r.feature: r.coefficient for r in coefs.collect()}
    assert [got[n] for n in names] == pytest.approx(list(want), abs=1e-9)
    assert metrics == {k: pytest.approx(v, abs=1e-9) for k, v in scores.items()}


def test_ridge_from_counted_rows(spark, labeled):
    df, _ = labeled
    table = S.kfold_hashed(R.regression_table(df, ASPECTS, "review_id"), "review_id")
    names = R.feature_names(ASPECTS)
    counted = table.groupBy("fold", "rating", *names).agg(F.count(F.lit(1)).alias("w"))
    one, two = R.ridge_cv(table, names)[1], R.ridge_cv(counted, names, weight="w")[1]
    assert one == {k: pytest.approx(v) for k, v in two.items()}


def test_standardize_and_ranking(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5)], "a double, b int")
    assert [(r.a, r.b) for r in R.standardize(df, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    coefs = spark.createDataFrame([("x", -3.0), ("y", 2.0), ("z", 3.0)], "feature string, coefficient double")
    assert [r.feature for r in R.coef_ranking(coefs, 2).collect()] == ["x", "z"]


def test_lexicon_without_terms(spark):
    from sentika.functions.labels import label_reviews

    df = spark.createDataFrame([("anything",)], "clean_text string")
    row = label_reviews(df, Lexicon({"A": []}), rating_col=None).first()
    assert (row.aspects, row.sentiment_rule) == (["GENERAL"], "Netral")


def test_a_broken_model_does_not_beat_the_constant(spark):
    from sentika.operators.models import beats_constant

    rows = [(i % 3, [0.8 if c == i % 3 else 0.1 for c in range(3)], [0.1 if c == i % 3 else 0.45 for c in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "label int, good array<double>, bad array<double>")
    row = df.agg(*[beats_constant(df, F.col("label"), F.col(c), 3).alias(c) for c in ("good", "bad")]).first()
    assert row.good and not row.bad

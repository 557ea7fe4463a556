"""Ridge regression of the rating on aspect features.

The data is scanned once for cross-products; the 50 x 5 candidate fits are then expressions
on rows that hold one small system each, whose size depends on the number of features only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentika.functions.labels import aspect_regression_features, coef_direction
from sentika.session import evaluate_once

# The penalty grid.
ALPHAS = tuple(np.logspace(-3, 3, 50))


def regression_table(labeled: DataFrame, aspects: Sequence[str], *keep: str) -> DataFrame:
    """Rating and the presence / sentiment features of every rated review."""
    features = aspect_regression_features(F.col("aspects"), F.col("sentiment_rule"), aspects)
    return labeled.where("rating is not null").select(
        *keep, "rating", *[c.alias(n) for n, c in features.items()]
    )


def feature_names(aspects: Sequence[str]) -> list[str]:
    return [f"{a}_{part}" for a in aspects for part in ("present", "sentiment")]


def gram_matrix(
    df: DataFrame, features: Sequence[str], target: str, fold: str, weight: str | None = None
) -> DataFrame:
    """Per fold: n, sums, and cross-products of features and target.

    Equal rows are counted first (``weight`` continues such a count); the features
    take few values, so the sums run over the few distinct rows.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    distinct = df.groupBy(fold, target, *features).agg(n.alias("__n"))
    w = F.col("__n")
    columns = [*features, target]
    sums: list[Column] = [F.sum(w).alias("n")]
    sums += [F.sum(w * F.col(c)).alias(f"s_{i}") for i, c in enumerate(columns)]
    sums += [
        F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"p_{i}_{j}")
        for i in range(len(columns))
        for j in range(i, len(columns))
    ]
    return distinct.groupBy(fold).agg(*sums)


def standardize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column is only centred.

    Reads the input twice, so pass a table or a checkpoint if it is costly to compute.
    """
    stats = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(features)],
        *[F.stddev_pop(c).alias(f"d_{i}") for i, c in enumerate(features)],
    ).first()
    scaled = {}
    for i, c in enumerate(features):
        mean, spread = stats[f"m_{i}"], stats[f"d_{i}"]
        scaled[c] = (F.col(c) - F.lit(mean or 0.0)) / F.lit(spread or 1.0)
    return df.withColumns(scaled)


def _at(array: Column, *places) -> Column:
    for i in places:
        array = F.get(array, i if isinstance(i, Column) else F.lit(i))
    return array


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def eliminated(matrix: Column, k: int) -> Column:
    """Solution of k equations, given as rows of k coefficients and the right side.

    One pivot after the other is cleared from all other rows, as an expression inside the row.
    Pivots are taken in order, so the coefficients must be positive definite.
    """

    def clear(m: Column, i: Column) -> Column:
        pivot = F.transform(_at(m, i), lambda x: x / _at(m, i, i))
        others = lambda row: F.zip_with(row, pivot, lambda x, y: x - _at(row, i) * y)
        return F.transform(m, lambda row, r: F.when(r == i, pivot).otherwise(others(row)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), matrix, clear)
    return F.transform(done, lambda row: _at(row, k))


def _moments(gram: DataFrame, fold: str, width: int) -> DataFrame:
    """One row: ``folds``, the moments n, s, p of every fold in order, and ``whole``, their sum."""
    s = F.array(*[F.col(f"s_{i}").cast("double") for i in range(width)])
    p = F.array(
        *[F.array(*[F.col(f"p_{min(i, j)}_{max(i, j)}").cast("double") for j in range(width)]) for i in range(width)]
    )
    folds = gram.agg(F.array_sort(F.collect_list(F.struct(F.col(fold).alias("fold"), F.col("n").cast("double").alias("n"), s.alias("s"), p.alias("p")))).alias("folds"))
    zeros = F.array_repeat(F.lit(0.0), width)
    vectors = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    return folds.select(
        "folds",
        F.struct(
            F.aggregate("folds", F.lit(0.0), lambda a, f: a + f["n"]).alias("n"),
            F.aggregate("folds", zeros, lambda a, f: vectors(a, f["s"])).alias("s"),
            F.aggregate("folds", F.array_repeat(zeros, width), lambda a, f: F.zip_with(a, f["p"], vectors)).alias("p"),
        ).alias("whole"),
    )


def _scaled(m: Column, mean: Column, spread: Column) -> Column:
    """Moments of the columns after centring and scaling them."""
    n, s, p = m["n"], m["s"], m["p"]
    cell = lambda x, i, j: x - _at(s, i) * _at(mean, j) - _at(mean, i) * _at(s, j) + n * _at(mean, i) * _at(mean, j)
    return F.struct(
        n.alias("n"),
        F.transform(s, lambda x, i: (x - n * _at(mean, i)) / _at(spread, i)).alias("s"),
        F.transform(
            p, lambda row, i: F.transform(row, lambda x, j: cell(x, i, j) / (_at(spread, i) * _at(spread, j)))
        ).alias("p"),
    )


def _minus(a: Column, b: Column) -> Column:
    less = lambda x, y: F.zip_with(x, y, lambda u, v: u - v)
    return F.struct(
        (a["n"] - b["n"]).alias("n"), less(a["s"], b["s"]).alias("s"), F.zip_with(a["p"], b["p"], less).alias("p")
    )


def _squared_error(m: Column, k: int) -> Column:
    """Sum of squared residuals of ``coef`` and ``intercept`` on rows with the moments m."""
    v = F.concat(F.transform("coef", lambda c: -c), F.array(F.lit(1.0)))
    quadratic = _dot(v, F.transform(m["p"], lambda row: _dot(row, v)))
    return quadratic - 2 * F.col("intercept") * _dot(v, m["s"]) + m["n"] * F.col("intercept") ** 2


def _r2(m: Column, k: int) -> Column:
    total = _at(m["p"], k, k) - F.try_divide(_at(m["s"], k) * _at(m["s"], k), m["n"])
    return 1 - F.try_divide(F.col("error"), F.when(total > 1e-9, total))


def ridge_fits(gram: DataFrame, features: Sequence[str], fold: str = "fold", alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """``alpha, fold, coef, intercept, r2, rmse`` of every penalty: without each fold, scored on
    that fold, and (fold null) on all rows, scored on them.

    Features are standardised by all rows, and a constant one is only centred. Every row holds
    its own system and solves it by :func:`eliminated`. R2 is null where the scored ratings are
    all equal. ``alphas`` must be positive.
    """
    if min(alphas) <= 0:
        raise ValueError("penalties must be positive")
    k = len(features)
    one = _moments(gram, fold, k + 1)
    whole = F.col("whole")
    mean = F.transform(whole["s"], lambda x, i: F.when(i == k, 0.0).otherwise(F.try_divide(x, whole["n"])))
    one = evaluate_once(one, {"mean": mean})
    variance = lambda i: F.try_divide(_at(whole["p"], i, i), whole["n"]) - _at("mean", i) ** 2
    spread = F.transform(
        whole["s"], lambda x, i: F.when((i == k) | (variance(i) < 1e-24), 1.0).otherwise(F.sqrt(F.greatest(variance(i), F.lit(0.0))))
    )
    one = evaluate_once(one, {"spread": spread})
    scaled = lambda m: _scaled(m, F.col("mean"), F.col("spread"))
    one = evaluate_once(one, {"all": scaled(whole), "parts": F.transform("folds", lambda m: F.struct(m["fold"].alias("fold"), scaled(m).alias("m")))})
    left_out = F.transform("parts", lambda f: F.struct(f["fold"].alias("fold"), _minus(F.col("all"), f["m"]).alias("fit"), f["m"].alias("score")))
    nothing = F.get("parts", F.lit(0))["fold"]
    every = F.struct(F.when(F.lit(False), nothing).alias("fold"), F.col("all").alias("fit"), F.col("all").alias("score"))
    parts = one.select(F.inline(F.concat(left_out, F.array(every))))
    rows = parts.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))

    fit = F.col("fit")
    shared = lambda x, i, j: x - F.try_divide(_at(fit["s"], i) * _at(fit["s"], j), fit["n"])
    penalty = lambda i, j: F.when(i == j, F.col("alpha")).otherwise(0.0)
    system = F.transform(
        F.slice(fit["p"], 1, k), lambda row, i: F.transform(row, lambda x, j: shared(x, i, j) + penalty(i, j))
    )
    rows = evaluate_once(rows, {"coef": eliminated(system, k)})
    slope = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda t, i: t + _at(fit["s"], i) * _at("coef", i))
    rows = evaluate_once(rows, {"intercept": F.try_divide(_at(fit["s"], k) - slope, fit["n"])})
    rows = evaluate_once(rows, {"error": _squared_error(F.col("score"), k)})
    rmse = F.sqrt(F.greatest(F.try_divide(F.col("error"), F.col("score")["n"]), F.lit(0.0)))
    return rows.select("alpha", "fold", "coef", "intercept", _r2(F.col("score"), k).alias("r2"), rmse.alias("rmse"))


def ridge_table(
    df: DataFrame,
    features: Sequence[str],
    target: str = "rating",
    fold: str = "fold",
    alphas: Sequence[float] = ALPHAS,
    weight: str | None = None,
) -> DataFrame:
    """Standardise, choose alpha by mean R2 over the folds (the smallest of equals), refit on all rows.

    One row per feature: feature, coefficient, abs_coef, direction, and on each of them
    r2, rmse, cv_r2 and alpha. Folds without an R2 are left out of the mean; without any such
    fold, as of one fold or of none, there is no row. One aggregation over the data; the fits
    are expressions on a row for each penalty and fold.
    """
    fits = ridge_fits(gram_matrix(df, features, target, fold, weight), features, fold, alphas)
    whole = F.struct("coef", "r2", "rmse")
    scored = fits.groupBy("alpha").agg(
        F.avg(F.when(F.col("fold").isNotNull(), F.col("r2"))).alias("cv_r2"),
        F.first(F.when(F.col("fold").isNull(), whole), ignorenulls=True).alias("whole"),
    )
    best = scored.where("cv_r2 is not null").orderBy(F.desc("cv_r2"), "alpha").limit(1)
    named = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("whole.coef").alias("coefficient"))
    rows = best.select(F.inline(named), "whole.r2", "whole.rmse", "cv_r2", "alpha")
    c = F.col("coefficient")
    return rows.select("feature", c, F.abs(c).alias("abs_coef"), coef_direction(c).alias("direction"), "r2", "rmse", "cv_r2", "alpha")


#: What is known of a regression besides its coefficients.
MEASURES = ("r2", "rmse", "cv_r2", "alpha")


def ridge_cv(
    df: DataFrame,
    features: Sequence[str],
    target: str = "rating",
    fold: str = "fold",
    alphas: Sequence[float] = ALPHAS,
    weight: str | None = None,
) -> tuple[DataFrame, dict[str, float]]:
    """:func:`ridge_table` computed: the coefficient table (feature, coefficient, abs_coef,
    direction) and the metrics r2, rmse, cv_r2, alpha."""
    table = ridge_table(df, features, target, fold, alphas, weight)
    rows = table.collect()  # one row per feature
    if not rows:
        raise ValueError("cross-validation needs rated rows in at least two folds")
    coefs = df.sparkSession.createDataFrame(rows, table.schema).drop(*MEASURES)
    return coefs, {name: rows[0][name] for name in MEASURES}


def coef_ranking(coefs: DataFrame, k: int = 10) -> DataFrame:
    """The k coefficients of largest size, by name on ties."""
    return coefs.orderBy(F.desc(F.abs("coefficient")), "feature").limit(k)


def univariate_slopes(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Least-squares slope of the target on each feature alone (0 for a constant)."""
    slopes = df.agg(*[F.regr_slope(target, c).alias(c) for c in features])
    rows = [
        F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("coefficient"))
        for c in features
    ]
    return slopes.select(F.inline(F.array(*rows)))

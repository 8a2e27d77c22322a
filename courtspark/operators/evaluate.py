"""Evaluation of probabilistic predictions: metrics, reliability, folds, calibration, models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rank-gap buckets, calibration threshold.
GAPS = [("0_50", 0, 50), ("50_200", 50, 200), ("200_inf", 200, 10_000)]
ISOTONIC_LEAST = 1000


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))


def metrics(df: DataFrame, label: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    """n, Brier score, log loss and accuracy, in one aggregate."""
    y, p = F.col(label).cast("double"), _clipped(F.col(probability))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(p - y, 2)).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"), F.avg(((p >= 0.5).cast("double") == y).cast("double")).alias("accuracy")
    )


def accuracy_by_gap(df: DataFrame, label: str, probability: str, gap: str) -> DataFrame:
    """Accuracy per bucket of the absolute rank gap; a bucket without rows has null."""
    g = F.abs(F.col(gap))
    bucket = F.coalesce(*[F.when((g >= lo) & (g < hi), name) for name, lo, hi in GAPS])
    hit = ((F.col(probability) >= 0.5).cast("int") == F.col(label)).cast("double")
    got = df.withColumn("bucket", bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
    names = df.sparkSession.createDataFrame([(n,) for n, _, _ in GAPS], "bucket string")
    return names.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


def reliability(df: DataFrame, label: str, probability: str, bins: int = 10) -> DataFrame:
    """Equal-width bins with count and means; edges as linspace gives them, the last bin closed; empty bins stay, with nulls."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]
    p = F.col(probability)
    at = F.when((p < 0) | (p > 1), None)
    for i in range(bins - 1, -1, -1):
        at = at.when(p >= edges[i], i)
    got = df.withColumn("bin", at).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("mean_actual"))
    table = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, bin_lower double, bin_upper double")
    return table.join(got, "bin", "left").select("bin", "bin_lower", "bin_upper", F.coalesce("n", F.lit(0)).alias("n"), "mean_predicted", "mean_actual")


def weighted_mean(value: str, weight: str) -> Column:
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def folds(df: DataFrame, day: str, years: Sequence[int]) -> Iterator[tuple[int, DataFrame, DataFrame, DataFrame]]:
    """(year, train up to year - 2, calibrate on year - 1, validate on year); folds with an empty part are left out."""
    have = {r["y"] for r in df.select(F.year(day).alias("y")).distinct().collect()}
    for v in years:
        if v in have and v - 1 in have and any(y <= v - 2 for y in have):
            y = F.year(day)
            yield v, df.where(y <= v - 2), df.where(y == v - 1), df.where(y == v)


def fold_table(df: DataFrame, day: str, periods: Sequence[int], months: int = 12) -> DataFrame:
    """`df` once per fold and role (train up to two periods before, calibrate on the one before, validate), from one scan, incomplete folds left out.

    A period is a year, or `months` months: period k starts k * months after year 0.
    """
    y = F.floor((F.year(F.col(day)) * 12 + F.month(F.col(day)) - 1) / months)
    roles = F.array(*[F.struct(F.lit(v).alias("validate_year"), F.when(y <= v - 2, "train").when(y == v - 1, "calibrate").when(y == v, "validate").alias("role")) for v in periods])
    rows = df.withColumn("_f", F.explode(roles)).withColumns({"validate_year": F.col("_f.validate_year"), "role": F.col("_f.role")}).drop("_f").where("role is not null")
    whole = rows.groupBy("validate_year").agg(F.count_distinct("role").alias("_n")).where("_n = 3").select("validate_year")
    return rows.join(whole, "validate_year", "left_semi")


#: Bins of raw scores an isotonic fit works on: it gathers its points on the driver, so they are pooled by score first.
ISOTONIC_BINS = 10_000


def calibrate(fitted: DataFrame, raw: str, label: str, target: DataFrame, out: str = "calibrated", method: str | None = None) -> DataFrame:
    """`target` with calibrated probabilities: isotonic from ISOTONIC_LEAST rows on (pooled into ISOTONIC_BINS by score), else logistic; clipped to 0..1."""
    chosen = method or ("isotonic" if fitted.limit(ISOTONIC_LEAST).count() >= ISOTONIC_LEAST else "platt")
    assembler = VectorAssembler(inputCols=[raw], outputCol="_x")
    train, rows = assembler.transform(fitted), assembler.transform(target)
    if chosen == "isotonic":
        pooled = fitted.groupBy(F.floor(F.col(raw) * ISOTONIC_BINS).alias("_bin")).agg(F.avg(raw).alias(raw), F.avg(F.col(label).cast("double")).alias(label), F.count(F.lit(1)).cast("double").alias("_n"))
        model = IsotonicRegression(featuresCol="_x", labelCol=label, predictionCol=out, weightCol="_n").fit(assembler.transform(pooled))
        got = model.transform(rows)
    else:
        model = LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_p").fit(train)
        got = model.transform(rows).withColumn(out, vector_to_array("_p")[1]).drop("_p", "rawPrediction", "prediction")
    return got.withColumn(out, F.least(F.greatest(F.col(out), F.lit(0.0)), F.lit(1.0))).drop("_x")


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """`df` with the `features` as one vector: nulls are -1 and told by an indicator of their own."""
    cols = [x for f in features for x in (F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias(f"_v_{f}"), F.col(f).isNull().cast("double").alias(f"_n_{f}"))]
    names = [x for f in features for x in (f"_v_{f}", f"_n_{f}")]
    return VectorAssembler(inputCols=names, outputCol="features").transform(df.select("*", *cols)).drop(*names)


def boosted_trees(train: DataFrame, features: Sequence[str], label: str, seed: int = 7, rounds: int = 20, held: DataFrame | None = None) -> object:
    """A gradient-boosted classifier; with `held` rows, rounds stop once these get no better."""
    rows = vectors(train, features).select("features", F.col(label).cast("double").alias("label"), F.lit(False).alias("held"))
    stop = {}
    if held is not None:
        rows = rows.unionByName(vectors(held, features).select("features", F.col(label).cast("double").alias("label"), F.lit(True).alias("held")))
        stop = {"validationIndicatorCol": "held", "validationTol": 0.001}
    return GBTClassifier(labelCol="label", featuresCol="features", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=seed, **stop).fit(rows)


def score_trees(model: object, df: DataFrame, features: Sequence[str], out: str = "probability_p1") -> DataFrame:
    return model.transform(vectors(df, features)).withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def turned(df: DataFrame, probability: str, first: str, asked: str, out: str = "probability_a") -> DataFrame:
    """`df` with the probability seen from the `asked` side: as it is where that is `first`, else its complement; null for strangers to the pair."""
    return df.withColumn(out, F.when(F.col(asked) == F.col(first), F.col(probability)).when(F.col(asked).isNotNull(), 1 - F.col(probability)))


def walk_forward(folds: DataFrame, features: Sequence[str], label: str, train: Callable, market: str | None = None, least_market: int = 1000) -> DataFrame:
    """(validate_year, part, n, brier, log_loss, accuracy, method, rounds) of each fold of `fold_table`: part is pre or post calibration, or market.

    A model is trained per fold on its train rows and stopped early by its calibration rows, on which it is then
    calibrated; the market's own probability is held against the result where a fold has at least `least_market` rows
    with one. Folds, not rows, pass through the driver.
    """
    out = []
    for v in sorted(r["validate_year"] for r in folds.select("validate_year").distinct().collect()):
        part = {role: folds.where((F.col("validate_year") == v) & (F.col("role") == role)) for role in ("train", "calibrate", "validate")}
        model = train(part["train"], part["calibrate"])
        fitted, scored = score_trees(model, part["calibrate"], features), score_trees(model, part["validate"], features)
        method = "isotonic" if fitted.limit(ISOTONIC_LEAST).count() >= ISOTONIC_LEAST else "platt"
        both = calibrate(fitted, "probability_p1", label, scored, method=method)
        rows = [("pre", metrics(both, label, "probability_p1")), ("post", metrics(both, label, "calibrated"))]
        if market and both.where(F.col(market).isNotNull()).limit(least_market).count() >= least_market:
            rows.append(("market", metrics(both.where(F.col(market).isNotNull()), label, market)))
        out += [m.select(F.lit(v).alias("validate_year"), F.lit(name).alias("part"), "*", F.lit(method).alias("method"), F.lit(model.getNumTrees).alias("rounds")) for name, m in rows]
    return reduce(DataFrame.unionByName, out)


def report(per_fold: DataFrame) -> DataFrame:
    """One row of JSON: the folds, their range and the means weighted by rows per part."""
    folds = per_fold.agg(F.to_json(F.sort_array(F.collect_list(F.struct("validate_year", "part", "n", "brier", "log_loss", "accuracy")))).alias("folds"), F.min("validate_year").alias("first"), F.max("validate_year").alias("last"))
    means = per_fold.groupBy("part").agg(weighted_mean("brier", "n").alias("brier"), weighted_mean("accuracy", "n").alias("accuracy"), F.sum("n").alias("n")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("part", "brier", "accuracy", "n")))).alias("means"))
    return folds.join(F.broadcast(means))  # one row each


def save_model(model: object, path: str) -> None:
    model.write().overwrite().save(path)


def load_trees(path: str) -> GBTClassificationModel:
    return GBTClassificationModel.load(path)

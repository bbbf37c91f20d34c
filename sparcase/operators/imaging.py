"""Models of image quality, on measured numbers: levels, filters and polynomial predictions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workers import kept

#: Thresholds of the levels 1 (poor) to 4 (good) and 5 (pristine).
PRISTINE, POOR, MEDIUM, LOW = 5, 1, 2, 3
GOOD = 4
EDIT_MEAN = (1904.2562172697646, 3.285677411865784, 31.644653767543083, 230.63537173499702, 4.310192376375198)
EDIT_SCALE = (1830.7360700699362, 2.9534615971944884, 8.835931827536946, 8.92396584132394, 1.0499677944474157)


def quality_level(blur: Column, noise: Column, contrast: Column) -> Column:
    return (
        F.when((blur >= 1000) & (noise <= 10) & (contrast >= 0.6), PRISTINE)
        .when((blur < 100) | (noise > 50), POOR)
        .when((blur < 200) | (noise > 25), MEDIUM)
        .when((blur < 500) | (noise > 10), LOW)
        .otherwise(GOOD)
    )


def blur_level(blur: Column) -> Column:
    return F.when(blur < 200, 1).when(blur < 500, 2).when(blur < 1500, 3).when(blur < 3000, 4).otherwise(5)


def filter_choice(level: Column, blur: Column, noise: Column, contrast: Column) -> Column:
    """The filter for a level: none, pil or opencv."""
    return F.when(level == 1, F.when(noise > 50, "opencv").otherwise("pil")).when(level == 2, F.when(blur < 150, "opencv").otherwise("pil")).when(level == 3, F.when(contrast < 0.4, "pil").otherwise("none")).when(level.isin(4, 5), "none").otherwise("pil")


def dot(terms: Sequence[Column], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, (t * F.lit(float(w)) for t, w in zip(terms, weights)))


def scale(features: Sequence[Column], mean: Sequence[float], deviation: Sequence[float]) -> list[Column]:
    return [(f - F.lit(m)) / F.lit(s) for f, m, s in zip(features, mean, deviation)]


def quadratic_terms(x: Sequence[Column]) -> list[Column]:
    """1, the features, and all their products in order."""
    return [F.lit(1.0), *x, *(a * b for a, b in combinations_with_replacement(x, 2))]


def basis(x: Sequence[Column], degree: int) -> list[Column]:
    """1; the features; their squares and then mixed products; their cubes."""
    out = [F.lit(1.0)]
    if degree >= 1:
        out += x
    if degree >= 2:
        out += [f * f for f in x] + [x[i] * x[j] for i in range(len(x)) for j in range(i + 1, len(x))]
    if degree >= 3:
        out += [f * f * f for f in x]
    return out


def predict(terms: Sequence[Column], weights: Sequence[float], low: float, high: float, intercept: float = 0.0) -> Column:
    """A linear model of the terms within its range; the range's middle for a model without weights."""
    if not weights:
        return F.lit((low + high) / 2)
    if len(terms) != len(weights):
        raise ValueError("terms and weights differ in number")
    return F.greatest(F.lit(low), F.least(F.lit(high), dot(terms, weights) + intercept))


def unit_range(c: Column, low: float, high: float, factor: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c * factor - low) / (high - low)))


def refine(kind: Column, noise: Column, contrast: Column, factor: Column) -> Column:
    """struct(median, contrast): a wider median for noise, more contrast for pale pages."""
    return F.struct(F.when((noise > 0.7) & (kind == "pil"), 5).otherwise(3).alias("median"), F.when(contrast < 0.3, F.least(factor * 1.2, F.lit(2.5))).otherwise(factor).alias("contrast"))


def recommend(edits: Column) -> Column:
    return F.when(edits < 200, "NO_FILTER").when(edits < 1000, "OPENCV").otherwise("PIL")


def pareto_front(rows: DataFrame, *costs: str) -> DataFrame:
    """Rows that no other row beats in every cost. Candidates are first thinned to the best second cost of each value of
    the first, then compared by a running minimum over the first cost."""
    first, second = costs
    best = rows.groupBy(first).agg(F.min(second).alias(second))
    ranged = kept(best.repartitionByRange(F.col(first)).withColumn("_p", F.spark_partition_id()))
    lows = ranged.groupBy("_p").agg(F.min(second).alias("_low"))
    before = lows.select("_p", F.expr("min(_low) over (order by _p rows between unbounded preceding and 1 preceding)").alias("_before"))
    running = F.expr(f"min({second}) over (partition by _p order by {first} rows between unbounded preceding and 1 preceding)")
    front = ranged.withColumn("_run", running).join(F.broadcast(before), "_p").where(F.col(second) < F.coalesce(F.least("_run", "_before"), F.lit(float("inf"))))
    return rows.join(front.select(first, second), [first, second], "left_semi")


def train_polynomial(rows: DataFrame, features: list[str], label: str, degree: int = 2, ridge: float = 1.0):
    """A ridge regression on the features' polynomial terms, by pyspark.ml."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    steps = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), PolynomialExpansion(inputCol="_scaled", outputCol="features", degree=degree), LinearRegression(labelCol=label, regParam=ridge, elasticNetParam=0.0)]
    return Pipeline(stages=steps).fit(rows)


def cluster(rows: DataFrame, features: list[str], k: int, seed: int = 1) -> DataFrame:
    """rows with the number of their cluster, by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    return KMeans(k=k, seed=seed).fit(ready).transform(ready).drop("features").withColumnRenamed("prediction", "cluster")

"""The relational edge of learning: linear probe, latent basis, parameter search. Networks themselves are out of scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linear_probe(samples: DataFrame, ridge: float = 0.0, x: str = "x", y: str = "y"):
    """A linear regression of y on the array x."""
    return LinearRegression(featuresCol="v", labelCol=y, regParam=ridge).fit(samples.withColumn("v", array_to_vector(x)))


def search_ridge(samples: DataFrame, ridges: Sequence[float], seed: int = 42, x: str = "x", y: str = "y") -> DataFrame:
    """Each ridge with its validation RMSE, the best first."""
    model = LinearRegression(featuresCol="v", labelCol=y)
    grid = ParamGridBuilder().addGrid(model.regParam, list(ridges)).build()
    fit = TrainValidationSplit(estimator=model, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=y), seed=seed).fit(samples.withColumn("v", array_to_vector(x)))
    return samples.sparkSession.createDataFrame([(float(r), float(m)) for r, m in zip(ridges, fit.validationMetrics, strict=True)], "ridge double, rmse double").orderBy("rmse")


def search(settings: Sequence[dict], run, seconds: float, done: Sequence[dict] = ()) -> list[dict]:
    """run(setting) for each of settings until seconds have gone by; done are trials of an earlier search, which aren't run again.

    A trial is its setting with objective (None if it failed) and error. A trial that has begun is ended.
    """
    import time

    trials, until = list(done), time.monotonic() + seconds
    seen = [{k: v for k, v in t.items() if k not in ("objective", "error")} for t in done]
    for setting in settings:
        if setting in seen:
            continue
        if time.monotonic() >= until:
            break
        try:
            trials.append(setting | {"objective": float(run(setting)), "error": ""})
        except Exception as e:  # a failed trial doesn't end the search
            trials.append(setting | {"objective": None, "error": f"{type(e).__name__}: {e}"})
    return trials


def best_setting(trials: DataFrame, objective: str, *ties: str) -> DataFrame:
    """The row of trials with the smallest objective, ties by ties; null and NaN objectives are failed trials. No completed trial, no row."""
    done = trials.where(F.col(objective).isNotNull() & ~F.isnan(F.col(objective).cast("double")))
    return done.orderBy(objective, *ties).limit(1)


def latent_basis(vectors: DataFrame, k: int, clusters: int, seed: int = 42, column: str = "embedding") -> DataFrame:
    """vectors with their k principal components and a cluster of these."""
    table = vectors.withColumn("v", array_to_vector(F.col(column).cast("array<double>")))
    reduced = PCA(k=k, inputCol="v", outputCol="p").fit(table).transform(table)
    grouped = KMeans(k=clusters, seed=seed, featuresCol="p", predictionCol="cluster").fit(reduced).transform(reduced)
    return grouped.withColumn("components", vector_to_array("p")).drop("v", "p")

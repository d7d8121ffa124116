"""Scores of predictions (t, lat_i, lon_j, depth_k, truth, pred, clim): by level, overall, violations and losses."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio, squared_hinge


def co_registered(truth: DataFrame, pred: DataFrame, clim: DataFrame, keys: Sequence[str] = ("t", "lat_i", "lon_j", "depth_k")) -> DataFrame:
    return truth.join(pred, list(keys)).join(clim, list(keys))


def level_metrics(rows: DataFrame, by: Sequence[str] = ("depth_k",)) -> DataFrame:
    """Error, correlation and skill of each level; null where a denominator is 0. rows are valid cells only. One aggregation."""
    e, t, p, c = F.col("pred") - F.col("truth"), F.col("truth"), F.col("pred"), F.col("clim")
    ta, pa = t - c, p - c

    def correlation(a: Column, b: Column) -> Column:
        return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    rmse, rmse_clim = F.sqrt(F.avg(e * e)), F.sqrt(F.avg((c - t) * (c - t)))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_cells"), F.stddev_pop(t).alias("sigma"), rmse.alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), correlation(t, p).alias("pearson_r"),
        correlation(ta, pa).alias("anomaly_corr"), ratio(F.stddev_pop(pa), F.stddev_pop(ta)).alias("anom_sd_ratio"), rmse_clim.alias("rmse_clim"), (1 - ratio(rmse, rmse_clim)).alias("skill"),
    )


def overall(metrics: DataFrame) -> DataFrame:
    """All levels together: errors squared and the others linear, weighted by the number of cells; null where a level has none."""
    w = F.col("n_cells")

    def mean(x: Column) -> Column:
        return F.when(F.count(x) == F.count("*"), F.sum(x * w) / F.sum(w))

    squared = {c: F.sqrt(mean(F.pow(c, 2))) for c in ("rmse", "rmse_clim")}
    linear = {c: mean(F.col(c)) for c in ("mae", "bias", "pearson_r", "anomaly_corr", "anom_sd_ratio", "skill")}
    return metrics.agg(F.sum(w).alias("n_cells"), *[x.alias(c) for c, x in (squared | linear).items()])


def level_steps(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """For each pair of neighbouring levels: d_{value}, the deeper less the upper. Levels of a key are few, so a window costs one sort."""
    frame = Window.partitionBy(*keys).orderBy("depth_k")
    near = rows.withColumn("next_k", F.lead("depth_k").over(frame)).withColumns({f"d_{v}": F.lead(v).over(frame) - F.col(v) for v in values})
    return near.where(F.col("next_k") == F.col("depth_k") + 1).drop("next_k")


def violations(steps: DataFrame, gate: DataFrame, values: Sequence[str]) -> DataFrame:
    """For each of values: the share of pairs where the deeper level is warmer, among all and among gated pairs (weight above 0)."""
    gated = steps.join(F.broadcast(gate.select("depth_k", "gate")), "depth_k")  # a row per level
    long = gated.select("gate", F.explode(F.array(*[F.struct(F.lit(v).alias("of"), (F.col(f"d_{v}") > 0).cast("double").alias("warm")) for v in values])).alias("x")).select("gate", "x.*")
    return long.groupBy("of").agg(F.avg("warm").alias("all_pairs"), F.avg(F.when(F.col("gate") > 0, F.col("warm"))).alias("gated"), F.count("warm").alias("n"))


class Evaluation(NamedTuple):
    levels: DataFrame
    overall: DataFrame
    violations: DataFrame


def evaluate(truth: DataFrame, pred: DataFrame, clim: DataFrame, gate: DataFrame, keys: Sequence[str] = ("t", "lat_i", "lon_j", "depth_k")) -> Evaluation:
    """All scores of pred: by level, overall, and the share of inversions in pred and in truth. Rows without a value in any of the three don't count."""
    rows = co_registered(truth, pred, clim, keys).dropna(subset=["truth", "pred", "clim"])
    levels = level_metrics(rows)
    steps = level_steps(rows, [k for k in keys if k != "depth_k"], ["truth", "pred"])
    return Evaluation(levels, overall(levels), violations(steps, gate, ["truth", "pred"]))


def masked_mse(rows: DataFrame, valid_cells: int) -> DataFrame:
    """Squared errors of each sample, by the number of valid cells of a sample."""
    return rows.groupBy("t").agg((F.sum(F.pow(F.col("truth") - F.col("pred"), 2)) / F.lit(float(max(valid_cells, 1)))).alias("loss"))


def combined_loss(rows: DataFrame, gate: DataFrame, valid_cells: int, pair_weight: float, penalty: float, margin: float = 0.0) -> DataFrame:
    """masked_mse plus penalty times the gated squared hinge on level steps of pred; with penalty 0 the steps aren't made."""
    data = masked_mse(rows, valid_cells)
    if penalty == 0:
        return data
    steps = level_steps(rows.select("t", "lat_i", "lon_j", "depth_k", "pred"), ("t", "lat_i", "lon_j"), ("pred",)).join(F.broadcast(gate.select("depth_k", "gate")), "depth_k")
    physics = steps.groupBy("t").agg((F.sum(F.col("gate") * squared_hinge(F.col("d_pred"), margin)) / F.lit(float(max(pair_weight, 1.0)))).alias("physics"))
    return data.join(physics, "t", "left").select("t", (F.col("loss") + F.lit(float(penalty)) * F.coalesce("physics", F.lit(0.0))).alias("loss"))


def bundle(rows: DataFrame, gate: DataFrame, scale: float = 1.0) -> DataFrame:
    """One row of the metrics that training reports: mse, mae, rmse_scaled, n, and the shares of inversions among all and gated pairs."""
    steps = level_steps(rows.select("t", "lat_i", "lon_j", "depth_k", "pred"), ("t", "lat_i", "lon_j"), ("pred",))
    return pooled_errors(rows, scale).crossJoin(violations(steps, gate, ("pred",)).select("all_pairs", "gated"))  # a row each


def pooled_errors(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """MSE, MAE and scaled RMSE over all rows: sums by counts, exact however rows are dealt."""
    e = F.col("pred") - F.col("truth")
    return rows.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(F.lit(scale * scale) * e * e)).alias("rmse_scaled"), F.count("*").alias("n"))

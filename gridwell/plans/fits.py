"""Queries on fitting, search and records of runs."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..operators import fitting, learning
from ..sources import runs
from ..sources import tables as sources
from . import tables as T
from .catalogue import query, rounded

WEIGHTS = np.array([[0.5, -0.25], [0.25, 0.5], [1.0, 2.0]])


def _samples(spark, sf_dir):
    """Inputs truth and clim, targets pred (with gaps) and truth, in thousands; the last months are held out."""
    own = T.predictions(spark, sf_dir)
    pred = F.when(F.col("depth_k") % 3 != 0, F.col("pred") / 1000)
    return own.select(F.array(F.col("truth") / 1000, F.col("clim") / 1000).alias("x"), F.array(pred, F.col("truth") / 1000).alias("y"), F.when(F.col("t") >= 1998 * 12, "val").otherwise("train").alias("split"))


@query("""SELECT split, count(e0) + count(e1) AS n, round((sum(e0 * e0) + sum(e1 * e1)) / (count(e0) + count(e1)), 4) AS loss,
        round(2 * sum(e0 * x0) / (count(e0) + count(e1)), 4) AS g0, round(2 * sum(e1 * x0) / (count(e0) + count(e1)), 4) AS g1, round(2 * sum(e0 * x1) / (count(e0) + count(e1)), 4) AS g2,
        round(2 * sum(e1 * x1) / (count(e0) + count(e1)), 4) AS g3, round(2 * sum(e0) / (count(e0) + count(e1)), 4) AS g4, round(2 * sum(e1) / (count(e0) + count(e1)), 4) AS g5
    FROM (SELECT CASE WHEN t >= 1998 * 12 THEN 'val' ELSE 'train' END AS split, truth / 1000 AS x0, clim / 1000 AS x1,
        CASE WHEN depth_k % 3 <> 0 THEN 0.5 * truth / 1000 + 0.25 * clim / 1000 + 1 - pred / 1000 END AS e0, -0.25 * truth / 1000 + 0.5 * clim / 1000 + 2 - truth / 1000 AS e1 FROM predictions) GROUP BY split""")
def q_fit_gradient(spark, sf_dir):
    """Loss and gradient of a step of a fit, as tasks sum them."""
    found = fitting.gradient(_samples(spark, sf_dir), WEIGHTS)
    rows = [(s, n, loss, *g.ravel().tolist()) for s, (n, loss, g) in found.items()]
    return rounded(spark.createDataFrame(rows, "split string, n long, loss double, " + ", ".join(f"g{k} double" for k in range(6))))


@query("""SELECT CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, round(objective, 4) AS objective FROM (
        SELECT a, b, avg((q - a) * (q - a)) / 100 + avg((d - b) * (d - b)) + avg((q - a) * (d - b)) / 20 AS objective
        FROM (SELECT unnest(range(0, 51, 5)) AS a), (SELECT unnest(range(0, 11)) AS b), (SELECT CAST(l_quantity AS DOUBLE) AS q, l_discount * 100.0::DOUBLE AS d FROM lineitem) GROUP BY a, b)
    ORDER BY objective, a, b LIMIT 1""")
def q_surrogate_search(spark, sf_dir):
    """The best of a grid of 121 settings, found in 24 trials, each a job over all lines."""
    lines = T.read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), (F.col("l_discount") * 100.0).alias("d"))

    def objective(s: dict) -> float:
        a, b = F.col("q") - F.lit(s["a"]), F.col("d") - F.lit(s["b"])
        return lines.agg(F.avg(a * a) / 100 + F.avg(b * b) + F.avg(a * b) / 20).first()[0]

    space = fitting.Space({"a": [float(v) for v in range(0, 51, 5)], "b": [float(v) for v in range(11)]})
    trials = fitting.search(spark, space, objective, f"{sources.scratch(spark)}/search-{uuid.uuid4().hex}", 24)
    table = spark.createDataFrame([(t["a"], t["b"], t["objective"]) for t in trials], "a double, b double, objective double")
    return rounded(learning.best_setting(table, "objective", "a", "b"))


@query("""SELECT sha256(concat('{"brand": "', p_brand, '", "size": ', CAST(p_size AS VARCHAR), '}')) AS fingerprint, p_brand AS brand, CAST(p_size AS BIGINT) AS size, round(objective, 4) AS objective, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS added
    FROM (SELECT p_brand, p_size, avg(p_retailprice) AS objective FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(objective, 4), p_size) = 1""")
def q_best_runs(spark, sf_dir):
    """Runs that two writers added, and each brand's best with the fingerprint of its settings."""
    trials = T.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size")).agg(F.round(F.avg("p_retailprice"), 4).alias("objective"))
    store = runs.Runs(spark, f"{sources.scratch(spark)}/runs-{uuid.uuid4().hex}")
    store.add(trials.where("size % 2 = 0"))
    store.add(trials.where("size % 2 = 1").withColumn("note", F.lit("odd")))
    best = store.read().groupBy("brand").agg(F.min(F.struct("objective", "size", "added")).alias("b")).select("brand", "b.*")
    text = F.format_string('{"brand": "%s", "size": %d}', "brand", "size")
    return best.select(F.sha2(text, 256).alias("fingerprint"), "brand", "size", "objective", F.col("added").cast("int").alias("added"))

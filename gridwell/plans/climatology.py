"""Climatology of a record and what is made with it: anomalies, their statistics, and trailing means with theirs.

    climatology/var=...   the smoothed mean of each cell and day of the year, of training days alone
    anomalies/block=...   (var, lat_i, lon_j, t, day, split, value, anom), by blocks of days
    means/block=...       the same with rm{w} for each window, by blocks of days
    stats                 JSON: {var: {mean, std} of anomalies of training days, "windows": {w: {var: {mean, std}}}}

All variables go through each step together, so a record is read once for the climatology and once for the anomalies. Trailing means can be made alone, for other windows
or for days that were added, from the anomalies that are there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series, splits, trailing
from ..sources import tables

KEYS = ("var", *series.CELL)


def climatology(record: DataFrame, variables: Sequence[str], half: int) -> DataFrame:
    """(var, lat_i, lon_j, doy, clim) of the record's training days, smoothed over half days either way."""
    train = series.long_form(record.where("split = 'train'"), [*series.CELL, "doy"], variables)
    return series.circular_smooth(series.doy_means(train, KEYS), KEYS, half)


def build(spark: SparkSession, record: str, folder: str, variables: Sequence[str], windows: Sequence[int] = (30, 90), half: int = 7, history: int = 0, size: int = trailing.SIZE) -> None:
    """Makes all of it from the record (t, day, doy, split, lat_i, lon_j and the variables) at a path. history: days that a target day's inputs reach back, which statistics of means leave out."""
    table = spark.read.parquet(record)
    climatology(table, variables, half).write.mode("overwrite").partitionBy("var").parquet(f"{folder}/climatology")
    add(spark, record, folder, variables, size=size)
    moments = series.moments(spark.read.parquet(f"{folder}/anomalies").where("split = 'train'"), ["var"], "anom")
    tables.write_stats(moments.select("var", "mean", "std"), f"{folder}/stats")
    running_means(spark, folder, windows, history, size=size)


def add(spark: SparkSession, record: str, folder: str, variables: Sequence[str], since: int | None = None, size: int = trailing.SIZE) -> None:
    """Writes the anomalies of the record's days, or of those from the block of day since on; earlier blocks stay."""
    table = spark.read.parquet(record)
    if since is not None:
        table = table.where(F.col("t") >= since // size * size)
    long = series.long_form(table, [*series.CELL, "t", "day", "doy", "split"], variables)
    clim = spark.read.parquet(f"{folder}/climatology").withColumn("var", F.col("var").cast("string"))
    trailing.write_blocks(series.anomalies(long, clim, KEYS).drop("clim", "doy"), f"{folder}/anomalies", size=size)


def running_means(spark: SparkSession, folder: str, windows: Sequence[int] = (30, 90), history: int = 0, since: int | None = None, size: int = trailing.SIZE) -> list[int]:
    """Makes trailing means from the anomalies that are there, from the block of day since on if it is given, and their statistics over all training days with history days before; returns the blocks that were read."""
    read = trailing.write_means(spark, f"{folder}/anomalies", f"{folder}/means", KEYS, windows, None if since is None else since // size, size=size)
    means = spark.read.parquet(f"{folder}/means")
    rows = splits.split_rows(means, "train", max(history, max(windows) - 1))
    tables.write_window_stats(series.window_stats(rows, windows, ["var"]).select("w", "var", "mean", "std"), f"{folder}/stats")
    return read

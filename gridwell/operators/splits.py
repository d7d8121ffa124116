"""Splits by calendar year, with buffers. They work on the calendar (t, day, year), which has a row per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SplitMode
from . import permutation

NAMES = ("train", "val", "test")


def day_labels(days: DataFrame, mode: SplitMode, history: int = 0) -> DataFrame:
    """days with split: by set membership of the year; train days within the buffer of a held-out day are "buffer"."""
    mode.checked(history)
    held = F.when(F.col("year").isin(list(mode.val_years)), "val").when(F.col("year").isin(list(mode.test_years)), "test")
    labelled = days.withColumn("split", F.coalesce(held, F.lit("train")))
    if not mode.buffer_days:
        return labelled
    near = F.max((F.col("split") != "train").cast("int")).over(Window.orderBy("t").rowsBetween(-mode.buffer_days, mode.buffer_days))
    return labelled.withColumn("split", F.when((F.col("split") == "train") & (near == 1), "buffer").otherwise(F.col("split")))


def split_rows(labelled: DataFrame, name: str, history: int) -> DataFrame:
    """Days of a split that have history days before them; "any" has every such day, buffer days too."""
    if name not in (*NAMES, "buffer", "any"):
        raise KeyError(f"{name} is none of {[*NAMES, 'buffer', 'any']}")
    return labelled.where((F.lit(name == "any") | (F.col("split") == name)) & (F.col("t") >= history))


def split_of(labelled: DataFrame, days: DataFrame) -> DataFrame:
    """days (t) with the split that each belongs to."""
    return days.join(labelled.select("t", "split"), "t", "left")


def checked_training(rows: DataFrame, mode: SplitMode) -> DataFrame:
    """rows (with year), if none is of a held-out year; else an error that names the years."""
    if leaked := sorted(r.year for r in rows.select("year").distinct().where(F.col("year").isin(mode.held)).collect()):  # a row per held-out year
        raise RuntimeError(f"training rows of held-out years {leaked}")
    return rows


def reached(days: DataFrame, lags: Sequence[int], windows: Sequence[int] = ()) -> DataFrame:
    """The days (t) that the inputs of days (t) are made of, each once."""
    back = sorted({*lags, *(k for w in windows for k in range(w))})
    return days.select(F.explode(F.array(*[F.col("t") - k for k in back])).alias("t")).distinct()


def shared_days(**sets: DataFrame) -> DataFrame:
    """For each two of the sets (of t): how many days both have."""
    tagged = None
    for name, days in sets.items():
        own = days.select("t", F.lit(name).alias("name")).distinct()
        tagged = own if tagged is None else tagged.unionByName(own)
    names = list(sets)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(names) for b in names[i + 1 :]])
    held = tagged.groupBy("t").agg(F.collect_set("name").alias("in")).select(F.explode(pairs).alias("p"), "in")
    both = F.array_contains("in", F.col("p.a")) & F.array_contains("in", F.col("p.b"))
    return held.groupBy("p.a", "p.b").agg(F.count_if(both).alias("shared"))


def split_years(days: DataFrame, mode: SplitMode) -> DataFrame:
    """Each year of days with the split that it belongs to."""
    return days.select("year").distinct().withColumn("split", F.when(F.col("year").isin(list(mode.val_years)), "val").when(F.col("year").isin(list(mode.test_years)), "test").otherwise("train"))


def blocks(labelled: DataFrame, by: str = "split") -> DataFrame:
    """Contiguous runs of t of each split: start, stop (one behind the last)."""
    run = F.col("t") - F.row_number().over(Window.partitionBy(by).orderBy("t"))
    return labelled.withColumn("run", run).groupBy(by, "run").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("stop")).drop("run")


def summary(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("split").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def overlaps(labelled: DataFrame) -> DataFrame:
    """For each two of train, val and test: how many days both have; 0 everywhere if nothing leaks."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]])
    sets = labelled.groupBy("day").agg(F.collect_set("split").alias("in"))
    return sets.select(F.explode(pairs).alias("p"), "in").groupBy("p.a", "p.b").agg(F.sum((F.array_contains("in", F.col("p.a")) & F.array_contains("in", F.col("p.b"))).cast("int")).cast("long").alias("shared"))


def outside(chosen: DataFrame, allowed: DataFrame, key: str = "t") -> DataFrame:
    """Rows of chosen that aren't allowed; there should be none."""
    return chosen.join(allowed.select(key), key, "left_anti")


def buffer_distance(labelled: DataFrame) -> DataFrame:
    """For each buffer day the days to the nearest held-out day, by the last one before and the first one behind."""
    held = F.when(F.col("split").isin("val", "test"), F.col("t"))
    before = F.last(held, True).over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first(held, True).over(Window.orderBy("t").rowsBetween(0, Window.unboundedFollowing))
    return labelled.select("t", "split", F.least(F.col("t") - before, behind - F.col("t")).alias("distance")).where("split = 'buffer'")


def batches(rows: DataFrame, size: int, seed: int | None = None, epoch: int = 0) -> DataFrame:
    """rows (t) with place and batch, by t or in an order that seed and epoch fix."""
    return permutation.batches(rows, size, seed, epoch).withColumn("batch", F.col("batch").cast("int"))


def sampled(rows: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows that the seed chooses by a hash of keys."""
    return rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)

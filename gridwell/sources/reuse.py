"""Files that needn't be fetched again: what is there is held against a manifest by its content and against the plan by its settings, and new files appear whole.

A manifest has a row for each file that passed its checks: file, spec (the fingerprint of what was asked for), bytes and digest. A file counts as done only if
its present content has the digest and its spec is the plan's, so torn, changed and outdated files are fetched again. Digests are worked out where the files are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs


def spec_of(*settings: Column) -> Column:
    """The fingerprint of a row's settings, nulls among them."""
    return F.sha2(F.to_json(F.array(*[s.cast("string") for s in settings])), 256)


def inventory(spark: SparkSession, pattern: str) -> DataFrame:
    """The files that pattern names: file (its name), bytes, digest and modified."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("digest"), F.col("modificationTime").alias("modified"))


def to_fetch(plan: DataFrame, manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of plan (file, spec) that are to be fetched, with reason: new, settings (made for others), absent (known, but gone), torn (shorter) or changed.

    manifest may have several rows of a file; the one with the plan's spec and the present digest counts. Repeated plan rows stay.
    """
    known = manifest.select("file", F.col("spec").alias("known_spec"), F.col("bytes").alias("known_bytes"), F.col("digest").alias("known_digest"))
    here = present.groupBy("file").agg(F.max("bytes").alias("bytes"), F.max("digest").alias("digest"))
    joined = plan.withColumn("_row", F.monotonically_increasing_id()).join(known, "file", "left").join(here, "file", "left")
    done = (F.col("known_spec") == F.col("spec")) & (F.col("known_digest") == F.col("digest"))
    own = F.col("known_spec") == F.col("spec")
    names = [F.first(c).alias(c) for c in plan.columns if c != "file"]
    kept = joined.groupBy("_row", "file").agg(
        *names, F.bool_or(F.coalesce(done, F.lit(False))).alias("_done"), F.count("known_spec").alias("_known"), F.bool_or(F.coalesce(own, F.lit(False))).alias("_own"),
        F.bool_or(F.col("digest").isNotNull()).alias("_here"), F.bool_or(F.coalesce(own & (F.col("bytes") < F.col("known_bytes")), F.lit(False))).alias("_short"),
    )
    reason = F.when(F.col("_known") == 0, "new").when(~F.col("_own"), "settings").when(~F.col("_here"), "absent").when(F.col("_short"), "torn").otherwise("changed")
    return kept.where(~F.col("_done")).select(*plan.columns, reason.alias("reason"))


def checked(present: DataFrame, plan: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """Manifest rows of the files that are there, are planned, and have no row in problems (file); an empty file is never one."""
    good = present.where("bytes > 0").select("file", "bytes", "digest").join(plan.select("file", "spec").distinct(), "file")
    return (good if problems is None else good.join(problems.select("file"), "file", "left_anti")).select("file", "spec", "bytes", "digest")


class Manifest:
    """The manifest of a folder, to which several runs may add at once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.runs = spark, runs.Runs(spark, folder)

    def read(self) -> DataFrame:
        """All rows; none where nothing was added yet."""
        if not self.runs.log.numbers():
            return self.spark.createDataFrame([], "file string, spec string, bytes long, digest string")
        return self.runs.read().select("file", "spec", "bytes", "digest")

    def add(self, rows: DataFrame) -> int:
        return self.runs.add(rows.select("file", "spec", "bytes", "digest"))


def publish(spark: SparkSession, write: Callable[[str], None], place: str) -> None:
    """Makes place appear whole: write(folder) writes beside it, and a rename puts it there. What was there goes first; if write fails, it stays."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    beside, target = f"{place}.part-{uuid.uuid4().hex}", path(place)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(beside)
    except BaseException:
        files.delete(path(beside), True)
        raise
    if files.exists(target):
        files.delete(target, True)
    if not files.rename(path(beside), target):
        raise OSError(f"{place} couldn't be renamed")


def vintage(inputs: DataFrame, outputs: DataFrame, required: dict[str, Sequence[str]]) -> DataFrame:
    """Whether each year can be made and must be: year, ready, stale and reason.

    inputs: a row for each file (year, product, file, variables array<string>, modified; variables null: it can't be read). outputs: year and written, when it was made
    last. required: the products that every year needs, each with the variables that its files must have, whatever their names say. A year is stale if it is ready and was never
    made or a file of it is newer. The first reason counts: a product that lacks, a file that can't be read, variables that lack (an older version of the file), a newer file.
    """
    rules = F.array(*[F.struct(F.lit(p).alias("product"), F.array(*map(F.lit, v)).alias("needed")) for p, v in required.items()])
    years = inputs.select("year").union(outputs.select("year")).distinct().select("year", F.explode(rules).alias("rule")).select("year", "rule.*")
    whole = years.join(inputs, ["year", "product"], "left")
    lacks = F.array_except("needed", "variables")

    def told(k: int, *why: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), F.concat(*why).alias("why"))

    reasons = F.when(F.col("file").isNull(), told(0, F.lit("no "), F.col("product")))
    reasons = reasons.when(F.col("variables").isNull(), told(1, F.col("file"), F.lit(" can't be read")))
    reasons = reasons.when(F.size(lacks) > 0, told(2, F.col("file"), F.lit(" lacks "), F.array_join(lacks, ", ")))
    byyear = whole.groupBy("year").agg(F.min(reasons).alias("first"), F.max("modified").alias("newest"), F.max_by("file", F.struct("modified", "file")).alias("last"))
    made = byyear.join(outputs.groupBy("year").agg(F.max("written").alias("written")), "year", "left")
    ready = F.col("first").isNull()
    newer = F.col("written").isNull() | (F.col("newest") > F.col("written"))
    reason = F.when(~ready, F.col("first.why")).when(F.col("written").isNull(), "never made").when(newer, F.concat("last", F.lit(" is newer"))).otherwise("")
    return made.select("year", ready.alias("ready"), (ready & newer).alias("stale"), reason.alias("reason"))

"""Statistics that grow with arriving files: a stream keeps mergeable moments, so old days aren't read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import accumulated, merge_moments


def follow(spark: SparkSession, source: str, schema, target: str, checkpoint: str, by: Sequence[str], value: str = "value"):
    """Reads the files of source that are new since the last call and appends their moments to target, then ends.

    A batch that is repeated after a failure replaces its own rows, so nothing counts twice. checkpoint is a
    shared folder. Returns the query; await it.
    """

    def add(batch: DataFrame, number: int) -> None:
        own = accumulated(batch, by, value).withColumn("batch", F.lit(number))
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def moments_so_far(spark: SparkSession, target: str, by: Sequence[str]) -> DataFrame:
    """n, mean and std of all that follow() has read."""
    return merge_moments(spark.read.parquet(target), by).select(*by, "n", "mean", F.sqrt(F.col("m2") / F.nullif(F.col("n"), F.lit(0))).alias("std"))

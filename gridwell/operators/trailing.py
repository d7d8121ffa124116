"""Trailing means of long series by blocks of days, each with a halo of the days before it.

A series is cut into blocks of days. How many rows each block of a cell has is a small table; carried over the blocks it tells how many rows
come before a block, and which earlier blocks hold the rows that its windows reach back to. Each block is one group with these,
and its means are differences of prefix sums within the group, for all windows in one pass. So one cell's series is many tasks, rounding doesn't build up
over the record, and days that are added change only the blocks that they lie in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import replace_parts

#: Days of a block.
SIZE = 128


def block_of(order: str, size: int = SIZE) -> Column:
    return F.floor(F.col(order) / size).cast("int")


def block_counts(table: DataFrame, by: Sequence[str], order: str = "t", size: int = SIZE) -> DataFrame:
    """How many rows each block of each by has."""
    return table.groupBy(*by, block_of(order, size).alias("block")).agg(F.count("*").alias("n"))


def halos(counts: DataFrame, by: Sequence[str], history: int) -> DataFrame:
    """For each block that counts has (target): itself and the blocks with its history rows before (block), and how many rows of by come before the first of these (ahead)."""
    along = Window.partitionBy(*by).orderBy("block")
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # every block has a row, so history blocks are enough
    near = F.collect_list(F.struct("block", "before", "n")).over(along.rowsBetween(-history, 0))
    read = F.filter(near, lambda x: x["before"] + x["n"] > F.col("before") - history)
    reads = placed.select(*by, F.col("block").alias("target"), read.alias("read"))
    return reads.select(*by, "target", F.col("read")[0]["before"].alias("ahead"), F.explode("read.block").alias("block"))


def _means(table: DataFrame, reads: DataFrame, by: Sequence[str], windows: Sequence[int], value: str, order: str, size: int) -> DataFrame:
    sent = table.withColumn("block", block_of(order, size)).join(reads, [*by, "block"])
    frame = Window.partitionBy(*by, "target").orderBy(order)
    upto = frame.rowsBetween(Window.unboundedPreceding, 0)
    summed = sent.withColumns({"_sum": F.coalesce(F.sum(value).over(upto), F.lit(0.0)), "_held": F.count(value).over(upto), "_place": F.row_number().over(frame) + F.col("ahead")})

    def mean(w: int) -> Column:
        total, held = (F.col(c) - F.coalesce(F.lag(c, w).over(frame), F.lit(0)) for c in ("_sum", "_held"))
        return F.when(F.col("_place") < w, F.lit(0.0)).when(held > 0, total / F.lit(float(w)))

    out = summed.withColumns({f"rm{w}": mean(w) for w in windows}).where("block = target")
    return out.select(*table.columns, *[f"rm{w}" for w in windows])


def running_means(table: DataFrame, by: Sequence[str], windows: Sequence[int], value: str = "anom", order: str = "t", size: int = SIZE) -> DataFrame:
    """table with rm{w} for each of windows: the sum of the last w rows, this one included, by w; exactly 0 where fewer rows came before.

    order is a whole number, each once in a value of by. Null values add nothing; a window of nulls alone is null. The same as series.running_mean for each window,
    but a task holds a block and what it reaches back to, instead of a whole series.
    """
    reads = halos(block_counts(table, by, order, size), by, max(windows) - 1)
    return _means(table, reads, by, windows, value, order, size)


def write_blocks(table: DataFrame, path: str, order: str = "t", size: int = SIZE) -> None:
    """table by blocks of days; blocks that it has replace what is there, others stay."""
    replace_parts(table.withColumn("block", block_of(order, size)), path, "block")


def write_means(spark: SparkSession, source: str, target: str, by: Sequence[str], windows: Sequence[int], first: int | None = None, value: str = "anom", order: str = "t", size: int = SIZE) -> list[int]:
    """Makes the means of the blocks at source (as write_blocks left them) from block first on, and writes them by block to target; returns the blocks that were read.

    With first, the earlier blocks at target stay as they are: after days were added only their blocks are made, from these and their halo. All blocks are
    counted, which reads no values.
    """
    table = spark.read.parquet(source)
    counts = table.groupBy(*by, "block").agg(F.count("*").alias("n"))
    reads = halos(counts, by, max(windows) - 1)
    if first is not None:
        reads = reads.where(F.col("target") >= first)
    needed = sorted(r.block for r in reads.select("block").distinct().collect())  # a row per block of days
    rows = table.where(F.col("block").isin(needed)).drop("block")
    write_blocks(_means(rows, reads, by, windows, value, order, size), target, order, size)
    return needed

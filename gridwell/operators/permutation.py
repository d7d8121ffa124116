"""A keyed order of whole numbers, and batches by it that can be entered anywhere.

The numbers 0 to n - 1 stand as pairs on a grid of about sqrt(n) rows and a power of two of columns; rounds add a mixed form of one half to the other, alternately, which
a later round can take away again. What falls behind n goes round again until it doesn't. So every number has a place and every place a number, each worked out from
itself alone: no sort, no window over all rows, and no list of the order.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A prime, so that the mixing of a round spreads over all of its remainders.
PRIME = (1 << 31) - 1
ROUNDS = 6
#: How often a number may fall behind n: less than sqrt(n) places are behind it, so none does more often where n is below 1024; else the chance is below n**-16.
WALKS = 32


@dataclass(frozen=True)
class Permutation:
    """The order of 0 to n - 1 in an epoch under a seed."""

    n: int
    seed: int = 42
    epoch: int = 0

    @property
    def sides(self) -> tuple[int, int]:
        """How many rows and columns the grid has."""
        columns = 1 << max(self.n - 1, 0).bit_length() // 2
        return max(-(-self.n // columns), 1), columns

    @property
    def rounds(self) -> list[tuple[int, int, int, int]]:
        """Factors and offsets of each round's mixing."""
        rng = random.Random(f"{self.seed} {self.epoch}")
        return [tuple(rng.randrange(1, PRIME) for _ in range(4)) for _ in range(ROUNDS)]

    def _walked(self, x: Column, back: bool) -> Column:
        rows, columns = self.sides
        steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("abcdk", (*r, k), strict=True)]) for k, r in enumerate(self.rounds)][:: -1 if back else 1])

        def turned(half: Column, s: Column) -> Column:
            """A mixed form of half: two linear steps with a square between them."""
            first = F.transform(F.array((half * s["a"] + s["b"]) % PRIME), lambda y: (y * y) % PRIME)[0]
            return (first * s["c"] + s["d"]) % PRIME

        def step(at: Column, s: Column) -> Column:
            even, sign = s["k"] % 2 == 0, -1 if back else 1
            left = F.when(even, F.pmod(at["left"] + sign * turned(at["right"], s), F.lit(rows))).otherwise(at["left"])
            right = F.when(even, at["right"]).otherwise(F.pmod(at["right"] + sign * turned(at["left"], s), F.lit(columns)))
            return F.struct(left.alias("left"), right.alias("right"))

        def moved(y: Column) -> Column:
            start = F.struct(F.shiftright(y, columns.bit_length() - 1).alias("left"), y.bitwiseAND(F.lit(columns - 1).cast("long")).alias("right"))
            return F.aggregate(steps, start, step, lambda at: at["left"] * columns + at["right"])

        own = moved(x.cast("long"))
        failed = F.raise_error(F.lit("a number fell behind n too often: take another seed")).cast("long")
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), own, lambda y, _: F.when(y < self.n, y).otherwise(moved(y)), lambda y: F.when(y < self.n, y).otherwise(failed))

    def place(self, number: Column) -> Column:
        """Where number, from 0 to n - 1, stands in the order."""
        return self._walked(number, False)

    def number(self, place: Column) -> Column:
        """What stands at place."""
        return self._walked(place, True)


def numbered(rows: DataFrame, order: str = "t", size: int = 4096) -> DataFrame:
    """rows with number, from 0 in order (whole numbers, each once); a stretch of size values is numbered in one task, and only the stretches' counts are carried over all."""
    stretch = F.floor(F.col(order) / size)
    counts = rows.groupBy(stretch.alias("_stretch")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per stretch
    placed = rows.withColumn("_stretch", stretch).join(counts.select("_stretch", before.alias("_before")), "_stretch")
    number = F.row_number().over(Window.partitionBy("_stretch").orderBy(order)) - 1
    return placed.withColumn("number", F.col("_before") + number).drop("_stretch", "_before")


def batches(rows: DataFrame, size: int, seed: int | None = None, epoch: int = 0, order: str = "t") -> DataFrame:
    """rows (order: whole numbers, each once) with place and batch: by order, or in the order of an epoch that seed fixes."""
    own = numbered(rows, order)
    place = F.col("number") if seed is None else Permutation(rows.count(), seed, epoch).place(F.col("number"))
    return own.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / size)).drop("number")


def members(spark: SparkSession, n: int, size: int, wanted: Sequence[int], seed: int | None = None, epoch: int = 0) -> DataFrame:
    """The numbers (batch, place, number) of the batches wanted of n rows, without a look at any row."""
    places = spark.createDataFrame([(int(b),) for b in wanted], "batch long").select("batch", F.explode(F.sequence(F.col("batch") * size, F.col("batch") * size + size - 1)).alias("place")).where(F.col("place") < n)
    return places.withColumn("number", F.col("place") if seed is None else Permutation(n, seed, epoch).number(F.col("place")))

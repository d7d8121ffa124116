"""What is to be fetched: a row for each product, year and level, without those that the product doesn't cover."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import NOMINAL_DEPTHS, expected_days
from ..functions.scalars import level_depth


def plan(spark: SparkSession, products: Sequence[str], years: Sequence[int], levels: Mapping[str, Sequence[int]], within: tuple[float, float] | None = None) -> DataFrame:
    """product, year, nominal and depth (null where a product has no levels), days and place in the order of fetching.

    levels: the nominal levels of products that have any; within: the least and the largest of these that are wanted. Products
    with levels come first, by year and depth, since the mask is made from their first file.
    """
    chosen = {p: [n for n in levels[p] if within is None or within[0] <= n <= within[1]] if p in levels else [None] for p in products}
    rows = [(p, int(y), n, expected_days(y, p), int(p not in levels)) for p in products for y in years for n in chosen[p]]
    table = spark.createDataFrame([r for r in rows if r[3] > 0], "product string, year int, nominal int, days int, later int").withColumn("depth", level_depth(F.col("nominal")))
    place = F.row_number().over(Window.orderBy("later", "product", "year", F.col("depth").asc_nulls_first()))  # a row per file of the plan
    return table.withColumn("place", place).drop("later")


def files(planned: DataFrame) -> DataFrame:
    """planned with source and file, the names that its parts have."""
    level = F.when(F.col("nominal").isNotNull(), F.concat(F.lit("_"), F.col("nominal").cast("string"), F.lit("m"))).otherwise(F.lit(""))
    return planned.withColumns({"source": F.col("product"), "file": F.concat("product", level, F.lit("_"), F.col("year").cast("string"))})


def all_levels(product: str = "glorys") -> dict[str, list[int]]:
    return {product: list(NOMINAL_DEPTHS)}

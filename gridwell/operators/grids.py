"""Grids: dimension tables, bins, stencils and masks. Cells are whole numbers, so every join is an equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ACTUAL_DEPTHS, GATE, NOMINAL_DEPTHS, Axis, Grid
from ..functions.scalars import centred, half_bin


def axis(spark: SparkSession, of: Axis, index: str, name: str) -> DataFrame:
    return spark.range(of.size).select(F.col("id").cast("int").alias(index), (F.lit(of.start) + F.col("id") * F.lit(of.step)).alias(name))


def cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """All cells with their coordinates, and both coordinates brought to -1 to 1."""
    lat, lon = axis(spark, grid.lat, "lat_i", "lat"), axis(spark, grid.lon, "lon_j", "lon")
    both = lat.crossJoin(F.broadcast(lon))  # a grid has as many rows as its two axes multiply to, whatever the data
    return both.withColumn("lat_plane", centred(F.col("lat"), grid.lat.start, grid.lat.stop)).withColumn("lon_plane", centred(F.col("lon"), grid.lon.start, grid.lon.stop))


def levels(spark: SparkSession) -> DataFrame:
    """Levels with labels, nominal and actual depths, and the weight of the pair with the next one."""
    rows = F.array(*[F.struct(F.lit(k).alias("depth_k"), F.lit(f"{n}m").alias("label"), F.lit(n).alias("nominal_m"), F.lit(a).alias("actual_m"), F.lit(GATE[k] if k < len(GATE) else None).cast("double").alias("gate")) for k, (n, a) in enumerate(zip(NOMINAL_DEPTHS, ACTUAL_DEPTHS, strict=True))])
    return spark.range(1).select(F.explode(rows).alias("l")).select("l.*")


def with_bins(table: DataFrame, grid: Grid, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """table with lat_i and lon_j of the half-open bin that each row's place is in; rows outside the grid go."""
    binned = table.withColumn("lat_i", half_bin(F.col(lat), grid.lat.start, grid.lat.step)).withColumn("lon_j", half_bin(F.col(lon), grid.lon.start, grid.lon.step))
    return binned.where(F.col("lat_i").between(0, grid.lat.size - 1) & F.col("lon_j").between(0, grid.lon.size - 1))


def block_average(binned: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """The mean of the finite values (nulls aside) and their number, by cell and the columns of by; none gives null."""
    return binned.groupBy(*by, "lat_i", "lon_j").agg(F.avg(value).alias(value), F.count(value).alias("n"))


def _corner(x: Column, source: Axis) -> tuple[Column, Column]:
    """The source index below x and the share of the way to the next; the last point belongs to the last interval."""
    at = (x - F.lit(source.start)) / F.lit(source.step)
    low = F.least(F.floor(at), F.lit(source.size - 2)).cast("int")
    return low, at - low


def stencil(targets: DataFrame, lat: Axis, lon: Axis) -> DataFrame:
    """targets (lat_i, lon_j, lat, lon) with four source cells each: src_i, src_j, weight, and whether it is the nearest.

    Targets outside the source have no rows. In the middle between two sources the lower one is nearest.
    """
    inside = targets.where(F.col("lat").between(lat.start, lat.stop) & F.col("lon").between(lon.start, lon.stop))
    i, u = _corner(F.col("lat"), lat)
    j, v = _corner(F.col("lon"), lon)
    placed = inside.select("lat_i", "lon_j", i.alias("i"), u.alias("u"), j.alias("j"), v.alias("v"))
    near_i, near_j = (F.col("u") > 0.5).cast("int"), (F.col("v") > 0.5).cast("int")
    corners = [
        F.struct((F.col("i") + a).alias("src_i"), (F.col("j") + b).alias("src_j"), ((F.col("u") if a else 1 - F.col("u")) * (F.col("v") if b else 1 - F.col("v"))).alias("weight"), ((near_i == a) & (near_j == b)).alias("nearest"))
        for a in (0, 1)
        for b in (0, 1)
    ]
    return placed.select("lat_i", "lon_j", F.explode(F.array(*corners)).alias("c")).select("lat_i", "lon_j", "c.*")


def bilinear(source: DataFrame, weights: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """source (src_i, src_j, value) at the targets of weights: bilinear, where a corner is missing the nearest source's value.

    A missing corner makes the bilinear value missing even with weight 0. One shuffle; weights are as many as targets.
    """
    met = source.join(weights, ["src_i", "src_j"])
    full = F.when(F.count(value) == 4, F.sum(F.col("weight") * F.col(value)))
    return met.groupBy(*by, "lat_i", "lon_j").agg(F.coalesce(full, F.max(F.when(F.col("nearest"), F.col(value)))).alias(value), F.count(value).alias("n"))


def land_mask(binned: DataFrame, all_cells: DataFrame, value: str = "value", share: float = 0.5) -> DataFrame:
    """For every cell whether at least share of its source values are finite; a cell without sources is land. Takes the first day alone if there is a column day."""
    if "day" in binned.columns:
        binned = binned.join(F.broadcast(binned.agg(F.min("day").alias("day"))), "day", "left_semi")  # one row
    ocean = binned.groupBy("lat_i", "lon_j").agg((F.count(value) / F.count("*") >= share).alias("ocean"))
    return all_cells.select("lat_i", "lon_j").join(ocean, ["lat_i", "lon_j"], "left").withColumn("ocean", F.coalesce("ocean", F.lit(False)))


def apply_mask(table: DataFrame, mask: DataFrame, values: Sequence[str]) -> DataFrame:
    """values of ocean cells; those of land, or of cells that the mask lacks, are null. No row goes."""
    return table.join(mask, ["lat_i", "lon_j"], "left").withColumns({v: F.when(F.col("ocean"), F.col(v)) for v in values}).drop("ocean")


def unmasked_cells(table: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells of table that the mask doesn't know; there should be none."""
    return table.select("lat_i", "lon_j").distinct().join(mask, ["lat_i", "lon_j"], "left_anti")


def ocean_fractions(mask: DataFrame, columns: int) -> DataFrame:
    """The share of ocean in the whole, in four ranges of columns with both edges in, and in the west (up to the middle, which is east) and the east half."""
    share = F.avg(F.col("ocean").cast("double"))
    edges, j = [(columns - 1) * k / 4 for k in range(5)], F.col("lon_j")
    parts = {"all": F.lit(True), **{f"quarter{k + 1}": j.between(edges[k], edges[k + 1]) for k in range(4)}, "west": j < edges[2], "east": j >= edges[2]}
    tagged = mask.withColumn("part", F.explode(F.array(*[F.when(c, F.lit(n)) for n, c in parts.items()]))).where("part IS NOT NULL")
    return tagged.groupBy("part").agg(share.alias("share"), F.count("*").alias("cells"))


def checked_mask(mask: DataFrame, columns: int, least: float = 0.1) -> DataFrame:
    """mask, if each half has least of ocean; else an error, since the source then hardly covers the grid."""
    thin = {r.part: r.share for r in ocean_fractions(mask, columns).where(F.col("part").isin("west", "east") & (F.col("share") < least)).collect()}  # two rows
    if thin:
        raise RuntimeError(f"a half of the grid is nearly all land: {thin}")
    return mask


def checked_overlap(binned: DataFrame) -> DataFrame:
    """binned, if any row of a source is on the grid."""
    if binned.isEmpty():
        raise ValueError("the source doesn't overlap the grid")
    return binned


def complete(table: DataFrame, all_cells: DataFrame, days: DataFrame) -> DataFrame:
    """table (day, lat_i, lon_j, values) with a row for every cell on every day of days; what has no source is null."""
    places = all_cells.select("lat_i", "lon_j").crossJoin(days.select("day"))  # the size of the result
    return places.join(table, ["day", "lat_i", "lon_j"], "left")


def cropped(table: DataFrame, grid: Grid, to: Grid) -> DataFrame:
    """Rows of table (lat_i, lon_j on grid) that are on the part to of it, with that part's numbers."""
    i, j = (round((b.start - a.start) / a.step) for a, b in ((grid.lat, to.lat), (grid.lon, to.lon)))
    moved = table.withColumns({"lat_i": (F.col("lat_i") - i).cast("int"), "lon_j": (F.col("lon_j") - j).cast("int")})
    return moved.where(F.col("lat_i").between(0, to.lat.size - 1) & F.col("lon_j").between(0, to.lon.size - 1))


def padding(size: int, multiple: int) -> tuple[int, int]:
    """Rows before and behind that bring size to a multiple, the odd one before."""
    lack = -size % multiple
    return lack - lack // 2, lack // 2


def padded(spark: SparkSession, grid: Grid, multiple: int) -> DataFrame:
    """All places (pad_i, pad_j) of the grid padded to multiples, with the cell (lat_i, lon_j) that is there, null in the margin."""
    (top, bottom), (left, right) = padding(grid.lat.size, multiple), padding(grid.lon.size, multiple)
    rows = spark.range(top + grid.lat.size + bottom).select(F.col("id").cast("int").alias("pad_i"))
    columns = spark.range(left + grid.lon.size + right).select(F.col("id").cast("int").alias("pad_j"))
    i, j = F.col("pad_i") - top, F.col("pad_j") - left
    inside = i.between(0, grid.lat.size - 1) & j.between(0, grid.lon.size - 1)
    return rows.crossJoin(F.broadcast(columns)).withColumns({"lat_i": F.when(inside, i), "lon_j": F.when(inside, j)})  # as many rows as the padded grid


def pair_mask(target: DataFrame) -> DataFrame:
    """target (lat_i, lon_j, depth_k, valid): pairs of a level and the next one that are both valid."""
    below = target.select("lat_i", "lon_j", (F.col("depth_k") - 1).alias("depth_k"), F.col("valid").alias("below"))
    return target.join(below, ["lat_i", "lon_j", "depth_k"]).select("lat_i", "lon_j", "depth_k", (F.col("valid") & F.col("below")).alias("valid"))

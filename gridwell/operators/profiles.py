"""Profile observations: quality control, adjusted or raw values, depths, dense profile numbers, co-location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Grid
from ..sources import tables
from ..functions.scalars import finite, flag_text, half_bin, julian_to_timestamp, pressure_to_depth, wrap_longitude

GOOD_PROFILE, GOOD_LEVEL = ("1",), ("1", "2")


def _flag(table: DataFrame, name: str) -> Column:
    """A flag column as text, "" where the row has none (which passes nowhere); "1" where the table lacks the column."""
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) if name in table.columns else F.lit("1")


def _used_flag(table: DataFrame, name: str, adjusted: Column) -> Column:
    """The flag of the value that is used: an adjusted value's own, also where that is empty; without a column of these the raw flag, and without raw flags every level passes."""
    raw, own = f"{name}_qc", f"{name}_adj_qc"
    if raw not in table.columns or own not in table.columns:
        return _flag(table, raw)
    return F.when(adjusted, _flag(table, own)).otherwise(_flag(table, raw))


def tidy_levels(raw: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Level rows that pass quality control: time, lat, lon, pres, temp, adjusted, prof_key, depth_m and what names the profile.

    raw has lat, lon, juld, platform, cycle, data_mode, pres, temp, and may have pres_adj, temp_adj and flags *_qc. Adjusted
    values count in modes D and A where both are finite. Longitudes above 180 wrap; box is south, north, west, east.
    """
    south, north, west, east = box or Grid().box
    lon = wrap_longitude(F.col("lon"))
    placed = raw.withColumn("lon", lon).where(finite(F.col("lat")) & finite(F.col("lon")) & finite(F.col("juld")) & F.col("lat").between(south, north) & F.col("lon").between(west, east))
    placed = placed.where(_flag(raw, "position_qc").isin(*GOOD_PROFILE) & _flag(raw, "juld_qc").isin(*GOOD_PROFILE))
    if {"pres_adj", "temp_adj"} <= set(raw.columns):
        adjusted = F.coalesce(F.col("data_mode").isin("D", "A") & finite(F.col("pres_adj")) & finite(F.col("temp_adj")), F.lit(False))
        pres, temp = (F.when(adjusted, F.col(f"{c}_adj")).otherwise(F.col(c)) for c in ("pres", "temp"))
        pres_qc, temp_qc = (_used_flag(raw, c, adjusted) for c in ("pres", "temp"))
    else:
        adjusted, pres, temp = F.lit(False), F.col("pres"), F.col("temp")
        pres_qc, temp_qc = _flag(raw, "pres_qc"), _flag(raw, "temp_qc")
    chosen = placed.where(finite(pres) & finite(temp) & pres_qc.isin(*GOOD_LEVEL) & temp_qc.isin(*GOOD_LEVEL))
    platform = flag_text(F.col("platform"))
    return chosen.select(
        julian_to_timestamp(F.col("juld")).alias("time"), F.col("lat"), F.col("lon"), pres.alias("pres"), temp.alias("temp"), adjusted.alias("adjusted"),
        platform.alias("platform"), F.col("cycle").cast("int").alias("cycle"), F.col("data_mode"), F.concat_ws("_", platform, F.col("cycle").cast("string")).alias("prof_key"), pressure_to_depth(pres, F.col("lat")).alias("depth_m"),
    )


def profile_ids(levels: DataFrame) -> DataFrame:
    """Each prof_key with a number from 0, in the order of the keys.

    Keys are sorted by range and written once with their places, so that no later plan deals them otherwise; the parts' counts are added to the places, and no task sees all keys.
    """
    keys = levels.select("prof_key").distinct().repartitionByRange("prof_key").sortWithinPartitions("prof_key")
    marked = tables.kept(keys.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = marked.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row per partition
    return marked.join(F.broadcast(before), "part").select("prof_key", (F.col("at") + F.col("before")).cast("int").alias("profile_id"))


def profiles(levels: DataFrame, attributes: Sequence[str] = ("platform", "cycle", "data_mode"), ids: DataFrame | None = None) -> DataFrame:
    """A row per profile with the attributes of its first level by time and pressure; ids: what profile_ids gave, if it is known."""
    first = levels.groupBy("prof_key").agg(F.min_by(F.struct(*attributes), F.struct("time", "pres", *attributes)).alias("first"))
    return (profile_ids(levels) if ids is None else ids).join(first, "prof_key").select("profile_id", "prof_key", *[F.col(f"first.{a}").alias(a) for a in attributes])


def observations(levels: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Levels with their profile's number, sorted within each output part; ids: what profile_ids gave, if it is known."""
    return levels.join(profile_ids(levels) if ids is None else ids, "prof_key").repartitionByRange("time", "prof_key").sortWithinPartitions("time", "prof_key", "pres")


def write_year(levels: DataFrame, year: int, path: str) -> tuple[int, int]:
    """The levels of a year as two tables under path, observations by time and profiles by number, each in a folder of the year; returns how many rows they have.

    Levels of other years are left out. A year that is there is replaced; quality control runs once, before both tables are made.
    """
    own = tables.kept(levels.where(F.year("time") == year))
    ids = tables.kept(profile_ids(own))
    values = [F.col(c).cast("float").alias(c) for c in ("lat", "lon", "pres", "depth_m", "temp")]
    seen = observations(own, ids).select("time", *values, "profile_id", "adjusted")
    seen.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/observations/year={year}")
    profiles(own, ids=ids).repartitionByRange("profile_id").sortWithinPartitions("profile_id").write.mode("overwrite").parquet(f"{path}/profiles/year={year}")
    return own.count(), ids.count()


def colocated(levels: DataFrame, cube: DataFrame, grid: Grid, depths: Sequence[float], value: str = "value") -> DataFrame:
    """Levels with the cube's value (day, lat_i, lon_j, depth_k) of the same day, the nearest cell and the nearest level."""
    k = F.array_min(F.transform(F.array(*[F.struct(F.lit(d).alias("m"), F.lit(i).alias("k")) for i, d in enumerate(depths)]), lambda x: F.struct(F.abs(x["m"] - F.col("depth_m")).alias("off"), x["k"].alias("k"))))["k"]
    keyed = levels.withColumns({"day": F.to_date("time"), "lat_i": half_bin(F.col("lat"), grid.lat.start, grid.lat.step), "lon_j": half_bin(F.col("lon"), grid.lon.start, grid.lon.step), "depth_k": k})
    return keyed.join(cube.withColumnRenamed(value, "grid_value"), ["day", "lat_i", "lon_j", "depth_k"])

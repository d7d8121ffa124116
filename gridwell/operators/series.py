"""Daily series: calendars, alignment, gaps, statistics, climatology, trailing windows and lags."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import floored_root

CELL = ("lat_i", "lon_j")
DAYS = 366


def calendar(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """Every day from first to last: t from 0, day, year, doy."""
    days = spark.range((last - first).days + 1).select(F.col("id").cast("int").alias("t"), F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    return days.withColumns({"year": F.year("day"), "doy": F.dayofyear("day")})


def common_days(*tables: DataFrame, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """The days that all tables have, within first to last, ascending days once each."""
    days = None
    for table in tables:
        own = table.select(F.to_date("day").alias("day")).distinct()
        days = own if days is None else days.intersect(own)
    if first or last:
        days = days.where(F.col("day").between(first or dt.date.min, last or dt.date.max))
    return days


def align(table: DataFrame, days: DataFrame) -> DataFrame:
    return table.join(days, "day", "left_semi")


def checked_days(days: DataFrame, expected: int | None = None) -> DataFrame:
    """days, if there are any, as many as expected and without a gap; else an error that tells the first gaps."""
    n, first, last = days.agg(F.count("*"), F.min("day"), F.max("day")).first()
    if not n:
        raise ValueError("no common day")
    if (last - first).days + 1 != n:
        raise ValueError(f"gaps: {[tuple(r) for r in gaps(days).orderBy('after').limit(5).collect()]}")
    if expected is not None and n != expected:
        raise ValueError(f"{n} days, not {expected}")
    return days


def gaps(days: DataFrame, step: int = 1) -> DataFrame:
    """Where a day isn't step days after the one before: after, next, missing. days are as few as a calendar's."""
    before = F.lag("day").over(Window.orderBy("day"))
    return days.withColumn("after", before).where(F.datediff("day", "after") != step).select("after", F.col("day").alias("next"), (F.datediff("day", "after") - step).alias("missing"))


def islands(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive days (of one value of by): first, last, n."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy("day"))
    keyed = days.withColumn("run", F.date_sub(F.col("day"), number))
    return keyed.groupBy(*by, "run").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n")).drop("run")


def uneven_steps(times: DataFrame, time: str, by: Sequence[str], allowed: Sequence[int] = (3600, 86400)) -> DataFrame:
    """For each by: rows, seconds between neighbours at least and at most, repeated times, and whether all steps are one of allowed."""
    at = F.col(time).cast("timestamp")
    stretch = F.date_trunc("day", at)  # steps within a day are taken in many tasks, those between days from a row per day

    def step(here: str, before: Column) -> Column:
        return F.unix_seconds(F.col(here)) - F.unix_seconds(before)

    inner = times.select(*by, at.alias("_at"), stretch.alias("_day")).withColumn("_before", F.lag("_at").over(Window.partitionBy(*by, "_day").orderBy("_at")))
    daily = inner.groupBy(*by, "_day").agg(
        F.count("*").alias("n"), F.min(step("_at", F.col("_before"))).alias("least"), F.max(step("_at", F.col("_before"))).alias("most"),
        F.count_if(F.col("_at") == F.col("_before")).alias("repeated"), F.min("_at").alias("_first"), F.max("_at").alias("_last"),
    )
    between = step("_first", F.lag("_last").over(Window.partitionBy(*by).orderBy("_day")))
    out = daily.withColumn("_step", between).groupBy(*by).agg(F.sum("n").alias("n"), F.least(F.min("least"), F.min("_step")).alias("least"), F.greatest(F.max("most"), F.max("_step")).alias("most"), F.sum("repeated").alias("repeated"))
    return out.withColumn("regular", F.coalesce((F.col("least") == F.col("most")) & F.col("least").isin(list(allowed)), F.lit(False)))


# --- statistics ---------------------------------------------------------------------------------------------------


def long_form(table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A row (var, value) for each of values."""
    return table.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("var"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")).select(*keys, "x.var", "x.value")


def deviation(value: str | Column, strict: bool = False) -> Column:
    """The population standard deviation: 1 for under two values, else 1e-10 at least; strict: 1 for a constant."""
    value = F.col(value) if isinstance(value, str) else value
    own = floored_root(F.var_pop(value))
    if strict:
        own = F.when(F.var_pop(value) <= 1e-20, F.lit(1.0)).otherwise(own)
    return F.when(F.count(value) < 2, F.lit(1.0)).otherwise(own)


def moments(table: DataFrame, by: Sequence[str], value: str = "value", strict: bool = False) -> DataFrame:
    """n, mean and std of the non-null values by by. Partial sums combine before the shuffle."""
    return table.groupBy(*by).agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"), deviation(F.col(value).cast("double"), strict).alias("std"))


def accumulated(table: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mergeable moments n, mean, m2, for merge_moments."""
    v = F.col(value).cast("double")
    return table.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def merge_moments(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mergeable moments of the union of what the rows of parts stand for."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.nullif(F.sum("n"), F.lit(0)) * mean * mean
    return parts.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), (F.sum("m2") + F.greatest(between, F.lit(0.0))).alias("m2"))


def standardise(table: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std for the columns that stats has."""
    return table.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items() if c in table.columns})


def destandardise(table: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    return table.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in stats.items() if c in table.columns})


def input_anomalies(table: DataFrame, clim: Sequence[str], stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Variables that stats names as standardised anomalies: less {v}_clim, then by (mean, std); all others as they are. The columns of clim go."""
    return table.withColumns({v: (F.col(v) - F.col(f"{v}_clim") - F.lit(m)) / F.lit(s) for v, (m, s) in stats.items()}).drop(*clim)


def standardise_windows(table: DataFrame, stats: DataFrame, keys: Sequence[str] = ("w", "var"), value: str = "m") -> DataFrame:
    """Trailing means (w, var, m) by the constants of their own window and variable; stats has a row (w, var, mean, std) for each. Rows without constants are an error."""
    own = stats.select(*keys, F.col("mean").alias("_mean"), F.col("std").alias("_std"), F.lit(True).alias("_known"))
    joined = table.join(F.broadcast(own), list(keys), "left")  # a row per window and variable
    missing = F.raise_error(F.concat(F.lit("no constants for window "), F.concat_ws(" of ", *[F.col(k).cast("string") for k in keys]))).cast("double")
    return joined.withColumn(value, F.when(F.col("_known"), (F.col(value) - F.col("_mean")) / F.col("_std")).otherwise(missing)).drop("_mean", "_std", "_known")


def zero_filled(table: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Nulls and NaN of inputs as 0, after standardising; targets keep theirs."""
    return table.fillna(0.0, subset=list(inputs))


# --- climatology --------------------------------------------------------------------------------------------------


def doy_means(table: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean and number of the values of each day of the year, by by; only days that have rows."""
    return table.groupBy(*by, "doy").agg(F.avg(value).alias("clim"), F.count(value).alias("n"))


def thin_days(means: DataFrame, least: int = 5) -> DataFrame:
    """Days of the year with fewer than least values in a cell, those without any row among them with 0."""
    own = means.groupBy("doy").agg(F.min("n").alias("n"))
    every = means.sparkSession.range(1, DAYS + 1).select(F.col("id").cast("int").alias("doy"))
    return every.join(own, "doy", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < least)


def circular_smooth(means: DataFrame, by: Sequence[str], half: int, value: str = "clim") -> DataFrame:
    """The mean over half days either way on the ring of 366 days; days without a row count as 0.

    A cell's days are gathered into one array, 366 numbers, and smoothed there: one shuffle, and no row for each day that another reaches.
    """
    days = F.sequence(F.lit(1), F.lit(DAYS))
    rings = means.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("doy", value))).alias("own"))
    ring = F.transform(days, lambda d: F.coalesce(F.try_element_at("own", d), F.lit(0.0)))
    # behind the ring its beginning again, and before it its end: the window of day d then starts at place d
    rings = rings.where(F.size("own") > 0).withColumn("ring", ring).withColumn("ring", F.concat(F.slice("ring", DAYS - half + 1, half), "ring", F.slice("ring", 1, half)))
    total = F.transform(days, lambda d: F.aggregate(F.slice("ring", d, F.lit(2 * half + 1)), F.lit(0.0), lambda a, x: a + x) / F.lit(2 * half + 1))
    return rings.select(*by, F.posexplode(total).alias("doy", value)).withColumn("doy", F.col("doy") + 1)


def seasonal_share(anom: DataFrame, whole: DataFrame, by: Sequence[str]) -> DataFrame:
    """From the moments of standardised anomalies and those of the values: units of a standardised anomaly, and the season's share of the variance in per cent."""
    joined = anom.select(*by, F.col("std").alias("anom_std")).join(whole.select(*by, "std"), list(by))  # a row for each level
    return joined.select(*by, "anom_std", (F.col("anom_std") * F.col("std")).alias("scale"), (100 * (1 - F.col("anom_std") * F.col("anom_std"))).alias("share"))


def anomalies(table: DataFrame, clim: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """table with clim and anom = value - clim of its day of the year and by. A large climatology is shuffled, a small one Spark broadcasts."""
    return table.join(clim.select(*by, "doy", "clim"), [*by, "doy"], "left").withColumn("anom", F.col(value) - F.col("clim"))


def absolute(anom: Column, clim: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """The value that a scaled anomaly stands for."""
    return clim + anom * F.lit(scale) + F.lit(offset)


def running_mean(table: DataFrame, by: Sequence[str], window: int, value: str = "anom", order: str = "t") -> DataFrame:
    """rm{window}: the sum of the last window rows, this one included, by window; exactly 0 where fewer rows came before."""
    frame = Window.partitionBy(*by).orderBy(order)
    mean = F.sum(value).over(frame.rowsBetween(1 - window, 0)) / F.lit(float(window))
    return table.withColumn(f"rm{window}", F.when(F.row_number().over(frame) < window, F.lit(0.0)).otherwise(mean))


def lagged(table: DataFrame, by: Sequence[str], lags: Sequence[int], values: Sequence[str], order: str = "t") -> DataFrame:
    """{value}_lag{n} for every value and lag; the order must have no gaps."""
    frame = Window.partitionBy(*by).orderBy(order)
    return table.withColumns({f"{v}_lag{n}": F.lag(v, n).over(frame) if n else F.col(v) for v in values for n in lags})


def window_stats(table: DataFrame, windows: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Moments of rm{window} for each window, and how large its std is against that of the single days (anom)."""
    parts = table.select(*by, "anom", F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"rm{w}").alias("m")) for w in windows])).alias("x"))
    return parts.groupBy(*by, F.col("x.w").alias("w")).agg(F.count("x.m").alias("n"), F.avg("x.m").alias("mean"), deviation(F.col("x.m")).alias("std"), (deviation(F.col("x.m")) / deviation(F.col("anom"))).alias("ratio"))

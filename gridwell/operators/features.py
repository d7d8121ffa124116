"""Samples for learning: channels in a fixed order, targets with their climatology, batches as arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Inputs
from ..functions.scalars import season
from . import splits


def channel_names(inputs: Inputs) -> list[str]:
    """By lag, then by window, the variables; then the mask, the place and the season."""
    names = [f"{v}_lag{n}" for n in inputs.lags for v in inputs.variables] + [f"{v}_rm{w}" for w in inputs.windows for v in inputs.variables]
    return [*names, "ocean", "lat_plane", "lon_plane", "season_sin", "season_cos"]


def with_season(table: DataFrame, day: str = "day") -> DataFrame:
    sine, cosine = season(F.col(day))
    return table.withColumns({"season_sin": sine, "season_cos": cosine})


def channels(table: DataFrame, inputs: Inputs, keep: Sequence[str]) -> DataFrame:
    """keep and x, the array of inputs' channels as floats; a column that lacks is an error."""
    names = channel_names(inputs)
    if missing := [n for n in names if n not in table.columns]:
        raise KeyError(f"no columns {missing}")
    if len(names) != inputs.channels:
        raise ValueError(f"{len(names)} channels, not {inputs.channels}")
    return table.select(*keep, F.array(*[F.col(n).cast("float") for n in names]).alias("x"))


def profile_arrays(cube: DataFrame, keys: Sequence[str], n: int, value: str = "value") -> DataFrame:
    """Long levels (depth_k, value) as an array of n, null where a level lacks."""
    by_level = F.map_from_entries(F.collect_list(F.struct("depth_k", value)))
    return cube.groupBy(*keys).agg(by_level.alias("m")).select(*keys, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.try_element_at(F.col("m"), k.cast("int"))).alias("y"))


def with_climatology(anom: Column, clim: Column) -> Column:
    """Targets with their climatology behind them, in one array."""
    return F.concat(anom, clim)


def split_climatology(both: Column, n: int) -> tuple[Column, Column]:
    return F.slice(both, 1, n), F.slice(both, n + 1, n)


def datasets(samples: DataFrame, labelled: DataFrame, history: int) -> dict[str, DataFrame]:
    """samples (t, x, y) of train, val and test, days with less history before them left out."""
    return {name: samples.join(splits.split_rows(labelled, name, history).select("t"), "t", "left_semi") for name in splits.NAMES}


def tensors(samples: DataFrame, size: int, function, schema: str) -> DataFrame:
    """function(batch of rows as pandas) on every batch: the edge to a learning library. samples have a column batch."""

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            yield function(frame)

    return samples.repartition("batch").sortWithinPartitions("batch").mapInPandas(run, schema)

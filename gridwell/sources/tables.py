"""Product tables: partitioned Parquet in, Parquet, JSON and CSV out. Everything is lazy until it is written."""

from __future__ import annotations

import datetime as dt
import json
import tempfile
import uuid
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Grid
from ..functions.scalars import nan_to_null


def read_product(spark: SparkSession, path: str, columns: Mapping[str, str] | None = None, *, grid: Grid | None = None, years: Sequence[int] | None = None, required: Sequence[str] = (), first_level: str | None = None) -> DataFrame:
    """A product's table (partitioned by product, year or depth where it is) under common names.

    columns: new names by the file's. grid: rows in its padded box, both edges included. years: by the column
    year or day. first_level: a column of level numbers, of which 0 stays. Filters on plain columns reach the scan.
    Floating-point NaN and infinity become null; a missing required column is an error.
    """
    table = spark.read.parquet(path).withColumnsRenamed(dict(columns or {}))
    if missing := [c for c in required if c not in table.columns]:
        raise KeyError(f"{path} has no {missing}")
    if first_level:
        table = table.where(F.col(first_level) == 0).drop(first_level)
    if grid:
        south, north, west, east = grid.box
        table = table.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    if years is not None:
        if "year" in table.columns:
            table = table.where(F.col("year").isin(list(years)))
        else:
            table = table.where(F.col("day").between(f"{min(years)}-01-01", f"{max(years)}-12-31") & F.year("day").isin(list(years)))
    return table.withColumns({c: nan_to_null(F.col(c)) for c, kind in table.dtypes if kind in ("float", "double") and c not in ("lat", "lon")})


def read_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole files (path, modificationTime, length, content) that pattern names; unreadable ones are skipped."""
    return spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(pattern)


def read_parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The tables at paths below each other, by name, with nulls for columns that some lack."""
    first, *rest = [spark.read.parquet(p) for p in paths]
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def _document(spark: SparkSession, path: str) -> dict:
    """What a small JSON file has."""
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect()) or "{}")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics (var, mean, std) of a JSON file {var: {mean, std}}; entries without both, such as those of windows, are none."""
    held = {k: v for k, v in _document(spark, path).items() if isinstance(v, dict) and {"mean", "std"} <= v.keys()}
    return spark.createDataFrame([(k, float(v["mean"]), float(v["std"])) for k, v in held.items()], "var string, mean double, std double")


def scratch(spark: SparkSession) -> str:
    """The folder for tables of a run: spark.checkpoint.dir, which a cluster shares; only a local session without one gets its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="scratch-"))
    return context._jsc.sc().getCheckpointDir().get()


def kept(table: DataFrame) -> DataFrame:
    """table, written once to the run's folder and read from there, so that every plan on it reads the same rows."""
    folder = f"{scratch(table.sparkSession)}/kept-{uuid.uuid4().hex}"
    table.write.parquet(folder)
    return table.sparkSession.read.parquet(folder)


def replace_parts(table: DataFrame, path: str, *parts: str) -> None:
    """table partitioned by its columns parts; parts that it has replace what is there, others stay."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*parts).parquet(path)


def write_years(table: DataFrame, path: str) -> None:
    """table, which has a column year, by year; years that it has replace what is there, others stay."""
    replace_parts(table, path, "year")


def append(table: DataFrame, path: str) -> None:
    """table behind what is at path; its columns must be those that are there."""
    table.write.mode("append").parquet(path)


def write_by_day(table: DataFrame, path: str, group_bytes: int = 8 << 20) -> None:
    """table (with day) for access by days: a folder a year, files of ranges of days, rows sorted by day in small row groups, whose statistics tell which days they hold."""
    sorted_rows = table.withColumn("year", F.year("day")).repartitionByRange("year", "day").sortWithinPartitions("year", "day")
    sorted_rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", group_bytes).partitionBy("year").parquet(path)


def day_ranges(days: Iterable[dt.date], most: int = 64) -> list[tuple[dt.date, dt.date]]:
    """Ranges (first and last) that cover days; at most so many, by closing the smallest gaps."""
    held = sorted(set(days))
    if not held:
        return []
    gaps = sorted(((b - a).days, i) for i, (a, b) in enumerate(zip(held, held[1:], strict=False)))
    cuts = sorted(i for days_apart, i in gaps[-(most - 1) :] if days_apart > 1) if most > 1 else []
    starts, ends = [0, *(i + 1 for i in cuts)], [*cuts, len(held) - 1]
    return [(held[a], held[b]) for a, b in zip(starts, ends, strict=True)]


def read_days(spark: SparkSession, path: str, days: Sequence[dt.date], most: int = 64) -> DataFrame:
    """The rows of these days, as many as a batch or a split has, of what write_by_day left at path.

    Ranges of days reach the scan, and years its folders, so other files and row groups aren't read; a join by day keeps the days themselves.
    """
    table, ranges = spark.read.parquet(path), day_ranges(days, most)
    if not ranges:
        return table.where(F.lit(False)).drop("year")
    within = [F.col("day").between(F.lit(a), F.lit(b)) for a, b in ranges]
    held = table.where(F.col("year").isin(sorted({d.year for d in days}))).where(reduce(lambda a, b: a | b, within))
    asked = spark.createDataFrame([(d,) for d in sorted(set(days))], "day date")
    return held.drop("year").join(F.broadcast(asked), "day", "left_semi")  # a row per day that the caller named


def write_metrics(table: DataFrame, path: str) -> None:
    """table as CSV and JSON under path."""
    table.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    table.write.mode("overwrite").json(f"{path}/json")


def merged_stats(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with new's values where new has the key and a value, and new's other rows; columns that only one has stay."""
    values = dict.fromkeys(c for c in (*old.columns, *new.columns) if c not in keys)
    both = old.alias("o").join(new.alias("n"), list(keys), "full_outer")
    return both.select(*keys, *[F.coalesce(*[F.col(f"{side}.{c}") for side, table in (("n", new), ("o", old)) if c in table.columns]).alias(c) for c in values])


def _merge_document(spark: SparkSession, path: str, more: dict) -> None:
    """A small JSON file with more in it; dictionaries are merged, whatever else has a key is replaced, and other keys stay."""
    try:
        old = _document(spark, path)
    except Exception as e:  # no such file
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = {}

    def merged(a: object, b: object) -> object:
        return a | {k: merged(a.get(k), v) for k, v in b.items()} if isinstance(a, dict) and isinstance(b, dict) else b

    text = json.dumps(merged(old, more), sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """stats (var and its constants) as one JSON file {var: {constant: value}}, as read_stats takes it; what other keys the file has stays."""
    rows = {r["var"]: {k: v for k, v in r.asDict().items() if k != "var" and v is not None} for r in stats.collect()}  # a row per variable
    _merge_document(stats.sparkSession, path, rows)


def write_window_stats(stats: DataFrame, path: str) -> None:
    """Constants (w, var, mean, std) into the JSON file that read_window_stats takes; what else it has stays."""
    held: dict[str, dict] = {}
    for r in stats.collect():  # a row per window and variable
        held.setdefault(str(r.w), {})[r["var"]] = {"mean": r["mean"], "std": r["std"]}
    _merge_document(stats.sparkSession, path, {"windows": held})


def read_window_stats(spark: SparkSession, path: str) -> DataFrame:
    """Constants (w, var, mean, std) of a JSON file that has them as {"windows": {w: {var: {mean, std}}}}; none where it has no windows."""
    held = _document(spark, path).get("windows", {})
    rows = [(int(w), v, float(s["mean"]), float(s["std"])) for w, of in held.items() for v, s in of.items()]
    return spark.createDataFrame(rows, "w int, var string, mean double, std double")

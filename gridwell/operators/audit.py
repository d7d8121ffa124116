"""Rules on data: each gives rows (rule, passed, detail), and a ledger collects them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite


def rule(table: DataFrame, name: str, passed: Column, detail: Column | None = None) -> DataFrame:
    """One row: whether the aggregate passed holds over table; null counts as not."""
    return table.agg(F.coalesce(passed, F.lit(False)).alias("passed"), (detail if detail is not None else F.lit("")).cast("string").alias("detail")).select(F.lit(name).alias("rule"), "passed", "detail")


def nothing(table: DataFrame, name: str) -> DataFrame:
    """Passes if table has no rows."""
    return rule(table, name, F.count("*") == 0, F.count("*"))


def ledger(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def failed(of: DataFrame) -> bool:
    return not of.where(~F.col("passed")).isEmpty()


def _rules(table: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each rule: whether its aggregate holds over table, and its detail. One scan for all rules."""
    rows = [F.struct(F.lit(name).alias("rule"), F.coalesce(passed, F.lit(False)).alias("passed"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")) for name, (passed, detail) in rules.items()]
    return table.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def mask_rules(mask: DataFrame, cells: int, ocean: tuple[int, int]) -> DataFrame:
    """Rules on mask (lat_i, lon_j, ocean): each of cells once, ocean known everywhere, and as many ocean cells as ocean allows."""
    wet, unknown = F.count_if("ocean"), F.count_if(F.col("ocean").isNull())
    return _rules(mask, {
        "every cell once": ((F.count("*") == cells) & (F.countDistinct("lat_i", "lon_j") == cells), F.count("*")),
        "ocean or land": (unknown == 0, unknown),
        "ocean cells plausible": (wet.between(*ocean), wet),
    })


def split_rules(table: DataFrame, cells: int, days: tuple[object, object], inputs: Sequence[str], targets: Sequence[str], tolerances: tuple[float, float] | None = None) -> DataFrame:
    """Rules on a standardised split (day, lat_i, lon_j, variables) that should have every cell on every day from days[0] to days[1].

    Days and cells are complete and met once; inputs have no nulls, targets have some; with tolerances (for the
    training split) means are near 0 and deviations near 1. One scan of all days instead of a sample of them.
    """
    first, last = (F.lit(d).cast("date") for d in days)
    expected = F.datediff(last, first) + 1
    rules = {
        "first day": (F.min("day") == first, F.min("day")),
        "last day": (F.max("day") == last, F.max("day")),
        "no gaps in days": (F.countDistinct("day") == expected, F.countDistinct("day")),
        "every cell once a day": ((F.count("*") == expected * F.lit(cells)) & (F.countDistinct("day", "lat_i", "lon_j") == F.count("*")), F.count("*")),
    }
    rules |= {f"{c} has no nulls": (F.count_if(F.col(c).isNull()) == 0, F.count_if(F.col(c).isNull())) for c in inputs}
    rules |= {f"{c} keeps nulls": (F.count_if(F.col(c).isNull()) > 0, F.count_if(F.col(c).isNull())) for c in targets}
    if tolerances:
        for c in (*inputs, *targets):
            rules[f"{c} is standardised"] = ((F.abs(F.avg(c)) < tolerances[0]) & (F.abs(F.stddev_pop(c) - 1) < tolerances[1]), F.format_number(F.stddev_pop(c), 3))
    return _rules(table, rules)


def value_profile(table: DataFrame, columns: Sequence[str], limit: float = 25.0) -> DataFrame:
    """For each column: nulls, NaN, infinities, least and largest finite value, and values beyond limit. One scan."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        own = F.when(finite(x), x)
        parts.append(F.struct(F.lit(c).alias("var"), F.count_if(x.isNull()).alias("nulls"), F.count_if(F.isnan(x)).alias("nans"), F.count_if(F.abs(x) == float("inf")).alias("infinite"), F.min(own).alias("least"), F.max(own).alias("most"), F.count_if(F.abs(own) > limit).alias("beyond")))
    return table.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def year_audit(table: DataFrame, values: Sequence[str], least_finite: int, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """For each year: days, first and last, repeated cells, finite values at least, and values beyond bounds. All rows are shuffled once."""
    counts = {f"_{v}": F.count(v) for v in values} | {f"{c}_beyond": F.count_if(~F.col(c).between(a, b)) for c, (a, b) in bounds.items()}
    totals = [F.sum(c).alias(c) for c in counts]
    cells = table.groupBy("year", "day", "lat_i", "lon_j").agg(F.count("*").alias("n"), *[x.alias(c) for c, x in counts.items()])
    days = cells.groupBy("year", "day").agg(F.sum("n").alias("n"), F.count("*").alias("cells"), *totals)
    years = days.groupBy("year").agg(F.count("*").alias("days"), F.min("day").alias("first"), F.max("day").alias("last"), (F.sum("n") - F.sum("cells")).alias("repeated"), *totals)
    found = years.withColumn("finite", F.least(*[F.col(f"_{v}") for v in values], F.lit(1 << 60))).drop(*[f"_{v}" for v in values])
    return found.select("year", "days", "first", "last", "repeated", "finite", *[f"{c}_beyond" for c in bounds]).withColumn("enough", F.col("finite") > least_finite)


def stats_plausibility(stats: DataFrame, bounds: DataFrame) -> DataFrame:
    """Each var of bounds (var, mean_lo, mean_hi, std_lo, std_hi) with whether stats has it within them and with a positive std."""
    ok = F.col("mean").between(F.col("mean_lo"), F.col("mean_hi")) & F.col("std").between(F.col("std_lo"), F.col("std_hi")) & (F.col("std") > 0)
    return bounds.join(stats, "var", "left").select("var", "mean", "std", F.coalesce(ok, F.lit(False)).alias("passed"))


def missing_keys(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(present, list(keys), "left_anti")


def null_places(table: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Cells that are null somewhere, for each of by."""
    return table.where(F.col(value).isNull()).select(by, "lat_i", "lon_j").distinct()


def same_null_places(places: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Cells that are null in one of a and b alone."""
    one, two = (places.where(F.col(by) == x).select("lat_i", "lon_j") for x in (a, b))
    return one.subtract(two).unionByName(two.subtract(one))


def edge_shares(table: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """The share of finite values on the first and on the last day of each by."""
    daily = table.groupBy(*by, "day").agg(F.avg(finite(F.col(value).cast("double")).cast("double")).alias("share"))
    return daily.groupBy(*by).agg(F.min_by("share", "day").alias("first"), F.max_by("share", "day").alias("last"))


def status_counts(checked: DataFrame, statuses: Sequence[str] = ("ok", "missing", "failed")) -> DataFrame:
    return checked.groupBy("source").pivot("status", list(statuses)).count().fillna(0)


def ready(required: DataFrame, present: DataFrame, keys: Sequence[str], by: str = "year") -> DataFrame:
    """For each by of required: whether all is present, and how much lacks."""
    marked = required.join(present.select(*keys).distinct().withColumn("there", F.lit(1)), list(keys), "left")
    return marked.groupBy(by).agg(F.count_if(F.col("there").isNull()).alias("missing")).withColumn("ready", F.col("missing") == 0)


def changed_settings(spark: SparkSession, old: Mapping, new: Mapping) -> DataFrame:
    """Settings that differ: name, old, new, as text."""
    rows = [(k, str(old.get(k)), str(new.get(k))) for k in sorted({*old, *new}) if old.get(k) != new.get(k)]
    return spark.createDataFrame(rows, "name string, old string, new string")


def file_problems(present: DataFrame, steps: DataFrame, shares: DataFrame, least: float = 0.05) -> DataFrame:
    """What is wrong with present files, as rows (file, problem).

    present: file, variable, kind (its type; only floating-point ones pass). steps: file, least, most, repeated, regular, as of
    uneven_steps. shares: file, variable, first, last, the shares of finite values on the first and last day, of which
    each should be least at least.
    """
    kinds = present.where(~F.col("kind").isin("float", "double")).select("file", F.concat("variable", F.lit(" is of type "), "kind").alias("problem"))
    times = steps.select("file", F.when(F.col("repeated") > 0, F.lit("times repeat")).when(~F.col("regular"), F.lit("uneven steps")).alias("problem")).where("problem IS NOT NULL")
    edge = F.explode(F.array(*[F.struct(F.lit(c).alias("edge"), F.col(c).alias("share")) for c in ("first", "last")]))
    thin = shares.select("file", "variable", edge.alias("e")).where(F.coalesce(F.col("e.share"), F.lit(0.0)) < least)
    word = F.when(F.coalesce(F.col("e.share"), F.lit(0.0)) == 0, F.lit(" day has no values of ")).otherwise(F.lit(" day has few values of "))
    return kinds.unionByName(times).unionByName(thin.select("file", F.concat("e.edge", word, "variable").alias("problem")))


def file_audit(planned: DataFrame, present: DataFrame, problems: DataFrame) -> DataFrame:
    """Each file of planned (source, file) with status (missing, failed or ok) and its problems, sorted."""
    there = present.select("file").distinct().withColumn("there", F.lit(True))
    listed = problems.groupBy("file").agg(F.array_sort(F.collect_set("problem")).alias("problems"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("problems").isNotNull(), "failed").otherwise("ok")
    marked = planned.join(there, "file", "left").join(listed, "file", "left").withColumn("status", status)
    return marked.select("source", "file", "status", F.when(F.col("there"), F.coalesce("problems", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("problems"))


def files(table: DataFrame) -> DataFrame:
    """The Parquet files of table: name, rows, bytes, and the compression that the name tells."""
    name = F.col("_metadata.file_name")
    own = table.select(name.alias("name"), F.col("_metadata.file_size").alias("bytes")).groupBy("name").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes"))
    return own.withColumn("codec", F.nullif(F.regexp_extract("name", r"\.(\w+)\.parquet$", 1), F.lit("")))

"""python -m gridwell COMMAND: plan, verify, profiles, record, splits, climatology, fit, search or evaluate. Each prints a table, and ends with 1 if something isn't right."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import COVERAGE, RECORD, VERSIONS, Axis, Inputs, expected_days, split_mode
from .operators import audit, fitting, grids, profiles, scores, series, splits
from .plans import climatology, requests
from .plans.record import PHASES, Product, Record
from .sources import classic, runs, tables


def version(name: str | None) -> str:
    """The record's version: name, else that of the environment, else the newest."""
    chosen = name or os.environ.get("GRIDWELL_VERSION", max(VERSIONS))
    if chosen not in VERSIONS:
        raise KeyError(f"{chosen} is none of {sorted(VERSIONS)}")
    return chosen


def plan(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The files of products and years, in the order of fetching."""
    return requests.files(requests.plan(spark, args.products, args.years, requests.all_levels(), args.depths)).orderBy("place")


def verify(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Files of the plan that are under a folder as Parquet, with what is wrong with each: types, times that repeat or are uneven, too few days, first or last days without values."""
    planned, rows, parts, places = plan(spark, args), [], [], []
    for r in planned.select("file").collect():  # a row per file of the plan
        try:
            table = spark.read.parquet(f"{args.folder}/{r.file}")
        except Exception as e:  # missing
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            continue
        keys = [c for c in ("day", "lat", "lon", "depth") if c in table.columns]
        values = [c for c in table.columns if c not in keys]
        rows += [(r.file, c, dict(table.dtypes)[c]) for c in values]
        numbers = [c for c in values if dict(table.dtypes)[c] in ("float", "double")]
        parts.append(series.long_form(table.withColumn("file", F.lit(r.file)), ["file", "day"], numbers))
        places.append(table.groupBy(F.lit(r.file).alias("file"), *keys).agg(F.count("*").alias("n")).groupBy("file", "day").agg(F.count_if(F.col("n") > 1).alias("repeated")))
    present = spark.createDataFrame(rows, "file string, variable string, kind string")
    long = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "file string, day date, var string, value double")
    days = reduce(DataFrame.unionByName, places) if places else spark.createDataFrame([], "file string, day date, repeated long")
    held = days.groupBy("file").agg(F.count("*").alias("held"), F.sum("repeated").alias("repeated"))
    steps = series.uneven_steps(days, "day", ["file"]).drop("repeated").join(held.select("file", "repeated"), "file")
    shares = audit.edge_shares(long.withColumnRenamed("var", "variable"), ["file", "variable"])
    few = held.join(planned.select("file", "days"), "file").where("held < days").select("file", F.concat(F.col("held").cast("string"), F.lit(" days of "), F.col("days").cast("string")).alias("problem"))
    found = audit.file_audit(planned, present, audit.file_problems(present, steps, shares).unionByName(few))
    return found if args.all else found.where("status != 'ok'")


def record(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The record of the products that a JSON file describes: {name: {path, columns, how, lat, lon}}."""
    with open(args.products, encoding="utf-8") as f:
        given = json.load(f)
    products = {k: Product(p["path"], p["columns"], p.get("how", "bilinear"), *(Axis(*p[a]) if a in p else None for a in ("lat", "lon"))) for k, p in given.items()}
    own = Record(spark, args.folder, products, split_mode(args.mode), VERSIONS[version(args.version)], args.mask, args.inputs, Inputs().history, lambda y: min(expected_days(y, k) for k in products))
    return splits.summary(own.run(args.phase).select("day", "split").distinct())


def split(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The days of each split of the whole record."""
    return splits.summary(splits.day_labels(series.calendar(spark, *RECORD), split_mode(args.mode), args.history))


def evaluate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Scores by level of a table (t, lat_i, lon_j, depth_k, truth, pred, clim); all of them go to a folder if one is named."""
    rows = spark.read.parquet(args.predictions).dropna(subset=["truth", "pred", "clim"])
    metrics = scores.level_metrics(rows)
    if args.to:
        tables.write_metrics(metrics, args.to)
        tables.write_metrics(scores.overall(metrics), f"{args.to}/overall")
        tables.write_metrics(scores.bundle(rows, grids.levels(spark).dropna(subset=["gate"])), f"{args.to}/bundle")
    return metrics.orderBy("depth_k")


def climate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The climatology of a record, its anomalies and trailing means; prints the statistics of the means."""
    history = Inputs(windows=args.windows).history
    if args.running_means_only:
        climatology.running_means(spark, args.folder, args.windows, history, args.since)
    else:
        climatology.build(spark, args.record, args.folder, args.variables, args.windows, args.half, history)
    return tables.read_window_stats(spark, f"{args.folder}/stats").orderBy("w", "var")


def fit(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Fits samples (x, y, split) at a path, going on where the folder's last epoch ended; prints the epochs."""
    how = fitting.Fit(epochs=args.epochs, rate=args.rate, ridge=args.ridge)
    fitting.fit(spark.read.parquet(args.samples), how, args.folder)
    return fitting.history(spark, args.folder).orderBy("epoch")


def search(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Searches rates and ridges for the smallest validation loss of samples (x, y, split); goes on with the folder's trials, and prints them, the best first."""
    samples = spark.read.parquet(args.samples)
    space = fitting.Space({"rate": [10.0**-k for k in range(1, 5)], "ridge": [10.0**-k for k in range(1, 7)]}, ("rate", "ridge"))

    def objective(s: dict) -> float:
        name = runs.fingerprint(s)[:16]
        return fitting.fit(samples, fitting.Fit(epochs=args.epochs, rate=s["rate"], ridge=s["ridge"]), f"{args.folder}/fits/{name}").best_loss

    trials = fitting.search(spark, space, objective, f"{args.folder}/trials", args.trials, {"samples": args.samples, "epochs": args.epochs}, args.hours * 3600)
    rows = [(t["rate"], t["ridge"], t["objective"], t["error"]) for t in trials]
    return spark.createDataFrame(rows, "rate double, ridge double, objective double, error string").orderBy(F.col("objective").asc_nulls_last(), "rate", "ridge")


def argo(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Decodes profile files and writes the good levels of each year as observations and profiles; prints the years, and files that can't be decoded."""
    decoded = tables.kept(classic.read_profile_files(spark, args.pattern))
    levels = tables.kept(profiles.tidy_levels(decoded.where("error = ''")))
    years = sorted(r.y for r in levels.select(F.year("time").alias("y")).distinct().collect())  # a row per year
    made = [(str(y), *map(str, profiles.write_year(levels, y, args.folder))) for y in years]
    bad = decoded.where("error != ''").select("path", F.lit("failed"), "error")
    return spark.createDataFrame(made, "what string, levels string, profiles string").unionByName(bad.toDF("what", "levels", "profiles"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m gridwell", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for run in (plan, verify):
        own = commands.add_parser(run.__name__, help=run.__doc__)
        own.add_argument("--products", nargs="+", choices=sorted(COVERAGE), default=["glorys", "oisst", "sla", "sss"])
        own.add_argument("--years", nargs="+", default=list(range(RECORD[0].year, RECORD[1].year + 1)))
        own.add_argument("--depths", nargs=2, type=float, metavar=("LEAST", "MOST"))
        own.set_defaults(run=run)
    own.add_argument("folder", nargs="?", help="may follow the years")
    own.add_argument("--all", action="store_true", help="files without problems too")
    own = commands.add_parser("record", help=record.__doc__)
    own.add_argument("products")
    own.add_argument("folder")
    own.add_argument("--mode", default="chronological")
    own.add_argument("--version")
    own.add_argument("--mask", default="thetao_0m")
    own.add_argument("--inputs", nargs="*", default=[])
    own.add_argument("--phase", choices=PHASES, default=PHASES[0])
    own.set_defaults(run=record)
    own = commands.add_parser("splits", help=split.__doc__)
    own.add_argument("--mode", default="chronological")
    own.add_argument("--history", type=int, default=0, help="days that inputs reach back; a shorter buffer is refused")
    own.set_defaults(run=split)
    own = commands.add_parser("evaluate", help=evaluate.__doc__)
    own.add_argument("predictions")
    own.add_argument("--to")
    own.set_defaults(run=evaluate)
    own = commands.add_parser("climatology", help=climate.__doc__)
    own.add_argument("folder")
    own.add_argument("--record")
    own.add_argument("--variables", nargs="+", default=[])
    own.add_argument("--windows", nargs="+", type=int, default=[30, 90])
    own.add_argument("--half", type=int, default=7, help="days either way that the climatology is smoothed over")
    own.add_argument("--running-means-only", action="store_true", help="from the anomalies that are there")
    own.add_argument("--since", type=int, help="the first day (t) that was added; earlier blocks of means stay")
    own.set_defaults(run=climate)
    for run in (fit, search):
        own = commands.add_parser(run.__name__, help=run.__doc__)
        own.add_argument("samples")
        own.add_argument("folder")
        own.add_argument("--epochs", type=int, default=200)
        own.set_defaults(run=run)
        if run is fit:
            own.add_argument("--rate", type=float, default=0.05)
            own.add_argument("--ridge", type=float, default=0.0)
        else:
            own.add_argument("--trials", type=int, default=12)
            own.add_argument("--hours", type=float, default=6.0, help="no trial begins later")
    own = commands.add_parser("profiles", help=argo.__doc__)
    own.add_argument("pattern")
    own.add_argument("folder")
    own.set_defaults(run=argo)
    return top


def arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    """The parsed arguments; a folder that follows a list of years is taken from its end."""
    top = parser()
    args = top.parse_args(argv)
    if args.command == "verify" and args.folder is None:
        if len(args.years) < 2:
            top.error("verify needs a folder")
        args.folder = str(args.years.pop())
    if args.command in ("plan", "verify"):
        if not all(str(y).isdigit() for y in args.years):
            top.error(f"years must be whole numbers: {args.years}")
        args.years = [int(y) for y in args.years]
    return args


def main(argv: Sequence[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("gridwell").getOrCreate()
    rows = args.run(spark, args).collect()  # a plan, a report or a summary
    for row in rows:
        print("\t".join(map(str, row)))
    return int(args.command == "verify" and any(r.status != "ok" for r in rows))


if __name__ == "__main__":
    sys.exit(main())

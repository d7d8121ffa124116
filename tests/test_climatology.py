"""The climatology driver against the operators it is made of, and the commands."""

import datetime as dt
import random

from pyspark.sql import functions as F

from gridwell import __main__ as cli
from gridwell.operators import series, splits
from gridwell.plans import climatology
from gridwell.sources import tables


def make_record(spark, path, days):
    rng = random.Random(2)
    first = dt.date(2001, 1, 1)
    rows = []
    for t in range(days):
        day = first + dt.timedelta(days=t)
        for j in range(3):
            rows.append((t, day, day.timetuple().tm_yday, "val" if day.year == 2002 else "train", 0, j, rng.gauss(j, 1), None if j == 2 else rng.gauss(0, 3)))
    table = spark.createDataFrame(rows, "t int, day date, doy int, split string, lat_i int, lon_j int, sst double, sla double")
    table.write.mode("overwrite").parquet(path)


def same(a, b, keys, value):
    joined = a.join(b.withColumnRenamed(value, "_v"), keys)
    assert joined.count() == a.count() == b.count()
    assert joined.where(~F.col(value).eqNullSafe(F.col("_v")) & ~(F.abs(F.col(value) - F.col("_v")) < 1e-9)).count() == 0


def test_driver(spark, tmp_path, capsys):
    record, folder = str(tmp_path / "record"), str(tmp_path / "clim")
    make_record(spark, record, 900)
    assert cli.main(["climatology", folder, "--record", record, "--variables", "sst", "sla", "--windows", "5", "30", "--half", "3"]) == 0
    assert [tuple(x.split("\t")[:2]) for x in capsys.readouterr().out.strip().split("\n")] == [("5", "sla"), ("5", "sst"), ("30", "sla"), ("30", "sst")]
    table = spark.read.parquet(record)
    for v in ("sst", "sla"):
        one = table.withColumnRenamed(v, "value")
        clim = series.circular_smooth(series.doy_means(one.where("split = 'train'"), series.CELL), series.CELL, 3)
        made = spark.read.parquet(f"{folder}/climatology").where(F.col("var") == v).drop("var")
        same(made, clim, ["lat_i", "lon_j", "doy"], "clim")
        anom = series.anomalies(one, clim, series.CELL)
        held = spark.read.parquet(f"{folder}/means").where(F.col("var") == v)
        for w in (5, 30):
            same(held.select("t", "lat_i", "lon_j", f"rm{w}"), series.running_mean(anom, series.CELL, w).select("t", "lat_i", "lon_j", f"rm{w}"), ["t", "lat_i", "lon_j"], f"rm{w}")
        stats = {r["var"]: (r["mean"], r["std"]) for r in tables.read_stats(spark, f"{folder}/stats").collect()}[v]
        want = series.moments(anom.where("split = 'train'"), [], "anom").first()
        assert abs(stats[0] - want["mean"]) < 1e-9 and abs(stats[1] - want["std"]) < 1e-9
    # days that are added make their blocks anew, and no others
    make_record(spark, record, 960)
    climatology.add(spark, record, folder, ["sst", "sla"], since=900)
    assert climatology.running_means(spark, folder, (5, 30), since=900) == [6, 7]
    grown = spark.read.parquet(f"{folder}/means")
    assert grown.agg(F.max("t")).first()[0] == 959 and grown.count() == 960 * 6
    whole = str(tmp_path / "whole")
    cli.main(["climatology", whole, "--record", record, "--variables", "sst", "sla", "--windows", "5", "30", "--half", "3"])
    a, b = ({(r.w, r["var"]): r["std"] for r in tables.read_window_stats(spark, f"{f}/stats").collect()} for f in (folder, whole))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.2 for k in a)  # the climatology of the first is of fewer days
    rows = splits.split_rows(grown, "train", 89)
    assert rows.count() == (960 - 365 - 89) * 6


def test_fit_and_search_commands(spark, tmp_path, capsys):
    rng = random.Random(3)
    rows = [([x, z], [2 * x - z + 1], "val" if k % 4 == 0 else "train") for k in range(200) for x, z in [(rng.gauss(0, 1), rng.gauss(0, 1))]]
    spark.createDataFrame(rows, "x array<double>, y array<double>, split string").write.parquet(str(tmp_path / "s"))
    assert cli.main(["fit", str(tmp_path / "s"), str(tmp_path / "fit"), "--epochs", "4", "--rate", "0.5"]) == 0
    out = capsys.readouterr().out.strip().split("\n")
    assert len(out) == 4 and out[-1].endswith("all epochs")
    assert cli.main(["search", str(tmp_path / "s"), str(tmp_path / "search"), "--epochs", "2", "--trials", "3"]) == 0
    out = [x.split("\t") for x in capsys.readouterr().out.strip().split("\n")]
    assert len(out) == 3 and float(out[0][2]) <= float(out[1][2]) <= float(out[2][2])

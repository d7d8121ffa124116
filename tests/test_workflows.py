"""The record's phases and the growing statistics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridwell.config import Axis, Grid, SplitMode
from gridwell.plans.record import Product, Record
from gridwell.streaming.moments import follow, moments_so_far

GRID = Grid(Axis(5.0, 6.0, 0.25), Axis(50.0, 51.0, 0.25))


@pytest.fixture
def products(spark, tmp_path):
    days = spark.range(4).select(F.date_add(F.lit(dt.date(2000, 12, 30)), F.col("id").cast("int")).alias("day"))
    fine = days.crossJoin(spark.range(16).select((F.lit(4.9) + F.col("id") / 12.0).alias("lat"))).crossJoin(spark.range(16).select((F.lit(49.9) + F.col("id") / 12.0).alias("lon")))
    sea = fine.withColumn("thetao", F.when(F.col("lon") < 50.6, F.lit(20.0) + F.dayofyear("day") % 7))
    coarse = days.where("day < '2001-01-02'").crossJoin(spark.range(4).select((F.lit(4.875) + F.col("id") * 0.5).alias("lat"))).crossJoin(spark.range(4).select((F.lit(49.875) + F.col("id") * 0.5).alias("lon")))
    sea.write.parquet(str(tmp_path / "thetao"))
    coarse.withColumn("sla", F.col("lat") + F.dayofmonth("day")).write.parquet(str(tmp_path / "sla"))
    return {
        "glorys": Product(str(tmp_path / "thetao"), {"thetao": "thetao_0m"}, "block"),
        "sla": Product(str(tmp_path / "sla"), {"sla": "sla"}, "bilinear", Axis(4.875, 6.375, 0.5), Axis(49.875, 51.375, 0.5)),
    }


def test_record_phases(spark, tmp_path, products):
    record = Record(spark, str(tmp_path / "out"), products, SplitMode((), (2001,)), GRID, inputs=["sla"])
    rows = record.run()
    assert record.read("mask").where("ocean").count() == 15
    assert rows.count() == 3 * 25 and rows.where("sla is null").count() == 0 and rows.where("thetao_0m is null").count() == 30
    assert {r.split for r in rows.select("split").distinct().collect()} == {"train", "test"}
    train = rows.where("split = 'train' and thetao_0m is not null")
    assert train.agg(F.avg("sla"), F.stddev_pop("sla")).first()[0:2] == pytest.approx((0, 1))
    before = spark.read.text(str(tmp_path / "out/notes/years")).inputFiles()
    record.run()
    assert spark.read.text(str(tmp_path / "out/notes/years")).inputFiles() == before
    record.run("stats")
    assert spark.read.text(str(tmp_path / "out/notes/years")).inputFiles() == before
    Record(spark, str(tmp_path / "out"), products, SplitMode((2000,), (2001,)), GRID, inputs=["sla"]).run()
    assert spark.read.text(str(tmp_path / "out/notes/years")).inputFiles() != before


def test_moments_follow_new_files(spark, tmp_path):
    source, target, notes = (str(tmp_path / n) for n in ("in", "out", "notes"))
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("value")).write.mode("append").parquet(source)
        follow(spark, source, "k long, value double", target, notes, ["k"]).awaitTermination()
    follow(spark, source, "k long, value double", target, notes, ["k"]).awaitTermination()
    got = {r.k: (r.n, r.mean, r.std) for r in moments_so_far(spark, target, ["k"]).collect()}
    for k in (0, 1):
        own = [float(i) for i in range(30) if i % 2 == k]
        mean = sum(own) / 15
        assert got[k] == (15, pytest.approx(mean), pytest.approx((sum((x - mean) ** 2 for x in own) / 15) ** 0.5))


def test_fetching_by_plan(spark):
    import pandas as pd

    from gridwell.sources import remote

    def good(request):
        return pd.DataFrame({"v": [request["south"], request["east"]], "name": ["|".join(request["variables"])] * 2})

    def broken(request):
        raise OSError("down")

    plan = spark.createDataFrame([("a", 2000), ("b", 2000), ("c", 2000), ("d", 2000)], "product string, year int")
    asked = remote.requests(plan, Grid(), {"a": ["x", "y"], "b": ["z"], "c": ["z"]})
    got = remote.fetch(asked, {"a": good, "b": lambda r: None, "c": broken}, "v double, name string", tries=2, wait=0.0).collect()
    assert sorted((r.product, r.status, r.v, r.name) for r in got if r.product == "a") == [("a", "ok", 4.8, "x|y"), ("a", "ok", 100.2, "x|y")]
    assert {(r.product, r.status, r.v, r.detail) for r in got if r.product != "a"} == {("b", "missing", None, ""), ("c", "failed", None, "OSError: down")}


def test_file_audit(spark, tmp_path):
    from gridwell.operators import audit

    spark.range(10).coalesce(1).write.option("compression", "zstd").parquet(str(tmp_path / "t"))
    row = audit.files(spark.read.parquet(str(tmp_path / "t"))).first()
    assert (row.rows, row.codec) == (10, "zstd") and row.bytes > 0


def test_verify_finds_repeats_and_missing_days(spark, tmp_path, monkeypatch):
    import argparse
    import datetime as dt

    from gridwell import __main__ as cli

    folder = str(tmp_path)

    def write(year, days, twice=False):
        rows = [(dt.date(year, 1, 1) + dt.timedelta(days=d), 10.0, 60.0 + k, 1.0) for d in range(days) for k in range(2)]
        spark.createDataFrame(rows + rows[:1] * twice, "day date, lat double, lon double, sst double").write.parquet(f"{folder}/oisst_{year}")

    write(2001, 365)
    write(2002, 365, twice=True)
    write(2003, 364)
    args = argparse.Namespace(products=["oisst"], years=[2001, 2002, 2003, 2004], depths=None, folder=folder, all=True)
    found = {r.file: (r.status, r.problems) for r in cli.verify(spark, args).collect()}
    assert found == {"oisst_2001": ("ok", []), "oisst_2002": ("failed", ["times repeat"]), "oisst_2003": ("failed", ["364 days of 365"]), "oisst_2004": ("missing", [])}

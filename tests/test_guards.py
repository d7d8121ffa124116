"""What the record refuses, statistics files, guards of splits, flags of profiles, the command line."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridwell import __main__ as cli
from gridwell import config
from gridwell.config import Axis, Grid, SplitMode
from gridwell.operators import audit, grids, learning, profiles, scores, series, splits
from gridwell.plans.record import Product, Record
from gridwell.sources import tables

GRID = Grid(Axis(5.0, 5.5, 0.25), Axis(50.0, 50.5, 0.25))


def product(spark, path, days, name="thetao"):
    rows = [(d, 5.0 + i / 8, 50.0 + j / 8, float(d.toordinal() % 7 + i)) for d in days for i in range(5) for j in range(5)]
    spark.createDataFrame(rows, f"day date, lat double, lon double, {name} double").write.mode("overwrite").parquet(str(path))
    return Product(str(path), {name: "thetao_0m" if name == "thetao" else name}, "block")


def year(n, skip=()):
    return [dt.date(n, 12, 20) + dt.timedelta(k) for k in range(12) if k not in skip]


@pytest.fixture
def whole(spark, tmp_path):
    return {"glorys": product(spark, tmp_path / "a", year(2000) + [dt.date(2001, 1, 1)])}


def record(spark, tmp_path, products, **more):
    return Record(spark, str(tmp_path / "out"), products, more.pop("mode", SplitMode((), (2001,))), GRID, **more)


def test_record_has_every_cell_on_every_day(spark, tmp_path, whole):
    own = record(spark, tmp_path, whole, expected=lambda y: 12 if y == 2000 else 1).run()
    assert own.count() == 13 * 9 and own.select("day", "lat_i", "lon_j").distinct().count() == 13 * 9


def test_gaps_short_sources_and_years_are_refused(spark, tmp_path, whole):
    with pytest.raises(ValueError, match="gaps"):
        record(spark, tmp_path, {"glorys": product(spark, tmp_path / "b", year(2000, (4,)))}).run()
    with pytest.raises(ValueError, match="expected"):
        record(spark, tmp_path, whole | {"sla": product(spark, tmp_path / "c", year(2000)[:9], "sla")}, expected=lambda y: 12).run()
    with pytest.raises(ValueError, match="no common day"):
        record(spark, tmp_path, whole | {"sla": product(spark, tmp_path / "d", [dt.date(2002, 1, 1)], "sla")}).run()


def test_days_beyond_the_record_go(spark, tmp_path):
    days = [config.RECORD[1] + dt.timedelta(k) for k in (-1, 0, 1)]
    own = record(spark, tmp_path, {"glorys": product(spark, tmp_path / "e", days)}, mode=SplitMode((), ())).run()
    assert own.agg(F.max("day")).first()[0] == config.RECORD[1]


def test_short_buffers_and_leaks_are_refused(spark, tmp_path, whole):
    with pytest.raises(ValueError, match="buffer"):
        record(spark, tmp_path, whole, mode=SplitMode((), (2001,), 3), history=7).run()
    days = series.calendar(spark, dt.date(2000, 12, 30), dt.date(2001, 1, 2))
    assert splits.checked_training(days.where("year = 2000"), SplitMode((), (2001,))).count() == 2
    with pytest.raises(RuntimeError, match="2001"):
        splits.checked_training(days, SplitMode((), (2001,)))


def test_masks_and_places_are_checked(spark):
    mask = spark.createDataFrame([(i, j, j < 5) for i in range(4) for j in range(9)], "lat_i int, lon_j int, ocean boolean")
    shares = {r.part: (r.share, r.cells) for r in grids.ocean_fractions(mask, 9).collect()}
    assert shares["west"] == (1.0, 16) and shares["east"] == (0.2, 20)
    assert grids.checked_mask(mask, 9).count() == 36
    with pytest.raises(RuntimeError, match="east"):
        grids.checked_mask(mask.withColumn("ocean", F.col("lon_j") < 4), 9)
    with pytest.raises(ValueError, match="overlap"):
        grids.checked_overlap(grids.with_bins(spark.createDataFrame([(60.0, 10.0)], "lat double, lon double"), GRID))
    assert [grids.padding(n, 16) for n in (81, 201, 101, 96)] == [(8, 7), (4, 3), (6, 5), (0, 0)]


def test_any_day_is_served_and_names_are_checked(spark):
    labelled = spark.createDataFrame([(0, "train"), (1, "train"), (2, "buffer"), (3, "test")], "t int, split string")
    assert [r.t for r in splits.split_rows(labelled, "any", 1).orderBy("t").collect()] == [1, 2, 3]
    with pytest.raises(KeyError):
        splits.split_rows(labelled, "trian", 0)
    reached = splits.reached(labelled.where("split = 'test'"), [0], [3])
    assert sorted(r.t for r in reached.collect()) == [1, 2, 3]
    shared = {(r.a, r.b): r.shared for r in splits.shared_days(train=labelled.where("split = 'train'"), test=reached).collect()}
    assert shared == {("train", "test"): 1}


def test_flags_that_lack_a_value_or_a_column(spark):
    names = "lat double, lon double, juld double, position_qc string, platform string, cycle int, data_mode string, pres double, temp double, pres_adj double, temp_adj double, pres_qc string, temp_qc string, pres_adj_qc string, temp_adj_qc string"
    good = (10.0, 60.0, 20000.0, "1", "p", 1, "D", 10.0, 5.0, 11.0, 5.5, "1", "4", "1", "1")
    levels = profiles.tidy_levels(spark.createDataFrame([good, good[:3] + (None, *good[4:]), (*good[:-1], None)], names))
    assert [(r.pres, r.temp) for r in levels.collect()] == [(11.0, 5.5)]  # a null flag passes nowhere, the raw flag doesn't count for an adjusted value
    raw = spark.createDataFrame([good], names)
    assert profiles.tidy_levels(raw.drop("temp_adj_qc")).count() == 0  # the raw flag, 4, counts
    assert profiles.tidy_levels(raw.drop("temp_adj_qc", "temp_qc")).count() == profiles.tidy_levels(raw.drop("temp_qc")).count() == 1


def test_thin_days_have_those_without_rows(spark):
    means = spark.createDataFrame([(d, 5 if d != 7 else 4) for d in range(1, 366)], "doy int, n long")
    assert {r.doy: r.n for r in series.thin_days(means).collect()} == {7: 4, 366: 0}


def test_overall_is_null_where_a_level_has_no_value(spark):
    rows = spark.createDataFrame([(0, 2.0, 1.0, 0.5), (0, 3.0, 2.5, 0.0), (1, 1.0, 1.0, 1.0)], "depth_k int, truth double, pred double, clim double")
    total = scores.overall(scores.level_metrics(rows)).first()
    assert total.skill is None and total.rmse == pytest.approx((2 * 0.625 / 3) ** 0.5)


def test_merged_statistics_keep_columns_of_both(spark):
    old = spark.createDataFrame([("a", 1.0, 9.0), ("b", 2.0, 8.0)], "var string, mean double, scale double")
    new = spark.createDataFrame([("b", 5.0, 7.0), ("c", 6.0, 6.0)], "var string, mean double, std double")
    assert {r["var"]: (r["mean"], r["scale"], r["std"]) for r in tables.merged_stats(old, new, ["var"]).collect()} == {"a": (1.0, 9.0, None), "b": (5.0, 8.0, 7.0), "c": (6.0, None, 6.0)}


def test_statistics_files_are_merged_and_read(spark, tmp_path):
    path = str(tmp_path / "stats")
    tables.write_stats(spark.createDataFrame([("sst", 1.0, 2.0)], "var string, mean double, std double"), path)
    tables.write_stats(spark.createDataFrame([("sla", 3.0, 4.0)], "var string, mean double, std double"), path)
    assert {r["var"]: (r["mean"], r["std"]) for r in tables.read_stats(spark, path).collect()} == {"sst": (1.0, 2.0), "sla": (3.0, 4.0)}
    assert tables.read_window_stats(spark, path).count() == 0
    (tmp_path / "w.json").write_text(json.dumps({"windows": {"30": {"sst": {"mean": 0.5, "std": 2.0}}}}))
    rows = spark.createDataFrame([(30, "sst", 4.5)], "w int, var string, m double")
    assert series.standardise_windows(rows, tables.read_window_stats(spark, str(tmp_path / "w.json"))).first().m == 2.0


def test_steps_across_days(spark):
    hours = [dt.datetime(2000, 1, 1, 22) + dt.timedelta(hours=k) for k in range(5)]
    rows = [("even", t) for t in hours] + [("gap", t) for t in hours if t.hour != 0] + [("twice", hours[0]), ("twice", hours[0])]
    found = {r.k: (r.n, r.least, r.most, r.repeated, r.regular) for r in series.uneven_steps(spark.createDataFrame(rows, "k string, at timestamp"), "at", ["k"]).collect()}
    assert found == {"even": (5, 3600, 3600, 0, True), "gap": (4, 3600, 7200, 0, False), "twice": (2, 0, 0, 1, False)}


def test_search_ends_at_its_deadline_and_goes_on(spark):
    def run(setting):
        if setting["a"] == 2:
            raise ValueError("no")
        return setting["a"] / 2

    settings = [{"a": k} for k in (1, 2, 3)]
    assert learning.search(settings, run, 0) == []
    trials = learning.search(settings, run, 60, [{"a": 1, "objective": 9.0, "error": ""}])
    assert [t["objective"] for t in trials] == [9.0, None, 1.5] and trials[1]["error"] == "ValueError: no"
    assert audit.changed_settings(spark, {"a": 1}, {"a": 1}).count() == 0


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["plan", "--products", "glorys", "sss", "--years", "1992", "1993", "--depths", "0", "5"]) == 0
    assert [x.split("\t")[-1] for x in capsys.readouterr().out.strip().split("\n")] == ["glorys_0m_1993", "glorys_5m_1993", "sss_1993"]
    product(spark, tmp_path / "sss_1993", [dt.date(1993, 1, 1) + dt.timedelta(days=k) for k in range(365)], "sos")
    assert cli.main(["verify", "--products", "sss", "--years", "1993", str(tmp_path)]) == 0
    assert cli.main(["verify", "--products", "sss", "--years", "1993", "1994", str(tmp_path)]) == 1
    assert "missing" in capsys.readouterr().out
    assert cli.main(["splits", "--mode", "interleaved"]) == 0
    assert {x.split("\t")[0] for x in capsys.readouterr().out.strip().split("\n")} == {"train", "val", "test", "buffer"}
    with pytest.raises(KeyError):
        cli.version("v9")

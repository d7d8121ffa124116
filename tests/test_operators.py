"""Closed-form and property tests of the operators on grids, series, splits, profiles, scores and audits."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwell import config
from gridwell.functions import scalars
from gridwell.operators import audit, features, grids, learning, profiles, scores, series, splits
from gridwell.sources import tables


def column(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_grid_and_calendar_sizes():
    grid = config.Grid()
    assert (grid.lat.size, grid.lon.size) == (81, 201)
    assert sum(config.expected_days(y, "sss") for y in range(1993, 2025)) == 11_672
    assert config.expected_days(2024, "sss") == 350 and config.expected_days(1993, "sla") == 365 and config.expected_days(2025, "sss") == 0
    assert [y for y in (1900, 2000, 2023, 2024) if config.is_leap(y)] == [2000, 2024]


def test_inputs():
    assert (config.Inputs().history, config.Inputs(windows=()).history) == (89, 7)
    assert (config.Inputs().channels, config.Inputs(windows=()).channels) == (30, 20)
    assert config.Inputs().only(["sla", "sst"]).variables == ("sst", "sla")
    for bad in ([], ["none"]):
        with pytest.raises(ValueError):
            config.Inputs().only(bad)
    assert [config.norm_groups(n) for n in (32, 12, 7)] == [8, 4, 1]


def test_modes_are_checked():
    with pytest.raises(KeyError):
        config.split_mode("none")
    with pytest.raises(ValueError):
        config.SplitMode((1,), (1,))
    with pytest.raises(ValueError):
        config.split_mode("interleaved").checked(89)
    assert config.split_mode("chronological").checked(89).held == [2021, 2022, 2023, 2024]


@pytest.mark.parametrize(("p", "lat", "depth"), [(1000, 15, 991.7663287), (10, 5, 9.9444252), (2000, 25, 1977.6816841)])
def test_depth_from_pressure(spark, p, lat, depth):
    assert column(spark, scalars.pressure_to_depth(F.lit(p), F.lit(lat))) == pytest.approx(depth, abs=1e-6)


def test_scalars(spark):
    assert column(spark, scalars.wrap_longitude(F.lit(190.0))) == -170
    assert column(spark, scalars.julian_to_timestamp(F.lit(1.5))) == dt.datetime(1950, 1, 2, 12)
    assert [column(spark, scalars.half_bin(F.lit(x), 5.0, 0.25)) for x in (4.875, 5.1249, 5.125)] == [0, 0, 1]
    assert column(spark, scalars.softplus(F.lit(800.0))) == 800 and column(spark, scalars.softplus(F.lit(0.0))) == pytest.approx(math.log(2))
    assert column(spark, scalars.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert column(spark, scalars.flag_text(F.lit(b" AB "))) == "AB"
    for units in ("weeks since 1950-01-01",):
        with pytest.raises(ValueError):
            scalars.encode_time(F.lit("2000-01-01").cast("date"), units)
        with pytest.raises(ValueError):
            scalars.decode_time(F.lit(1), units)
    assert column(spark, scalars.nan_to_null(F.lit(float("nan")))) is None and column(spark, scalars.nan_to_null(F.lit(float("inf")))) is None


def test_block_average_of_fine_cells(spark):
    grid = config.Grid(config.Axis(5.0, 6.0, 0.25), config.Axis(50.0, 51.0, 0.25))
    points = spark.range(36).select((F.lit(5.0) + (F.col("id") % 6) / 12.0).alias("lat"), (F.lit(50.0) + F.floor(F.col("id") / 6) / 12.0).alias("lon"), F.lit(4.0).alias("value"))
    rows = grids.block_average(grids.with_bins(points, grid), []).collect()
    assert {r.value for r in rows} == {4.0} and sum(r.n for r in rows) == 36
    assert next(r.n for r in rows if (r.lat_i, r.lon_j) == (1, 1)) == 9


def test_bilinear_with_a_missing_corner_and_ties(spark):
    axis = config.Axis(0.0, 2.0, 1.0)
    source = spark.createDataFrame([(i, j, None if (i, j) == (0, 1) else float(10 * i + j)) for i in range(3) for j in range(3)], "src_i int, src_j int, value double")
    targets = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 0.5, 0.5), (2, 0, 1.5, 1.5), (3, 0, 2.0, 2.0), (4, 0, 2.1, 0.0), (5, 0, 0.25, 0.75), (6, 0, 1.0, 1.5)], "lat_i int, lon_j int, lat double, lon double")
    found = {r.lat_i: r.value for r in grids.bilinear(source, grids.stencil(targets, axis, axis), []).collect()}
    assert found == {0: 0.0, 1: 0.0, 2: 16.5, 3: 22.0, 5: None, 6: 11.5}


def test_bilinear_of_a_plane_is_the_plane(spark):
    lat, lon = config.Axis(0.0, 4.0, 0.5), config.Axis(10.0, 14.0, 1.0)
    source = spark.createDataFrame([(i, j, 2.0 * i * 0.5 - 3.0 * j + 1) for i in range(9) for j in range(5)], "src_i int, src_j int, value double")
    targets = spark.createDataFrame([(n, 0, random.Random(n).uniform(0, 4), random.Random(n + 99).uniform(10, 14)) for n in range(40)], "lat_i int, lon_j int, lat double, lon double")
    both = grids.bilinear(source, grids.stencil(targets, lat, lon), []).join(targets, "lat_i").collect()
    assert len(both) == 40 and all(r.value == pytest.approx(2 * r.lat - 3 * (r.lon - 10) + 1) for r in both)


def test_land_mask_takes_the_first_day_and_empty_cells_are_land(spark):
    every = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "lat_i int, lon_j int")
    rows = spark.createDataFrame([(dt.date(2000, 1, 1), 0, 0, 1.0), (dt.date(2000, 1, 1), 0, 0, None), (dt.date(2000, 1, 1), 0, 1, None), (dt.date(2000, 1, 2), 0, 1, 1.0)], "day date, lat_i int, lon_j int, value double")
    mask = grids.land_mask(rows, every)
    assert {r.lon_j: r.ocean for r in mask.collect()} == {0: True, 1: False, 2: False}
    assert grids.unmasked_cells(rows, mask.where("lon_j = 0")).count() == 1
    assert grids.apply_mask(rows, mask, ["value"]).where("value is not null").count() == 1


def test_pair_mask(spark):
    target = spark.createDataFrame([(0, 0, k, k != 2) for k in range(5)], "lat_i int, lon_j int, depth_k int, valid boolean")
    assert sorted((r.depth_k, r.valid) for r in grids.pair_mask(target).collect()) == [(0, True), (1, False), (2, False), (3, True)]


def _days(spark, days):
    return spark.createDataFrame([(d,) for d in days], "day date")


def test_common_days_gaps_and_islands(spark):
    first = dt.date(2024, 2, 27)
    all_days = [first + dt.timedelta(i) for i in range(6)]
    a, b = _days(spark, all_days), _days(spark, all_days[:2] + all_days[3:] + all_days[3:])
    days = series.common_days(a, b)
    assert days.count() == 5
    assert [(r.after, r.missing) for r in series.gaps(days).collect()] == [(all_days[1], 1)]
    assert sorted(r.n for r in series.islands(days).collect()) == [2, 3]
    for bad, n in ((days, None), (days.where("false"), None), (a, 5)):
        with pytest.raises(ValueError):
            series.checked_days(bad, n)
    assert series.checked_days(a, 6).count() == 6


def test_moments_follow_the_floor_policy(spark):
    rows = spark.createDataFrame([("one", 3.0), ("same", 2.0), ("same", 2.0), ("two", 1.0), ("two", 3.0), ("none", None)], "k string, value double")
    assert {r.k: (r.n, r.std) for r in series.moments(rows, ["k"]).collect()} == {"one": (1, 1.0), "same": (2, 1e-10), "two": (2, 1.0), "none": (0, 1.0)}
    assert {r.k: r.std for r in series.moments(rows, ["k"], strict=True).collect()}["same"] == 1.0


def test_merged_moments_are_those_of_the_whole(spark):
    rng = np.random.RandomState(1)
    values = rng.randn(500) * 3 + 7
    rows = spark.createDataFrame([(int(i % 7), float(v)) for i, v in enumerate(values)], "k int, value double")
    r = series.merge_moments(series.accumulated(rows, ["k"]), []).first()
    assert (r.n, r.mean, math.sqrt(r.m2 / r.n)) == (500, pytest.approx(values.mean()), pytest.approx(values.std()))


def test_standardise_and_back_and_zero_fill(spark):
    rows = spark.createDataFrame([(1.0, None), (None, 5.0)], "a double, b double")
    z = series.standardise(rows, {"a": (0.5, 0.5), "b": (1.0, 2.0), "absent": (0.0, 1.0)})
    assert [tuple(r) for r in series.zero_filled(z, ["a"]).collect()] == [(1.0, None), (0.0, 2.0)]
    assert [tuple(r) for r in series.destandardise(z, {"a": (0.5, 0.5), "b": (1.0, 2.0)}).collect()] == [tuple(r) for r in rows.collect()]


def test_circular_smooth_of_one_day_wraps(spark):
    means = spark.createDataFrame([(0, 1, 1.0)], "c int, doy int, clim double")
    found = {r.doy: r.clim for r in series.circular_smooth(means, ["c"], 7).collect()}
    assert len(found) == 366 and {d for d, v in found.items() if v} == {*range(1, 9), *range(360, 367)}
    assert all(v == pytest.approx(1 / 15) for v in found.values() if v)
    full = spark.createDataFrame([(0, d, float(d % 5)) for d in range(1, 367)], "c int, doy int, clim double")
    assert sum(r.clim for r in series.circular_smooth(full, ["c"], 3).collect()) == pytest.approx(sum(d % 5 for d in range(1, 367)))


def test_running_mean_and_lags(spark):
    rows = spark.createDataFrame([(t, float(t + 1)) for t in range(4)], "t int, anom double")
    assert [r.rm3 for r in series.running_mean(rows, [], 3).orderBy("t").collect()] == [0, 0, 2, 3]
    assert [r.anom_lag2 for r in series.lagged(rows, [], [0, 2], ["anom"]).orderBy("t").collect()] == [None, None, 1, 2]


def test_anomalies_of_training_days_have_mean_zero(spark):
    rows = spark.range(0, 366 * 3).select((F.col("id") % 366 + 1).cast("int").alias("doy"), F.lit(0).alias("c"), F.sin(F.col("id")).alias("value"))
    own = series.anomalies(rows, series.doy_means(rows, ["c"]), ["c"])
    assert own.agg(F.avg("anom")).first()[0] == pytest.approx(0, abs=1e-12)
    assert own.where(F.abs(series.absolute(F.col("anom"), F.col("clim")) - F.col("value")) > 1e-12).count() == 0


def test_uneven_steps(spark):
    at = dt.datetime(2000, 1, 1)
    rows = spark.createDataFrame([("hour", at + dt.timedelta(hours=i)) for i in range(5)] + [("bad", at + dt.timedelta(hours=i)) for i in (0, 1, 1, 3)] + [("one", at)], "k string, ts timestamp")
    assert {r.k: (r.regular, r.repeated) for r in series.uneven_steps(rows, "ts", ["k"]).collect()} == {"hour": (True, 0), "bad": (False, 1), "one": (False, 0)}


def test_buffer_around_held_days(spark):
    days = spark.createDataFrame([(t, dt.date(2000, 1, 1) + dt.timedelta(t), 2 if t in (5, 6) else 1) for t in range(12)], "t int, day date, year int")
    labelled = splits.day_labels(days, config.SplitMode((2,), (), 2), 0)
    assert sorted(r.t for r in labelled.where("split = 'buffer'").collect()) == [3, 4, 7, 8]
    assert {(r.split, r.start, r.stop) for r in splits.blocks(labelled).collect()} == {("train", 0, 3), ("train", 9, 12), ("buffer", 3, 5), ("buffer", 7, 9), ("val", 5, 7)}
    assert {r.distance for r in splits.buffer_distance(labelled).collect()} == {1, 2}
    assert [r.t for r in splits.split_rows(labelled, "train", 1).orderBy("t").collect()] == [1, 2, 9, 10, 11]


@pytest.mark.parametrize("name", config.SPLIT_MODES)
def test_splits_are_disjoint_and_cover(spark, name):
    mode, history = config.split_mode(name), 7
    days = series.calendar(spark, *config.RECORD)
    labelled = splits.day_labels(days, mode, history)
    assert labelled.count() == days.count() == 11_672
    assert {r.shared for r in splits.overlaps(labelled).collect()} == {0}
    assert labelled.where(F.col("year").isin(mode.held) == F.col("split").isin("train", "buffer")).count() == 0
    assert splits.split_rows(labelled, "any", history).where(F.col("t") < history).count() == 0
    if mode.buffer_days:
        assert splits.buffer_distance(labelled).agg(F.max("distance")).first()[0] <= mode.buffer_days
    if name == "chronological":
        assert labelled.where("split = 'train'").count() == 10_227


def test_batches_and_samples_are_repeatable(spark):
    rows = spark.range(50).select(F.col("id").cast("int").alias("t"))
    assert splits.batches(rows, 16).groupBy("batch").count().count() == 4
    a, b = (splits.batches(rows, 16, seed=3).orderBy("place").collect() for _ in range(2))
    assert a == b and [r.t for r in a] != sorted(r.t for r in a)
    assert splits.sampled(rows, 5, ["t"]).collect() == splits.sampled(rows, 5, ["t"]).collect()
    assert splits.outside(rows, rows.where("t < 48")).count() == 2


RAW = "lat double, lon double, juld double, position_qc string, juld_qc string, platform string, cycle int, data_mode string, pres double, temp double, pres_adj double, temp_adj double, pres_qc string, temp_qc string, pres_adj_qc string, temp_adj_qc string"


def test_profiles(spark):
    good = (10.0, 80.0, 18000.25, "1", "1", " A ", 1, "D", 10.0, 20.0, 11.0, 21.0, "1", "2", "1", "1")
    change = lambda **k: tuple(k.get(n.split(" ")[0], v) for n, v in zip(RAW.split(", "), good, strict=True))
    rows = [good, change(temp_adj=float("nan"), pres=30.0), change(data_mode="R", pres=20.0), change(position_qc="4"), change(juld_qc="9"), change(lon=260.0), change(lat=None), change(temp_adj_qc="3"), change(pres_adj_qc=None), change(platform="B", cycle=3, pres_adj_qc="7"), change(platform="0", cycle=2)]
    levels = profiles.tidy_levels(spark.createDataFrame(rows, RAW))
    got = sorted((r.prof_key, r.pres, r.adjusted) for r in levels.collect())
    assert got == [("0_2", 11.0, True), ("A_1", 11.0, True), ("A_1", 20.0, False), ("A_1", 30.0, False)]  # an adjusted value without a flag goes
    assert [(r.profile_id, r.prof_key) for r in profiles.profiles(levels).orderBy("profile_id").collect()] == [(0, "0_2"), (1, "A_1")]
    assert profiles.observations(levels).count() == 4
    assert profiles.tidy_levels(spark.createDataFrame(rows, RAW).drop("pres_adj", "position_qc", "juld_qc")).where("adjusted").count() == 0
    cube = spark.createDataFrame([(dt.date(1999, 4, 14), 20, 120, 1, 5.0)], "day date, lat_i int, lon_j int, depth_k int, value double")
    assert profiles.colocated(levels, cube, config.Grid(), [0.0, 15.0, 200.0]).where("grid_value = 5.0").count() == 4


def test_profile_ids_are_dense_and_ordered(spark):
    keys = [f"{random.Random(i).randint(0, 999)}_{i % 3}" for i in range(400)]
    rows = profiles.profile_ids(spark.createDataFrame([(k,) for k in keys], "prof_key string")).collect()
    assert {r.prof_key: r.profile_id for r in rows} == {k: i for i, k in enumerate(sorted(set(keys)))}


def _predictions(spark):
    rng = np.random.RandomState(5)
    return [(t, 0, j, k, float(a), float(a + b), float(a - c)) for t in range(3) for j in range(5) for k in range(4) for a, b, c in [rng.randn(3)]]


PREDICTIONS = "t int, lat_i int, lon_j int, depth_k int, truth double, pred double, clim double"


def test_level_metrics_against_numpy(spark):
    rows = _predictions(spark)
    found = {r.depth_k: r for r in scores.level_metrics(spark.createDataFrame(rows, PREDICTIONS)).collect()}
    for k, r in found.items():
        t, p, c = np.array([x[4:] for x in rows if x[3] == k]).T
        assert r.rmse == pytest.approx(np.sqrt(((p - t) ** 2).mean())) and r.bias == pytest.approx((p - t).mean())
        assert r.pearson_r == pytest.approx(np.corrcoef(t, p)[0, 1]) and r.anomaly_corr == pytest.approx(np.corrcoef(t - c, p - c)[0, 1])
        assert r.skill == pytest.approx(1 - r.rmse / r.rmse_clim) and r.anom_sd_ratio == pytest.approx((p - c).std() / (t - c).std())
    total = scores.overall(scores.level_metrics(spark.createDataFrame(rows, PREDICTIONS))).first()
    assert total.rmse == pytest.approx(np.sqrt(np.mean([(x[5] - x[4]) ** 2 for x in rows])))


def test_constant_levels_have_no_correlation(spark):
    r = scores.level_metrics(spark.createDataFrame([(t, 0, 0, 0, 1.0, 2.0, 1.0) for t in range(4)], PREDICTIONS)).first()
    assert r.pearson_r is None and r.anomaly_corr is None and r.skill is None and r.rmse == 1


def test_losses_and_violations(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 5.0, 5.0, 0.0), (0, 0, 0, 1, 6.0, 7.0, 0.0), (0, 0, 0, 2, 4.0, 8.0, 0.0), (0, 0, 1, 0, 1.0, 1.0, 0.0), (0, 0, 1, 2, 9.0, 9.0, 0.0)], PREDICTIONS)
    gate = spark.createDataFrame([(0, 0.0), (1, 0.5)], "depth_k int, gate double")
    steps = scores.level_steps(rows, ("t", "lat_i", "lon_j"), ("truth", "pred"))
    assert sorted((r.depth_k, r.d_truth, r.d_pred) for r in steps.collect()) == [(0, 1.0, 2.0), (1, -2.0, 1.0)]
    assert {r.of: (r.all_pairs, r.gated) for r in scores.violations(steps, gate, ("truth", "pred")).collect()} == {"truth": (0.5, 0.0), "pred": (1.0, 1.0)}
    assert scores.masked_mse(rows, 5).first().loss == pytest.approx(17 / 5)
    assert scores.combined_loss(rows, gate, 5, 2.0, 0.0).first().loss == pytest.approx(17 / 5)
    assert scores.combined_loss(rows, gate, 5, 2.0, 1.0).first().loss == pytest.approx(17 / 5 + 0.5 / 2)
    assert scores.masked_mse(rows, 0).first().loss == 17


def test_channels_and_arrays(spark):
    inputs = config.Inputs((0, 3), (30,), ("sst", "sla"))
    names = features.channel_names(inputs)
    row = spark.range(1).select(*[F.lit(float(i)).alias(n) for i, n in enumerate(names)])
    assert features.channels(row, inputs, []).first().x == [float(i) for i in range(inputs.channels)]
    with pytest.raises(KeyError):
        features.channels(row.drop("ocean"), inputs, [])
    cube = spark.createDataFrame([(1, 2, 5.0), (1, 0, 3.0)], "t int, depth_k int, value double")
    assert features.profile_arrays(cube, ["t"], 4).first().y == [3.0, None, 5.0, None]
    both = features.with_climatology(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4)))
    assert [column(spark, x) for x in features.split_climatology(both, 2)] == [[1, 2], [3, 4]]
    got = features.tensors(spark.range(8).withColumn("batch", F.floor(F.col("id") / 4)), 4, lambda f: f.groupby("batch", as_index=False).agg(n=("id", "count")), "batch long, n long")
    assert sum(r.n for r in got.collect()) == 8


def test_audit_rules(spark):
    rows = spark.range(3).toDF("a")
    found = audit.ledger(audit.rule(rows, "three", F.count("*") == 3), audit.nothing(rows, "none"), audit.rule(rows.where("false"), "null", F.max("a") > 0))
    assert {r.rule: r.passed for r in found.collect()} == {"three": True, "none": False, "null": False}
    assert audit.failed(found) and not audit.failed(found.where("passed"))
    assert [tuple(r) for r in audit.changed_settings(spark, {"a": 1, "b": 2}, {"a": 1, "c": 3}).collect()] == [("b", "2", "None"), ("c", "None", "3")]
    places = spark.createDataFrame([("x", 0, 0), ("y", 0, 0), ("y", 0, 1)], "s string, lat_i int, lon_j int")
    assert audit.same_null_places(places, "s", "x", "y").count() == 1


def test_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "cube")
    rows = spark.createDataFrame([(2000, dt.date(2000, 1, 1), 10.0, 60.0, 0, 1.0), (2000, dt.date(2000, 1, 2), 10.0, 60.0, 0, float("nan")), (2001, dt.date(2001, 1, 1), 40.0, 60.0, 0, 2.0), (2001, dt.date(2001, 1, 1), 10.0, 60.0, 1, 2.0)], "year int, day date, lat double, lon double, lev int, v double")
    tables.write_years(rows, path)
    tables.write_years(rows.where("year = 2001").withColumn("v", F.col("v") + 1), path)
    read = tables.read_product(spark, path, {"v": "sst"}, grid=config.Grid(), years=[2000, 2001], required=["sst"], first_level="lev")
    assert sorted((r.year, r.sst) for r in read.where("sst is not null").collect()) == [(2000, 1.0)]
    assert read.where("sst is null").count() == 1
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "year#" in plan
    with pytest.raises(KeyError):
        tables.read_product(spark, path, required=["none"])
    tables.append(rows, str(tmp_path / "more"))
    tables.append(rows, str(tmp_path / "more"))
    assert spark.read.parquet(str(tmp_path / "more")).count() == 8
    (tmp_path / "stats.json").write_text('{"sst": {"mean": 1.5, "std": 2}, "sla": {"mean": 0, "std": 1}}')
    stats = tables.read_stats(spark, str(tmp_path / "stats.json"))
    assert {r["var"]: (r["mean"], r["std"]) for r in stats.collect()} == {"sst": (1.5, 2.0), "sla": (0.0, 1.0)}
    merged = tables.merged_stats(stats, spark.createDataFrame([("sst", 9.0, 1.0), ("new", 1.0, 1.0)], "var string, mean double, std double"), ["var"])
    assert {r["var"]: r["mean"] for r in merged.collect()} == {"sst": 9.0, "sla": 0.0, "new": 1.0}
    tables.write_metrics(stats, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics/json")).count() == 2
    assert tables.read_files(spark, str(tmp_path / "stats.json")).count() == 1
    assert tables.read_parts(spark, [path, str(tmp_path / "more")]).count() == 12


def test_latent_basis_and_probe(spark):
    rng = np.random.RandomState(0)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.randn(6)]) for i in range(40)], "vec_id long, embedding array<double>")
    assert learning.latent_basis(vectors, 2, 3).select(F.size("components")).distinct().first()[0] == 2
    samples = spark.createDataFrame([([float(a), float(b)], float(2 * a - b)) for a, b in rng.randn(60, 2)], "x array<double>, y double")
    assert learning.linear_probe(samples).coefficients.toArray() == pytest.approx([2, -1])
    assert learning.search_ridge(samples, [10.0, 0.0]).first().ridge == 0.0


def test_rules_name_what_is_wrong(spark):
    mask = spark.createDataFrame([(0, 0, True), (0, 1, None), (0, 1, False)], "lat_i int, lon_j int, ocean boolean")
    assert {r.rule: r.passed for r in audit.mask_rules(mask, 3, (1, 1)).collect()} == {"every cell once": False, "ocean or land": False, "ocean cells plausible": True}
    rows = [(d, c, x, None if c else x) for d, x in (("2001-01-01", -1.0), ("2001-01-02", 1.0)) for c in (0, 1)]
    table = spark.createDataFrame(rows, "day string, lon_j int, x double, y double").selectExpr("cast(day as date) day", "0 lat_i", "lon_j", "x", "y")
    good = audit.split_rules(table, 2, ("2001-01-01", "2001-01-02"), ["x"], ["y"], (0.1, 0.1))
    assert not audit.failed(good) and good.count() == 8
    bad = audit.split_rules(table.unionByName(table.limit(1)), 2, ("2001-01-01", "2001-01-03"), ["y"], ["x"], (0.1, 0.1))
    assert {r.rule for r in bad.where("not passed").collect()} == {"last day", "no gaps in days", "every cell once a day", "y has no nulls", "x keeps nulls", "x is standardised", "y is standardised"}
    assert audit.failed(audit.split_rules(table.where("false"), 2, ("2001-01-01", "2001-01-02"), ["x"], ["y"]))


def test_evaluation_joins_and_scores(spark):
    keys = "t int, lat_i int, lon_j int, depth_k int"
    places = [(0, 0, c, k) for c in (0, 1) for k in (0, 1)]
    truth = spark.createDataFrame([(*p, 10.0 - p[3] + p[2]) for p in places], f"{keys}, truth double")
    pred = spark.createDataFrame([(*p, 10.0 + p[3] if p[2] else None) for p in places], f"{keys}, pred double")
    clim = spark.createDataFrame([(*p, 9.0) for p in places], f"{keys}, clim double")
    gate = spark.createDataFrame([(0, 1.0)], "depth_k int, gate double")
    of = scores.evaluate(truth, pred, clim, gate)
    assert {r.depth_k: (r.n_cells, r.rmse) for r in of.levels.collect()} == {0: (1, 1.0), 1: (1, 1.0)}
    assert of.overall.first().n_cells == 2 and {r.of: r.gated for r in of.violations.collect()} == {"truth": 0.0, "pred": 1.0}


def test_best_setting_leaves_failed_trials(spark):
    trials = spark.createDataFrame([("a", float("nan")), ("b", None), ("d", 1.0), ("c", 1.0)], "setting string, objective double")
    assert learning.best_setting(trials, "objective", "setting").first().setting == "c"
    assert learning.best_setting(trials.where("setting < 'c'"), "objective").count() == 0


def test_seasonal_share(spark):
    anom, whole = (spark.createDataFrame([(0, s)], "depth_k int, std double") for s in (0.6, 2.0))
    row = series.seasonal_share(anom, whole, ["depth_k"]).first()
    assert (round(row.scale, 9), round(row.share, 9)) == (1.2, 64.0)

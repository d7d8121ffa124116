"""Array files and what is in them."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwell.operators import profiles, series
from gridwell.sources import classic, tables
from gridwell.sources.classic import Variable


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("record", [None, "t"])
def test_arrays_come_back(version, record):
    rng = np.random.default_rng(version)
    dimensions = {"t": 3, "x": 5, "s": 7, "none": 0 if record is None else 2}
    variables = {
        "a": Variable(("t", "x"), rng.normal(size=(3, 5)), {"_FillValue": 9.0, "units": "m"}),
        "b": Variable(("t",), rng.integers(-100, 100, 3).astype(np.int16), {"scale_factor": np.float32(0.5), "add_offset": 2.0}),
        "c": Variable(("x", "s"), rng.integers(65, 90, (5, 7)).astype(np.uint8).view("S1")),
        "d": Variable((), np.array(7, np.int32)),
        "e": Variable(("x",), rng.normal(size=5).astype(np.float32)),
    }
    data = classic.encode(dimensions, variables, version, record)
    own = classic.decode(data)
    assert own.keys() == variables.keys()
    for k, v in variables.items():
        assert own[k].dimensions == v.dimensions and np.array_equal(own[k].values, v.values)
    assert own["a"].attributes["units"] == "m" and own["b"].numbers().tolist() == (variables["b"].values * 0.5 + 2).tolist()
    assert list(classic.decode(data, ["e", "absent"])) == ["e"]
    with pytest.raises(ValueError, match="ends early"):
        classic.decode(data[:-8])


def test_a_single_record_variable_is_not_padded():
    own = {"q": Variable(("t", "x"), np.arange(15, dtype=np.int8).reshape(5, 3))}
    data = classic.encode({"t": 5, "x": 3}, own, 1, "t")
    assert np.array_equal(classic.decode(data)["q"].values, own["q"].values)
    streaming = data[:4] + b"\xff\xff\xff\xff" + data[8:]
    assert np.array_equal(classic.decode(streaming)["q"].values, own["q"].values)


def level_rows(rng, n, m):
    columns = [c.split(" ")[0] for c in classic.LEVELS.split(", ")]
    rows = []
    for i in range(n):
        whole = {"lat": rng.uniform(5, 20), "lon": rng.uniform(60, 90), "juld": rng.uniform(20000, 20300), "cycle": i, "position_qc": "1", "juld_qc": rng.choice("12"), "platform": rng.choice(["29", "1901"]), "data_mode": rng.choice("RAD")}
        for k in range(m if i else 1):
            own = {c: rng.choice([None, round(rng.uniform(0, 900), 2)]) for c in ("pres", "temp", "pres_adj", "temp_adj")} | {f"{c}_qc": rng.choice([None, "1", "2", "4"]) for c in ("pres", "temp", "pres_adj", "temp_adj")}
            rows.append({c: (whole | own)[c] for c in columns} | {"profile": i, "level": k})
    return pd.DataFrame(rows), columns


def test_levels_of_files_by_hand(spark):
    rows, columns = level_rows(random.Random(4), 6, 9)
    good = classic.profile_file(rows)
    files = [("a", good), ("b", good[: len(good) // 2]), ("c", b""), ("d", None), ("e", b"CDF\x07" + good[4:]), ("f", classic.encode({"N_PROF": 1}, {"LATITUDE": Variable(("N_PROF",), np.zeros(1))})), ("a", good)]
    own = classic.read_levels(spark.createDataFrame(files, "path string, content binary").withColumns({"error": F.lit(1), "lat": F.lit(2)}))
    bad = {r.path: r.error for r in own.where("error != ''").collect()}
    assert bad.keys() == {"b", "c", "d", "e", "f"} and "ends early" in bad["b"] and "no LONGITUDE" in bad["f"]
    assert own.where("error != '' AND (pres IS NOT NULL OR platform IS NOT NULL)").count() == 0
    got = own.where("path = 'a'").select(*columns).toPandas()
    assert len(got) == 2 * 6 * 9  # the file twice, and levels that a short profile lacks

    def plain(table):
        return sorted((tuple("" if v is None or v != v else v.strip() if isinstance(v, str) else round(v, 6) for v in r) for r in table.itertuples(index=False)), key=repr)

    assert [r for r in plain(got) if r[4] != "" or r[5] != "" or r[6] != "" or r[7] != ""] == sorted(2 * [r for r in plain(rows[columns]) if r[4] != "" or r[5] != "" or r[6] != "" or r[7] != ""], key=repr)
    assert classic.read_levels(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_missing_variables_have_their_defaults():
    two = np.array([[1.0, 2.0]])
    one = np.array([10.0])
    base = {"LATITUDE": Variable(("p",), one), "LONGITUDE": Variable(("p",), one), "JULD": Variable(("p",), one), "PRES": Variable(("p", "k"), two), "TEMP": Variable(("p", "k"), two), "PRES_QC": Variable(("p", "k"), np.array([[b"2", b"3"]]))}
    names = [c.split(" ")[0] for c in classic.LEVELS.split(", ")]
    first, second = (dict(zip(names, r, strict=True)) for r in classic.levels_in(classic.encode({"p": 1, "k": 2}, base)))
    assert (first["data_mode"], first["cycle"], first["platform"], first["position_qc"], first["temp_qc"], first["temp_adj_qc"]) == ("R", -1, "", "1", "1", "1")
    assert (first["pres_adj_qc"], second["pres_adj_qc"], first["pres_adj"]) == ("2", "3", None)


def test_profile_files_to_a_year(spark, tmp_path):
    rows, _ = level_rows(random.Random(5), 20, 4)
    rows[["position_qc", "juld_qc"]] = "1"
    for k in range(3):
        (tmp_path / f"day{k}.nc").write_bytes(classic.profile_file(rows[rows["profile"] % 3 == k].assign(profile=lambda t: t["profile"] // 3)))
    (tmp_path / "broken.nc").write_bytes(b"CDF")
    read = classic.read_profile_files(spark, str(tmp_path / "*.nc"))
    assert read.where("error != ''").count() == 1
    levels = profiles.tidy_levels(read.where("error = ''"), (0, 30, 0, 100))
    years = [r.y for r in levels.select(F.year("time").alias("y")).distinct().collect()]
    for year in years:
        n, m = profiles.write_year(levels, year, str(tmp_path / "out"))
        again = profiles.write_year(levels, year, str(tmp_path / "out"))
        seen, known = (spark.read.parquet(str(tmp_path / f"out/{k}")) for k in ("observations", "profiles"))
        assert again == (n, m) == (seen.where(f"year = {year}").count(), known.where(f"year = {year}").count())
        assert sorted(r.profile_id for r in known.where(f"year = {year}").collect()) == list(range(m))
        keyed = seen.where(f"year = {year}").join(known.where(f"year = {year}"), "profile_id")
        assert keyed.count() == n == levels.where(F.year("time") == year).count()


def test_one_file_serves_both_kinds_of_statistics(spark, tmp_path):
    path = str(tmp_path / "stats")
    tables.write_stats(spark.createDataFrame([("sst", 1.0, 2.0)], "var string, mean double, std double"), path)
    (part,) = (tmp_path / "stats").glob("part-*")
    part.write_text('{"sst": {"mean": 1.0, "std": 2.0}, "windows": {"30": {"sst": {"mean": 0.5, "std": 0.25}}}, "note": "text", "old": {"mean": 3}}')
    (tmp_path / "stats" / f".{part.name}.crc").unlink()
    assert [tuple(r) for r in tables.read_stats(spark, path).collect()] == [("sst", 1.0, 2.0)]
    assert [tuple(r) for r in tables.read_window_stats(spark, path).collect()] == [(30, "sst", 0.5, 0.25)]


def test_windows_without_constants_are_an_error(spark):
    rows = spark.createDataFrame([(30, "sst", 1.0), (90, "sst", 2.0)], "w int, var string, m double")
    whole = spark.createDataFrame([(30, "sst", 0.0, 2.0), (90, "sst", 1.0, 0.5)], "w int, var string, mean double, std double")
    assert sorted(r.m for r in series.standardise_windows(rows, whole).collect()) == [0.5, 2.0]
    with pytest.raises(Exception, match="no constants for window 90 of sst"):
        series.standardise_windows(rows, whole.where("w = 30")).collect()

"""Reuse of files by content, whole files only, and readiness by what files hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridwell.sources import reuse


def test_torn_and_changed_files_are_fetched_again(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name in ("a", "b", "c", "d", "e"):
        (folder / f"{name}.bin").write_bytes(name.encode() * 100)
    plan = spark.createDataFrame([(f"{n}.bin", f"s{n}") for n in "abcdef"], "file string, spec string")
    (folder / "empty.bin").write_bytes(b"")
    manifest = reuse.Manifest(spark, str(tmp_path / "manifest"))
    present = reuse.inventory(spark, str(folder / "*.bin"))
    assert {r.file: r.reason for r in reuse.to_fetch(plan, manifest.read(), present).collect()} == {f"{n}.bin": "new" for n in "abcdef"}
    problems = spark.createDataFrame([("e.bin", "too few days")], "file string, problem string")
    manifest.add(reuse.checked(present, plan, problems))
    assert {r.file: r.reason for r in reuse.to_fetch(plan, manifest.read(), present).collect()} == {"e.bin": "new", "f.bin": "new"}
    (folder / "a.bin").write_bytes(b"a" * 60)
    (folder / "b.bin").write_bytes(b"x" * 100)
    (folder / "c.bin").unlink()
    later = plan.withColumn("spec", F.when(F.col("file") == "d.bin", "other").otherwise(F.col("spec")))
    present = reuse.inventory(spark, str(folder / "*.bin"))
    assert {r.file: r.reason for r in reuse.to_fetch(later, manifest.read(), present).collect()} == {"a.bin": "torn", "b.bin": "changed", "c.bin": "absent", "d.bin": "settings", "e.bin": "new", "f.bin": "new"}
    manifest.add(reuse.checked(present, later.where("file IN ('a.bin', 'd.bin')")))  # both were fetched again
    assert {r.file for r in reuse.to_fetch(later, manifest.read(), present).collect()} == {"b.bin", "c.bin", "e.bin", "f.bin"}
    assert reuse.to_fetch(later.where("false"), manifest.read(), present).count() == 0
    assert reuse.to_fetch(later.unionByName(later), manifest.read(), present).count() == 8


def test_what_is_published_is_whole(spark, tmp_path):
    place = str(tmp_path / "year")
    reuse.publish(spark, lambda folder: spark.range(5).write.parquet(folder), place)

    def broken(folder):
        spark.range(9).write.parquet(folder)
        raise RuntimeError("the line went dead")

    with pytest.raises(RuntimeError, match="dead"):
        reuse.publish(spark, broken, place)
    assert spark.read.parquet(place).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["year"]
    reuse.publish(spark, lambda folder: spark.range(7).write.parquet(folder), place)
    assert spark.read.parquet(place).count() == 7


def test_years_by_the_version_and_time_of_their_files(spark):
    def at(day):
        return dt.datetime(2024, 1, day)

    needed = {"sla": ["sla", "ugos", "vgos"], "sst": ["sst"]}
    rows = []
    for year in range(2000, 2007):
        rows += [(year, "sla", f"sla_{year}", ["vgos", "ugos", "sla", "err"], at(5)), (year, "sst", f"sst_{year}", ["sst"], at(6))]
    rows[2] = (2001, "sla", "sla_2001", ["sla"], at(5))  # an older version of the file
    rows[5] = (2002, "sst", "sst_2002", None, at(6))
    del rows[6]  # no sla in 2003
    inputs = spark.createDataFrame(rows, "year int, product string, file string, variables array<string>, modified timestamp")
    outputs = spark.createDataFrame([(2000, at(7)), (2001, at(7)), (2004, at(6)), (2005, at(5)), (2005, at(4)), (2010, at(9))], "year int, written timestamp")
    found = {r.year: (r.ready, r.stale, r.reason) for r in reuse.vintage(inputs, outputs, needed).collect()}
    assert found == {
        2000: (True, False, ""), 2001: (False, False, "sla_2001 lacks ugos, vgos"), 2002: (False, False, "sst_2002 can't be read"), 2003: (False, False, "no sla"),
        2004: (True, False, ""), 2005: (True, True, "sst_2005 is newer"), 2006: (True, True, "never made"), 2010: (False, False, "no sla"),
    }
    touched = inputs.withColumn("modified", F.when(F.col("file") == "sla_2000", F.lit(at(8))).otherwise(F.col("modified")))
    again = {r.year: (r.ready, r.stale, r.reason) for r in reuse.vintage(touched, outputs, needed).collect()}
    assert again == found | {2000: (True, True, "sla_2000 is newer")}

"""Blocks, batches, chosen days, requests and files against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridwell.operators import permutation, series, trailing
from gridwell.sources import subset, tables


def series_of(rng, cells, days, share):
    return [(c, t, None if rng.random() < 0.1 else round(rng.uniform(-5, 5), 3)) for c in range(cells) for t in range(days) if rng.random() < share]


def by_hand(rows, w):
    out = {}
    for cell in {c for c, *_ in rows}:
        own = sorted((t, v) for c, t, v in rows if c == cell)
        for k, (t, _) in enumerate(own):
            window = [v for _, v in own[k + 1 - w : k + 1] if v is not None] if k + 1 >= w else None
            out[cell, t] = 0.0 if window is None else sum(window) / w if window else None
    return out


def close(found, want):
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert (found[k] is None) == (v is None) and (v is None or abs(found[k] - v) < 1e-9), k


@pytest.mark.parametrize(("size", "share"), [(8, 1.0), (8, 0.3), (5, 0.05), (1000, 0.8)])
def test_blocked_means_by_hand(spark, size, share):
    rows = series_of(random.Random(size), 3, 200, share)
    table = spark.createDataFrame(rows, "cell int, t int, anom double")
    own = trailing.running_means(table, ["cell"], (2, 7, 30), size=size).collect()
    for w in (2, 7, 30):
        close({(r.cell, r.t): r[f"rm{w}"] for r in own}, by_hand(rows, w))
    assert all(r.rm30 == 0.0 for r in own if sum(c == r.cell and t <= r.t for c, t, _ in rows) < 30)
    assert trailing.running_means(table.where("false"), ["cell"], (2,), size=size).count() == 0


def test_appended_days_read_their_halo_only(spark, tmp_path):
    rows = series_of(random.Random(1), 2, 400, 1.0)
    table = spark.createDataFrame(rows, "cell int, t int, anom double")
    source, target = f"{tmp_path}/source", f"{tmp_path}/means"
    trailing.write_blocks(table.where("t < 320"), source, size=16)
    assert trailing.write_means(spark, source, target, ["cell"], (5, 30), size=16) == list(range(20))
    before = {r.path: r.modificationTime for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(target).select("path", "modificationTime").collect()}
    trailing.write_blocks(table.where("t >= 320"), source, size=16)
    assert trailing.write_means(spark, source, target, ["cell"], (5, 30), first=20, size=16) == [18, 19, 20, 21, 22, 23, 24]  # 29 days before day 320 begin in block 18
    own = spark.read.parquet(target)
    for w in (5, 30):
        close({(r.cell, r.t): r[f"rm{w}"] for r in own.collect()}, by_hand(rows, w))
    after = {r.path: r.modificationTime for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(target).select("path", "modificationTime").collect()}
    assert before.items() <= after.items()


def test_long_series_is_many_groups(spark):
    table = spark.range(1000).select((F.col("id") % 2).alias("cell"), F.col("id").cast("int").alias("t"), F.col("id").cast("double").alias("anom"))
    plan = trailing.running_means(table, ["cell"], (30, 90), size=50)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("Window") >= 1
    whole = series.running_mean(table, ["cell"], 90).select("t", "rm90")
    assert trailing.running_means(table, ["cell"], (90,), size=50).select("t", "rm90").exceptAll(whole).count() == 0


def test_every_number_has_its_place(spark):
    for n in (1, 2, 3, 5, 16, 17, 100, 1023, 5000):
        for epoch in (0, 1):
            order = permutation.Permutation(n, 9, epoch)
            own = spark.range(n).select("id", order.place(F.col("id")).alias("place"))
            got = own.withColumn("back", order.number(F.col("place"))).collect()
            assert sorted(r.place for r in got) == list(range(n))
            assert all(r.back == r.id for r in got)
    first, second, other = ([r.p for r in spark.range(1000).select(permutation.Permutation(1000, s, e).place(F.col("id")).alias("p")).collect()] for s, e in ((9, 0), (9, 1), (8, 0)))
    assert first != second != other != first
    assert abs(sum((p - 499.5) * (i - 499.5) for i, p in enumerate(first))) < 0.2 * sum((i - 499.5) ** 2 for i in range(1000))


def test_batches_of_any_epoch_without_one_task_for_all_rows(spark):
    rows = spark.createDataFrame([(t,) for t in range(0, 9000, 3)], "t int")
    own = permutation.batches(rows, 16, seed=3, epoch=5)
    assert sorted(r.place for r in own.collect()) == list(range(3000))
    assert {r["count"] for r in own.groupBy("batch").count().collect()} == {16, 8}
    asked = permutation.members(spark, 3000, 16, [0, 100, 187], 3, 5).join(permutation.numbered(rows), "number").select("batch", "place", "t")
    want = own.where("batch IN (0, 100, 187)").select("batch", "place", "t")
    assert asked.exceptAll(want).count() == want.exceptAll(asked).count() == 0
    assert permutation.batches(rows.where("false"), 4, 1).count() == 0
    plan = permutation.batches(rows, 16, seed=3)._jdf.queryExecution().executedPlan().toString()
    alone = plan[plan.index("Exchange SinglePartition") :].split("\n")[1]
    assert plan.count("SinglePartition") == 1 and "HashAggregate(keys=[_groupingexpression" in alone  # a row per stretch


def scanned(table):
    """Rows that the scan gave, and files that it read."""
    table.collect()
    leaves = table._jdf.queryExecution().executedPlan().collectLeaves()
    scan = [leaves.apply(i) for i in range(leaves.size())]
    metrics = [s.metrics() for s in scan if "FileScan" in s.toString()]
    return tuple(sum(m.apply(k).value() for m in metrics) for k in ("numOutputRows", "numFiles"))


def test_days_are_read_by_ranges(spark, tmp_path):
    first = dt.date(2000, 1, 1)
    table = spark.range(400_000).select(F.date_add(F.lit(first), (F.col("id") * 7919 % 1400).cast("int")).alias("day"), F.col("id"), F.rand(1).alias("x"))
    tables.write_by_day(table, str(tmp_path / "t"), 64 << 10)
    days = [dt.date(2001, 3, 1), dt.date(2001, 3, 2), dt.date(2002, 12, 31)]
    for most in (64, 1):
        own = tables.read_days(spark, str(tmp_path / "t"), days, most)
        assert own.count() == table.where(F.col("day").isin(days)).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows, files = scanned(tables.read_days(spark, str(tmp_path / "t"), days))
        _, every = scanned(spark.read.parquet(str(tmp_path / "t")))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert rows < 400_000 / 5 and files < every
    assert tables.read_days(spark, str(tmp_path / "t"), []).count() == 0


def test_ranges_of_days_close_the_smallest_gaps():
    d = [dt.date(2000, 1, k) for k in (1, 2, 3, 7, 20, 21)]
    assert tables.day_ranges(d) == [(d[0], d[2]), (d[3], d[3]), (d[4], d[5])]
    assert tables.day_ranges(d, 2) == [(d[0], d[3]), (d[4], d[5])]
    assert tables.day_ranges(d, 1) == [(d[0], d[5])]
    assert tables.day_ranges([]) == []


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    """An archive of points that writes down what it is asked for."""
    log = tmp_path_factory.mktemp("asked")

    def fetch(request):
        import json
        import uuid

        import pandas as pd

        (log / uuid.uuid4().hex).write_text(json.dumps(request))
        if request["product"] == "gap":
            return None
        days = pd.date_range(request["start"], request["end"])
        at = [(request["south"] + request["north"]) / 2]
        own = pd.DataFrame({"day": days.date}).assign(lat=at[0], lon=request["west"], depth=request["least"], salt=1.5, heat=2.5)
        return own

    subset.register(spark, "points", "product string, day date, lat double, lon double, depth double, salt double, heat double", fetch)

    def asked():
        import json

        found = [json.loads(p.read_text()) for p in log.iterdir()]
        for p in log.iterdir():
            p.unlink()
        return found

    return lambda **o: spark.read.format("points").options(products="sea,gap", years="2000,2001,2002", depths="0,10,100", box="5,25,50,100", **o).load(), asked


def test_filters_become_requests(archive):
    load, asked = archive
    rows = load().where("product = 'sea' AND day >= DATE '2001-12-30' AND day < DATE '2002-01-03' AND depth <= 10 AND lat BETWEEN 6 AND 8 AND lon > 60").collect()
    found = asked()
    assert len(found) == 4 and {(r["product"], r["least"], r["start"][:4]) for r in found} == {("sea", d, y) for d in (0.0, 10.0) for y in ("2001", "2002")}
    assert all((r["south"], r["north"], r["west"], r["east"]) == (6.0, 8.0, 60.0, 100.0) and r["variables"] == ["salt", "heat"] for r in found)
    assert {r["end"] for r in found} == {"2001-12-31T00:00:00", "2002-01-03T00:00:00"}  # midnight, and what isn't asked for is filtered again
    assert rows == []  # the archive's lon is the box's edge, which lon > 60 leaves out
    assert len(load().where("product = 'sea' AND day >= DATE '2001-12-30' AND day < DATE '2002-01-03' AND depth <= 10 AND lon >= 60").collect()) == 2 * 4
    asked()


def test_gaps_levels_and_impossible_filters(archive):
    load, asked = archive
    assert load().where("product = 'gap' AND depth = 100").count() == 0 and len(asked()) == 3
    assert load().where("depth IN (10, 100) AND day = DATE '2000-02-29' AND product = 'sea'").count() == 2 and len(asked()) == 2
    assert load().where("lat > 30").count() == 0 and asked() == []
    own = load(variables="heat").where("product = 'sea' AND depth = 0 AND day <= DATE '2000-01-02'")
    assert own.columns == ["product", "day", "lat", "lon", "depth", "heat"] and own.count() == 2
    assert [r["variables"] for r in asked()] == [["heat"]]
    assert load().where("depth + 1 > 10 OR product = 'sea'").count() > 0 and len(asked()) == 18  # nothing that can be told apart reaches the source

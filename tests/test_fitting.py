"""Fits against the closed form, searches against whole grids, records under several writers."""

import json
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwell.operators import fitting
from gridwell.plans import tables as T
from gridwell.sources import runs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples(spark):
    """Standardised truth and clim, and pred with gaps, of the stand-in's predictions."""
    own = T.predictions(spark, FOLDER).orderBy("t", "lat_i", "lon_j", "depth_k").toPandas()
    x = own[["truth", "clim"]].to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    x[:, 1] -= x[:, 0] * (x[:, 0] * x[:, 1]).mean()
    y = ((own["pred"] - own["pred"].mean()) / own["pred"].std()).to_numpy()
    rows = [([float(a), float(b)], [None if k % 7 == 0 else float(v), float(v) * 2 + 1], "val" if k % 5 == 0 else "train" if k % 11 else "test") for k, ((a, b), v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "x array<double>, y array<double>, split string")


def closed_form(rows, ridge):
    """Both targets' weights; the loss is the mean over all values, so the cost counts as often as there are values."""
    train = [r for r in rows if r.split == "train"]
    n = sum(v is not None for r in train for v in r.y)
    out = []
    for k in range(2):
        own = [r for r in train if r.y[k] is not None]
        x, y = np.array([[*r.x, 1.0] for r in own]), np.array([r.y[k] for r in own])
        out.append(np.linalg.solve(x.T @ x + ridge * n * np.diag([1.0, 1.0, 0.0]), x.T @ y))
    return np.array(out).T


def test_fit_is_the_closed_form_and_resumes(spark, samples, tmp_path):
    how = fitting.Fit(epochs=250, rate=0.3, ridge=0.01, plateau=15, patience=250)
    whole = fitting.fit(samples, how, str(tmp_path / "whole"))
    assert np.abs(np.array(whole.weights) - closed_form(samples.collect(), 0.01)).max() < 5e-3
    for _ in range(3):
        fitting.fit(samples, how, str(tmp_path / "parts"), stop_after=8)
    parts = str(tmp_path / "parts")
    told = {r.epoch: (r.loss, r.val_loss, r.rate) for r in fitting.history(spark, parts).collect()}
    assert told == {r.epoch: (r.loss, r.val_loss, r.rate) for r in fitting.history(spark, str(tmp_path / "whole")).where("epoch <= 24").collect()}
    stopped, at_once = (json.loads(runs.Log(spark, str(tmp_path / f)).entries()[23]) for f in ("parts", "whole"))
    assert stopped == at_once and stopped["epoch"] == 24
    with pytest.raises(ValueError, match="other settings.*rate"):
        fitting.fit(samples, fitting.Fit(epochs=250, rate=0.2, ridge=0.01), parts)
    shown = fitting.predicted(samples, whole.weights).limit(5).collect()
    assert all(np.allclose(r.z, np.array([*r.x, 1.0]) @ np.array(whole.weights)) for r in shown)


def test_fits_end_early(spark, samples, tmp_path):
    few = samples.limit(60)
    calm = fitting.fit(few, fitting.Fit(epochs=60, rate=1.0, patience=3, plateau=2, better=0.05), str(tmp_path / "calm"))
    assert calm.ended == "no better" and calm.epoch < 60 and calm.rate < 1.0
    broken = few.withColumn("y", F.when(F.col("split") == "train", F.array(F.lit(float("inf")), F.lit(1.0))).otherwise(F.col("y")))
    assert fitting.fit(broken, fitting.Fit(epochs=5), str(tmp_path / "broken")).ended == "not a number"
    with pytest.raises(ValueError, match="no training values"):
        fitting.fit(few.where("split = 'val'"), fitting.Fit(epochs=2), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="no samples"):
        fitting.fit(few.where("false"), fitting.Fit(epochs=2), str(tmp_path / "empty"))


def test_search_finds_the_best_in_fewer_trials(spark, tmp_path):
    space = fitting.Space({"filters": [16, 32, 48, 64, 80, 96], "rate": [10.0**-k for k in range(1, 8)], "depth": [2, 3, 4, 5]}, ("rate",))

    def objective(s):
        return (math.log10(s["rate"]) + 4) ** 2 + ((s["filters"] - 64) / 32) ** 2 + (s["depth"] - 3) ** 2 / 2

    calls = []

    def counted(s):
        calls.append(s)
        if s["filters"] == 16 and s["depth"] == 5:
            raise RuntimeError("out of memory")
        return objective(s)

    trials = fitting.search(spark, space, counted, str(tmp_path / "a"), 40, {"data": "v1"})
    best = min((t for t in trials if t["objective"] is not None), key=lambda t: t["objective"])
    assert (best["filters"], best["rate"], best["depth"]) == (64, 1e-4, 3) and len(trials) == 40 < len(space.grid()) == 168
    assert len({tuple(c.items()) for c in calls}) == 40
    assert fitting.search(spark, space, counted, str(tmp_path / "a"), 40, {"data": "v1"}) == trials and len(calls) == 40
    for n in (7, 20, 40):
        parts = fitting.search(spark, space, counted, str(tmp_path / "b"), n, {"data": "v1"})
    assert parts == trials
    with pytest.raises(ValueError, match="other settings.*data"):
        fitting.search(spark, space, counted, str(tmp_path / "a"), 41, {"data": "v2"})
    assert fitting.search(spark, space, counted, str(tmp_path / "c"), 5, seconds=-1) == []
    tiny = fitting.Space({"x": [1, 2]})
    assert len(fitting.search(spark, tiny, lambda s: float("nan"), str(tmp_path / "d"), 9)) == 2


def test_two_writers_lose_nothing(spark, tmp_path):
    store = runs.Runs(spark, str(tmp_path / "runs"))
    with pytest.raises(FileNotFoundError):
        store.read()

    def write(k):
        for i in range(4):
            runs.Runs(spark, str(tmp_path / "runs")).add(spark.createDataFrame([(k, i, float(k + i))], "writer int, i int, loss double"))

    writers = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    own = store.read().collect()
    assert sorted((r.writer, r.i) for r in own) == [(k, i) for k in range(3) for i in range(4)]
    assert sorted(r.added for r in own) == list(range(1, 13))
    spark.createDataFrame([(9, 9, 9.0)], "writer int, i int, loss double").write.parquet(str(tmp_path / "runs/part-0"))  # written, and never added
    assert store.read().count() == 12


def test_entries_are_never_changed(spark, tmp_path):
    log = runs.Log(spark, str(tmp_path / "log"))
    assert (log.entries(), log.last()) == ([], None)
    assert [log.commit("a"), log.commit("é\n"), log.commit("c", 7), log.commit("d")] == [1, 2, 7, 8]
    with pytest.raises(FileExistsError):
        log.commit("x", 7)
    assert log.entries() == ["a", "é\n", "c", "d"]
    own = runs.checked_settings(spark, str(tmp_path / "s"), {"b": [1, 2], "a": None})
    assert own == runs.checked_settings(spark, str(tmp_path / "s"), {"a": None, "b": (1, 2)}) == runs.fingerprint({"a": None, "b": [1, 2]})
    with pytest.raises(ValueError, match="'b': ..1, 2., .3.."):
        runs.checked_settings(spark, str(tmp_path / "s"), {"a": None, "b": [3]})

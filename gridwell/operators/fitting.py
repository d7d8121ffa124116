"""Fitting and search as Spark jobs: gradients that tasks sum, a checkpoint each epoch, and settings proposed from what earlier trials gave.

A model here is linear in its inputs, for several targets with gaps, and its loss the mean square over the targets that are there. An epoch
is one pass: each task gives the sums of its rows, a row per task reaches the driver, and weights move by them. What an epoch ends
with is written before the next begins, so a run that was killed goes on where it stood, to the same weights.
"""

from __future__ import annotations

import itertools
import json
import math
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import runs


@dataclass(frozen=True)
class Fit:
    """How a fit goes: rate and when it falls, when to stop, how much large weights cost."""

    epochs: int = 200
    rate: float = 0.05
    ridge: float = 0.0
    #: Epochs without a better validation loss after which the rate falls by factor, and after which the fit ends.
    plateau: int = 5
    factor: float = 0.5
    least_rate: float = 1e-5
    patience: int = 20
    #: How much better a loss must be to count.
    better: float = 1e-7


@dataclass(frozen=True)
class State:
    """Where a fit stands after an epoch; weights have a row for each input and one for the offset, a column for each target."""

    epoch: int
    weights: list[list[float]]
    best: list[list[float]]
    slow: list[list[float]]
    square: list[list[float]]
    rate: float
    best_loss: float = math.inf
    waited: int = 0
    stalled: int = 0
    loss: float = math.nan
    val_loss: float = math.nan
    ended: str = ""


def _sums(weights: np.ndarray):
    """Per task and split: values that are there, the sum of their squared errors, and its gradient."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        inputs, targets = weights.shape[0] - 1, weights.shape[1]
        total = {s: [0, 0.0, np.zeros_like(weights)] for s in ("train", "val")}
        for batch in batches:
            x = np.column_stack([batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, inputs), np.ones(batch.num_rows)])
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, targets)
            split = np.array(batch.column("split").to_pylist(), object)
            for name, own in total.items():
                rows = split == name
                error = x[rows] @ weights - y[rows]
                there = ~np.isnan(error)
                error[~there] = 0.0
                own[0] += int(there.sum())
                own[1] += float((error * error).sum())
                own[2] += 2 * x[rows].T @ error
        rows = [(s, n, e, g.ravel().tolist()) for s, (n, e, g) in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["split", "n", "error", "gradient"])

    return run


def gradient(samples: DataFrame, weights: np.ndarray) -> dict[str, tuple[int, float, np.ndarray]]:
    """For train and val: values, mean squared error, and the gradient of that by the weights. samples: x array<double>, y array<double> with nulls for gaps, split."""
    tasks = samples.select("x", "y", "split").mapInArrow(_sums(weights), "split string, n long, error double, gradient array<double>").withColumn("task", F.spark_partition_id())
    out = {s: (0, 0.0, np.zeros_like(weights)) for s in ("train", "val")}
    for r in sorted(tasks.collect(), key=lambda r: (r.task, r.split)):  # two rows a task, in one order, so that sums are the same at every run
        n, e, g = out[r.split]
        out[r.split] = n + r.n, e + r.error, g + np.array(r.gradient).reshape(weights.shape)
    return {s: (n, e / n if n else math.nan, g / n if n else g) for s, (n, e, g) in out.items()}


def _next(state: State, how: Fit, found: dict) -> State:
    """The state after one more epoch, by momentum and scale of the gradients."""
    (n, loss, slope), (held, val_loss, _) = found["train"], found["val"]
    if not n:
        raise ValueError("no training values")
    weights = np.array(state.weights)
    cost = how.ridge * weights
    cost[-1] = 0.0  # the offset is free
    loss, slope, epoch = loss + float((cost * weights).sum()), slope + 2 * cost, state.epoch + 1
    watched = val_loss if held else loss
    if not math.isfinite(loss) or not math.isfinite(watched):
        return replace(state, epoch=epoch, loss=loss, val_loss=val_loss, ended="not a number")
    improved = watched < state.best_loss - how.better
    waited, stalled = (0, 0) if improved else (state.waited + 1, state.stalled + 1)
    rate = state.rate
    if stalled >= how.plateau:
        rate, stalled = max(rate * how.factor, how.least_rate), 0
    slow = 0.9 * np.array(state.slow) + 0.1 * slope
    square = 0.999 * np.array(state.square) + 0.001 * slope * slope
    moved = weights - rate * (slow / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.999**epoch)) + 1e-8)
    ended = "no better" if waited >= how.patience else "all epochs" if epoch >= how.epochs else ""
    best = state.weights if improved else state.best
    return State(epoch, moved.tolist(), best, slow.tolist(), square.tolist(), rate, watched if improved else state.best_loss, waited, stalled, loss, val_loss, ended)


def fit(samples: DataFrame, how: Fit, folder: str, stop_after: int | None = None) -> State:
    """Fits samples (x array<double>, y array<double> with nulls for gaps, split "train" or "val"; others take no part) and returns the last state; folder has one file an epoch.

    Losses of an epoch are those of the weights that it begins with, and best are the weights of the smallest validation loss (of the
    training loss where nothing is held out). A folder with epochs is gone on with, if its settings are the same. stop_after ends this call after so many epochs more. samples
    are read once an epoch, so they should be a written table.
    """
    spark, log = samples.sparkSession, runs.Log(samples.sparkSession, folder)
    runs.checked_settings(spark, f"{folder}-settings", asdict(how))
    done = log.last()
    if done:
        state = State(**json.loads(done))
    else:
        shape = samples.select(F.size("x").alias("d"), F.size("y").alias("k")).first()
        if shape is None:
            raise ValueError("no samples")
        zero = np.zeros((shape.d + 1, shape.k)).tolist()
        state = State(0, zero, zero, zero, zero, how.rate)
    began = state.epoch
    while not state.ended and (stop_after is None or state.epoch < began + stop_after):
        state = _next(state, how, gradient(samples, np.array(state.weights)))
        log.commit(json.dumps(asdict(state)), state.epoch)
    return state


def history(spark: SparkSession, folder: str) -> DataFrame:
    """The epochs of a fit: epoch, loss, val_loss, rate, ended."""
    rows = [json.loads(text) for text in runs.Log(spark, folder).entries()]  # an entry an epoch
    return spark.createDataFrame([(r["epoch"], r["loss"], r["val_loss"], r["rate"], r["ended"]) for r in rows], "epoch int, loss double, val_loss double, rate double, ended string")


def predicted(samples: DataFrame, weights: Sequence[Sequence[float]]) -> DataFrame:
    """samples with z, the targets that weights give for x, by built-in functions."""
    *rows, offset = [list(map(float, w)) for w in weights]
    columns = [F.aggregate(F.zip_with("x", F.array(*[F.lit(w[k]) for w in rows]), lambda a, b: a * b), F.lit(offset[k]), lambda a, v: a + v) for k in range(len(offset))]
    return samples.withColumn("z", F.array(*columns))


@dataclass(frozen=True)
class Space:
    """Settings by name, each with the values that it can have, in an order that means nearness."""

    values: Mapping[str, Sequence[float]]
    #: Names whose values are compared by their logarithms.
    logarithmic: Sequence[str] = field(default_factory=tuple)

    def grid(self) -> list[dict]:
        return [dict(zip(self.values, v, strict=True)) for v in itertools.product(*self.values.values())]

    def points(self, settings: Sequence[dict]) -> np.ndarray:
        """Settings as places in a unit cube."""
        columns = []
        for name, values in self.values.items():
            scale = np.log if name in self.logarithmic else np.asarray
            low, high = float(np.min(scale(np.asarray(values, float)))), float(np.max(scale(np.asarray(values, float))))
            columns.append((scale(np.array([s[name] for s in settings], float)) - low) / ((high - low) or 1.0))
        return np.column_stack(columns)


def _surrogate(known: np.ndarray, heights: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations at places, of a Gaussian process through heights at known places; of a few widths the likeliest."""

    def kernel(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
        return np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) / (2 * width * width))

    level, spread = float(heights.mean()), float(heights.std()) or 1.0
    y = (heights - level) / spread
    best = None
    for width in (0.1, 0.2, 0.4, 0.8):
        root = np.linalg.cholesky(kernel(known, known, width) + 1e-6 * np.eye(len(known)))
        solved = np.linalg.solve(root, y)
        likelihood = -0.5 * solved @ solved - np.log(np.diag(root)).sum()
        if best is None or likelihood > best[0]:
            best = likelihood, width, root, solved
    _, width, root, solved = best
    across = np.linalg.solve(root, kernel(known, at, width))
    return level + spread * (across.T @ solved), spread * np.sqrt(np.maximum(1.0 - (across * across).sum(axis=0), 1e-12))


def proposed(space: Space, trials: Sequence[dict], seed: int = 42, first: int = 5) -> dict | None:
    """The setting to try next: at first by chance, then the one with the largest expected gain on the smallest objective so far; None where all were tried.

    trials: settings with objective, None or not finite for failed ones, which aren't tried again. The same trials and seed give the same setting.
    """
    seen = {tuple(t[k] for k in space.values) for t in trials}
    left = [s for s in space.grid() if tuple(s.values()) not in seen]
    if not left:
        return None
    good = [t for t in trials if t.get("objective") is not None and math.isfinite(t["objective"])]
    rng = np.random.default_rng([seed, len(trials)])
    if len(good) < first:
        return left[int(rng.integers(len(left)))]
    heights = np.array([t["objective"] for t in good])
    mean, deviation = _surrogate(space.points(good), heights, space.points(left))
    gain = heights.min() - mean
    z = gain / deviation
    chance = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    expected = gain * chance + deviation * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return left[int(np.argmax(expected))]


def search(spark: SparkSession, space: Space, objective: Callable[[dict], float], folder: str, trials: int, settings: Mapping[str, object] | None = None, seconds: float = math.inf, seed: int = 42, first: int = 5) -> list[dict]:
    """Up to trials settings of space with their objective and error; folder has one file a trial, and a search goes on from there.

    settings: what objectives are only comparable under; a folder that was made under others is refused. A trial that has begun is ended, none begins after
    seconds. An objective that fails has None and the error.
    """
    runs.checked_settings(spark, f"{folder}-settings", dict(settings or {}) | {"space": {k: list(v) for k, v in space.values.items()}, "seed": seed})
    log, until = runs.Log(spark, folder), time.monotonic() + seconds
    done = [json.loads(t) for t in log.entries()]  # an entry a trial
    while len(done) < trials and time.monotonic() < until and (setting := proposed(space, done, seed, first)) is not None:
        try:
            found, error = float(objective(setting)), ""
        except Exception as e:  # a failed trial doesn't end the search
            found, error = None, f"{type(e).__name__}: {e}"
        done.append(setting | {"objective": found if found is not None and math.isfinite(found) else None, "error": error})
        log.commit(json.dumps(done[-1]), len(done))
    return done

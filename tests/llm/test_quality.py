"""The lines that the field is trained on."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from gridwell.llm import quality as Q


def texts(n, lines, size=12):
    rng = random.Random(n)
    words = [f"Word{i}" for i in range(200)]
    made = ["\n".join(" ".join(rng.choices(words, k=rng.randrange(size))) for _ in range(rng.randrange(lines))) for _ in range(n)]
    return pa.array(["", *made, None, " \n\n", "one"], pa.string())


def test_lines_in_steps_are_those_of_whole(monkeypatch):
    for step in (1, 700, 1 << 18):
        monkeypatch.setattr(Q, "LEARN_BYTES", step)
        for a, b in zip(Q.lines_in_steps(texts(60, 30)), Q.lines_of(texts(60, 30)), strict=True):
            assert a.dtype == b.dtype and np.array_equal(a, b)


def test_training_takes_little_memory_beside_its_lines():
    """Of 3 MB of training texts, finding the lines in one go took 155 MB of the driver, and in steps it takes 12 (besides what is kept for later calls)."""
    rows = [(t, k % 2) for k, t in enumerate(texts(1600, 12, 100).to_pylist()) if t]
    Q.train(rows[:20], 0.5, steps=1)  # what is kept for later calls
    tracemalloc.start()
    Q.train(rows, 0.5, steps=1)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert sum(len(t) for t, _ in rows) > 2e6 and most < 60, most

"""Connected components of links."""

import random

import pytest

from gridwell.llm import components as C


def smallest(links):
    """Each node of links with the smallest that it reaches, if that is another."""
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {(x, find(x)) for x in root if find(x) != x}


def made(rng):
    """A long chain in random order, a large star round its largest node, a cycle, and scattered links; some repeat, both ways."""
    chain = rng.sample(range(-500, 0), 500)
    links = list(zip(chain, chain[1:], strict=False)) + [(9_999, i) for i in range(1_000, 1_200)] + [(2_000 + i, 2_000 + (i + 1) % 40) for i in range(40)]
    links += [tuple(rng.sample(range(3_000, 3_400), 2)) for _ in range(150)]
    links += [(v, u) for u, v in rng.sample(links, 100)]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("part", [0, 100, 7])
def test_components_by_union_of_sets(spark, monkeypatch, part):
    monkeypatch.setattr(C, "PART", part or C.PART)
    links = made(random.Random(part))
    table = spark.createDataFrame([*links, (None, 5), (6, None), (7, 7)], "u long, v long")
    found = [(r.u, r.v) for r in C.components(table).collect()]
    assert len(found) == len(set(found)) and set(found) == smallest(links)
    assert C.components(table.where("false")).count() == 0


def test_few_links_take_few_jobs(spark):
    """The driver keeps threads, plans and metrics of each job; a chain of 500 links took a job for each exchange of many steps."""
    context = spark.sparkContext
    table = spark.createDataFrame(made(random.Random(1)), "u long, v long")
    context.setJobGroup("components", "components")
    try:
        C.components(table)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(context.statusTracker().getJobIdsForGroup("components")) <= 8

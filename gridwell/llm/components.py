"""Connected components of a table of links, by alternating large and small stars.

First each task makes stars of PART links at most, which joins what these connect; up to PART links that is all. With more, steps
follow that are an aggregation and an equi-join on the links each. Every step is written to the shared folder, and
never brings links to the driver; only a count and a checksum tell whether a step changed anything.

Without the first step a few thousand links took as many steps as many do, and the driver keeps threads, plans and metrics of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, written

#: Links that one task contracts.
PART = 1 << 17


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v), ascending, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(open_ := np.flatnonzero(root[a] != root[b])):
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return nodes, nodes[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: each node that isn't its component's smallest there, and that smallest one."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        node, root = roots_of(*(np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("u", "v")))
        other = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], names=["u", "v"])


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return row[0], row[1] or 0


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long) to (u, v): for each node that isn't its component's smallest, that smallest one as v.

    Links may repeat and go either way; links with a null or to itself are left out. No links, no rows.
    """
    shared_folder(links.sparkSession)
    stars = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parts = -(-stars.count() // PART)
    dealt = stars.repartition(parts) if parts > 1 else stars.coalesce(1)
    stars = written(dealt.mapInArrow(_contracted, "u long, v long"))
    if parts <= 1:
        return stars
    before = _state(stars)
    while before[0]:
        stars = _small_star(_large_star(stars)).checkpoint()
        after = _state(stars)
        if after == before:
            break
        before = after
    return stars

"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint of 64 bits is mapped to the numbers of set bits of its 32 segments of 2 bits. The
Manhattan distance of two such vectors is never more than the Hamming distance of the fingerprints, so
it is a lower bound. The grid join cuts the dimensions into parts: vectors within Manhattan distance d
differ in d parts at most, so they lie in one cell of the grid over some choice of all other
parts. Every point is sent to its cell of each such choice, so a pair meets in an equi-join on cells, is held
against the Manhattan bound and then verified exactly. More parts make more rows and smaller cells, so their
number follows the number of points; the links are the same. Numbers of bits are written in unary (sorted
bits of a segment), which makes the Manhattan distance a count of bits as well.

Rows with equal fingerprints are one node, so a group of copies costs one row however large it is. A
fingerprint has at most 43,744 others within 3 bits, and no more than 128 are within 3 bits of each
other, so links never grow with the square of a group's rows.

Where similarity of shingle sets is asked for instead of a distance of fingerprints, no radius finds all
pairs; then these links are candidates, and nearcopies.py finds the others exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, shared_folder, slices
from .components import components

#: Shingles whose bits are counted at once, so that a long text needs no more memory.
BLOCK = 1 << 15
SEED = 42
LOW_BITS = 0x5555555555555555
#: Segments of 2 bits, and the chance that two random ones have as many bits set.
SEGMENTS, SAME_COUNT = 32, 0.375
#: What sending a row costs, in comparisons of a pair.
ROW_COST = 8


def hashed(text: bytes, words: int) -> bytes:
    """The hashes of the text's shingles in order, repeats included; a shorter text is one shingle, a text without words has none."""
    parts = text.lower().split()  # of bytes: A-Z alone, and ASCII white space alone
    if not parts:
        return b""
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else iter([b" ".join(parts)])
    return b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of text as a signed 64-bit number; bit i is set if it is set in over half the shingles' hashes."""
    return majority(hashed(text, words))


def majority(digests: bytes) -> int:
    """The bits that over half of the digests have; 0 of none."""
    hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    n = len(hashes)
    if not n:
        return 0
    ones = sum(np.unpackbits(hashes[i : i + BLOCK], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, n, BLOCK))
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs (doc_id, text; others are ignored) to (doc_id, fp long). A null text is an empty one: fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = [fingerprint(t or b"", words) for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _embedded(fp: Column) -> Column:
    """Numbers of set bits of the 2-bit segments, each in unary in its own two bits."""
    up = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(up).bitwiseAND(F.lit(LOW_BITS)), 1).bitwiseOR(fp.bitwiseOR(up).bitwiseAND(F.lit(LOW_BITS)))


def parts_of(points: int, distance: int) -> int:
    """Into how many parts the dimensions are cut: rows and chance meetings of a point together should be few."""

    def cost(parts: int) -> float:
        choices = math.comb(parts, distance)
        return ROW_COST * choices + choices * SAME_COUNT ** (SEGMENTS * (parts - distance) // parts) * points

    return min(range(distance + 1, distance + 9), key=cost)


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """nodes (fp long, each once) to all pairs (u, v) of fingerprints that differ in at most distance bits (0 to 8); each pair once.

    nodes is read three times. Pairs meet in cells, and Spark splits cells that are much larger than others.
    """
    if not 0 <= distance <= 8:
        raise ValueError("distances from 0 to 8 bits")
    parts = parts_of(nodes.count(), distance)
    edges = [2 * (SEGMENTS * i // parts) for i in range(parts + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    grids = [sum(chosen) for chosen in itertools.combinations(masks, parts - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in grids]
    points = nodes.select("fp", _embedded(F.col("fp")).alias("at"))
    cells = points.select("fp", "at", F.explode(F.array(*[F.struct(F.lit(k).alias("grid"), F.col("at").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(signed)])).alias("c")).select("fp", "at", "c.grid", "c.cell")
    other = cells.withColumnsRenamed({"fp": "fp2", "at": "at2"})
    near = (F.bit_count(F.col("at").bitwiseXOR(F.col("at2"))) <= distance) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance)
    met = cells.hint("merge").join(other, ["grid", "cell"]).where((F.col("fp") < F.col("fp2")) & near)
    return met.select(F.col("fp").alias("u"), F.col("fp2").alias("v")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """Per row of docs (doc_id, text; others are ignored): doc_id, fp, and the smallest doc_id that links reach from it.

    Rows with equal fingerprints are one node; fingerprints that differ in at most distance bits are linked.
    Texts without words, null ones among them, have fingerprint 0 and are linked like any other. A very long text is
    hashed in one go; its bits are counted in parts. A null doc_id is never the smallest unless a component has
    no other. Repeated rows stay; an empty table gives none.
    """
    shared_folder(docs.sparkSession)
    marked = fingerprints(docs, words).checkpoint()
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

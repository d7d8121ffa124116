"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found exactly.

Most links are found cheaply first: nodes with the same least token, then those with the same least token by another hash
and those whose SimHash fingerprints are within a few bits (the grid join of simhash.py), meet in groups of bounded
size and are compared by their whole sets. None of this finds all pairs (at a similarity of 0.8 about 10 of 64 bits differ).

What is left is between components. A node whose tokens are more than a fifth in its own component alone has no match outside; a
third of all tokens tells this of nearly all nodes, the others of the rest; then the tokens of what is left tell it once more. Nodes that may have one are joined by
signatures: the content of parts of whole sets, as in jaccard.py, which a line that many texts share fills differently in each text. With twice as many parts as similar
sets can differ in, such sets have many in common, among them one of the rarest of either; so the frequent ones are left out. Pairs that meet there can still be
many in a large group of copies that are nearly similar enough. How far sets are apart at least is therefore told closely: by the tokens that each has alone, and a sketch of the others. Tokens and
signatures are hundreds a text, so they are never written: tasks make them from the texts and pack them by ranges, and a range
gives back counts, or signatures of several components alone. Every link is verified on the whole sets.

Texts with equal sets are one node, and what is connected already isn't held against each other again, so a large group costs about a link per node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from . import jaccard, simhash
from .common import mix, shared_folder, slices, written
from .components import components

WORDS, BITS, PERCENT = 5, 3, 80
#: Values that a task packs at once, and that a range has, about; small tables have up to RANGES ranges all the same.
PACKED, RANGE, RANGES = 1 << 20, 1 << 20, 32
#: The tokens that are looked at first: those with remainder 0 by this.
SHARE = 3
#: Times as many parts as similar sets can differ in, and bits of a sketch.
TIMES, SKETCH = 2, 1024
#: The lowest bits of a signature, which tell its band and deal.
KINDS = 8

MARKS = "row long, doc_id long, key long, hash long, high long, low long, n int, fp long, least long, second long"
PACKS = "part int, first long, gaps binary, roots binary, counts binary, signs binary"


def _digests(own: list[np.ndarray]) -> np.ndarray:
    """The 128 bits of each set in two columns."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(o.tobytes()) for o in own), ">i8").astype(np.int64).reshape(-1, 2)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        hashes = [simhash.hashed(t or b"", WORDS) for t in part.column("text").cast(pa.binary()).to_pylist()]
        own = list(map(jaccard.set_of, hashes))
        digests = _digests(own)
        least = pa.array([int(o[0]) if len(o) else None for o in own], pa.int64())
        second = pa.array([int(mix(o.view(np.uint64)).view(np.int64).min()) if len(o) else None for o in own], pa.int64())
        given = [part.column(c) for c in ("row", "doc_id", "key", "hash")]
        columns = [*given, pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(map(len, own), pa.int32()), pa.array(map(simhash.majority, hashes), pa.int64()), least, second]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "key", "hash", "high", "low", "n", "fp", "least", "second"])


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes (node, fp) that link all those with equal fingerprints and those within BITS bits by their first nodes."""
    nodes = written(nodes)
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    same = nodes.join(first.withColumnRenamed("node", "u"), "fp").where("node != u").select("u", F.col("node").alias("v"))
    apart = simhash.links(first.select("fp"), BITS)
    named = apart.join(first.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v")
    return same.unionByName(named.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def _texts(docs: DataFrame, wanted: DataFrame, *more: str) -> DataFrame:
    """The texts of wanted nodes (node, hash, times, high, low and more), a row for each row of wanted; a text whose hash alone is a node's may be among them."""
    given = jaccard._checked(wanted.select("hash", "times", "high", "low", "node", *more))
    found = docs.select("text", F.xxhash64("text").alias("hash")).join(given, "hash")
    return found.where("times = 1").unionByName(found.where("times > 1").dropDuplicates(["node", *more, "text"]))


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows (high, low, text and others) and their sets; rows whose set isn't that of these digests are left out."""
    for part in slices(batches):
        own = [jaccard.shingles(t or b"", WORDS) for t in part.column("text").cast(pa.binary()).to_pylist()]
        digests = _digests(own)
        held = np.flatnonzero((digests[:, 0] == part.column("high").to_numpy()) & (digests[:, 1] == part.column("low").to_numpy()))
        if len(held):
            yield part.take(pa.array(held)), [own[i] for i in held]


def _deals(own: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """The signatures of a set as jaccard.signatures() deals them, but with more parts: of each deal the signatures, their kind and how many most frequent ones aren't needed.

    Of the parts that a set fills in a deal, at most as many as similar sets differ in are another's differently. So of the one more that are the rarest by an
    order of all signatures, one is in common, and the rarest that two sets have in common is among these for both. A deal with fewer filled parts
    is whole, and followed by another; after the last one empty parts count as well.
    """
    tokens, bands = own.view(np.uint64), jaccard._bands(PERCENT)
    band = int(np.searchsorted(bands, len(own), side="right")) - 1
    values = mix(tokens + np.uint64(0x5851F42D4C957F2D))
    for scheme in range(max(band - 1, 0), band + 1):
        differ = jaccard._parts(scheme, PERCENT)[0]
        n = TIMES * (differ + 1)
        for deal in range(jaccard.DEALS if differ else 0):
            part = (mix(tokens ^ np.uint64((deal + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(n)).astype(np.int64)
            sizes = np.bincount(part, minlength=n)
            ends = np.cumsum(sizes)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[np.argsort(part, kind="stable")])])
            content = mix(mix(sums[ends] - sums[ends - sizes]) + np.arange(n, dtype=np.uint64) + np.uint64((scheme << 8 | deal) << 40))
            filled = int(np.count_nonzero(sizes))
            if filled > differ or deal < jaccard.DEALS - 1:
                content = content[sizes > 0]
            kind = scheme % 2 * jaccard.DEALS + deal
            yield content & ~np.uint64(KINDS - 1) | np.uint64(kind), kind, max(filled - differ - 1, 0)
            if filled > differ:
                break


def signatures(own: np.ndarray) -> np.ndarray:
    """Hashes of which two different sets (sorted distinct tokens) have at least one in common if they are similar enough, also among those that _spare() leaves of each."""
    return np.concatenate([np.zeros(0, np.uint64), *(found for found, _, _ in _deals(own))]).view(np.int64)


def _spare(own: np.ndarray) -> np.ndarray:
    """How many of a set's signatures of each kind aren't needed, if these are the most frequent ones."""
    spare = np.zeros(KINDS, np.int64)
    for _, kind, n in _deals(own):
        spare[kind] = n
    return spare


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, own in _with_sets(batches):
        columns = [part.column("node"), part.column("group"), jaccard._lists(own), jaccard._lists(list(map(_spare, own)))]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "group", "own", "spare"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside groups, of rows sorted by group and node."""

    def sets() -> Iterator[pa.RecordBatch]:
        for part, own in _with_sets(batches):
            zeros = pa.array(np.zeros(len(own), np.int32))
            yield pa.RecordBatch.from_arrays([part.column("group"), zeros, zeros, part.column("node"), jaccard._lists(own)], names=["group", "salt", "kind", "node", "own"])

    return jaccard._inside(PERCENT)(sets())


def _grouped(docs: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (u, v) of similar nodes (with their roots so far) that meet in a group; large groups are dealt into smaller ones at random, and those of one root are left out."""
    at = groups.join(nodes, "node").select("group", "node", "root", "n", "hash", "times", "high", "low")
    chunks = at.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / jaccard.MEMBERS, F.sum(F.col("n").cast("long")) / jaccard.TOKENS)).alias("chunks"), F.min("root").alias("a"), F.max("root").alias("b"))
    dealt = at.join(chunks.where("a != b").select("group", "chunks"), "group").withColumn("group", F.xxhash64("group", F.pmod(F.xxhash64("node", "group"), "chunks")))
    dealt = written(dealt.drop("chunks"))
    several = dealt.groupBy("group").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("group")
    texts = _texts(docs, dealt.join(several, "group", "left_semi"), "group").select("group", "node", "high", "low", "text")
    return written(texts.repartition("group").sortWithinPartitions("group", "node").mapInArrow(_linked, jaccard.LINKS))


def _least_type(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max())))


def _some(tokens: np.ndarray) -> np.ndarray:
    return tokens[tokens.view(np.uint64) % np.uint64(SHARE) == 0]


def _others(tokens: np.ndarray) -> np.ndarray:
    return tokens[tokens.view(np.uint64) % np.uint64(SHARE) != 0]


def _pack(parts: int, values: Callable[[np.ndarray], np.ndarray]):
    """What values() gives of the sets of rows (node, root, high, low, text), by ranges: of each node the distance to the one before, 32 bits of its root, how many values it has there, and 32 bits of each."""

    def packed(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[0])
        nodes, roots = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        signs = np.concatenate([r[2] for r in rows]).view(np.uint64)
        part = ((signs >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, signs = part[order], signs[order].astype(np.uint32)
        owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])[order]
        start = np.flatnonzero(np.diff(part, prepend=-1) | np.diff(owner, prepend=-1))
        count, owner, at = np.diff(start, append=len(part)), owner[start], part[start]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        columns = [[] for _ in range(6)]
        for i, j in zip(first, np.append(first[1:], len(at)), strict=True):
            p, own = int(at[i]), nodes[owner[i:j]]
            tags = (mix((roots[owner[i:j]] ^ np.int64(p << 1 | 1)).view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
            ends = start[i], start[j] if j < len(at) else len(part)
            for column, value in zip(columns, (p, int(own[0]), _least_type(np.diff(own, prepend=own[0])).tobytes(), tags.tobytes(), _least_type(count[i:j]).tobytes(), signs[slice(*ends)].tobytes()), strict=True):
                column.append(value)
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "first", "gaps", "roots", "counts", "signs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for part, own in _with_sets(batches):
            for node, root, tokens in zip(part.column("node").to_pylist(), part.column("root").to_pylist(), own, strict=True):
                found = values(tokens)
                if len(found):
                    rows.append((node, root, found))
                    n += len(found)
            if n >= PACKED:
                yield packed(rows)
                rows, n = [], 0
        if rows:
            yield packed(rows)

    return run


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one range: nodes, 32 bits of their values, whether nodes of several roots have the value, and how many times it is there."""
    nodes, roots, signs = [], [], []
    for r in table.to_pylist():
        tags = np.frombuffer(r["roots"], np.uint32)
        gaps, counts = (np.frombuffer(r[c], f"u{len(r[c]) // len(tags)}").astype(np.int64) for c in ("gaps", "counts"))
        nodes.append(np.repeat(r["first"] + np.cumsum(gaps), counts))
        roots.append(np.repeat(tags, counts))
        signs.append(np.frombuffer(r["signs"], np.uint32))
    nodes, roots, signs = map(np.concatenate, (nodes, roots, signs))
    order = np.argsort(signs, kind="stable")
    nodes, roots, signs = nodes[order], roots[order], signs[order]
    start = np.flatnonzero(np.diff(signs.astype(np.int64), prepend=-1))
    several = np.minimum.reduceat(roots, start) != np.maximum.reduceat(roots, start)
    times = np.diff(start, append=len(signs))
    return nodes, signs, np.repeat(several, times), np.repeat(times, times)


def _of_several(table: pa.Table) -> pa.Table:
    """The values of a range that nodes of several roots have, with these nodes and how many times the value is there."""
    nodes, signs, several, times = _unpacked(table)
    return pa.table({"sign": signs[several].astype(np.int64) | table.column("part")[0].as_py() << 32, "node": nodes[several], "times": times[several]})


def _alone(table: pa.Table) -> pa.Table:
    """How many values of a range each node has that no other root has."""
    nodes, _, several, _ = _unpacked(table)
    node, times = np.unique(nodes[~several], return_counts=True)
    return pa.table({"node": node, "alone": times})


def _spots(table: pa.Table) -> pa.Table:
    """The places in a sketch (16 bits each) of the values of a range that each node has and other roots as well."""
    nodes, signs, several, _ = _unpacked(table)
    nodes, signs = nodes[several], (signs[several] % SKETCH).astype(np.uint16)
    order = np.argsort(nodes, kind="stable")
    nodes, signs = nodes[order], signs[order]
    start = np.flatnonzero(np.diff(nodes, prepend=-1))
    return pa.table({"node": nodes[start], "spots": pa.array([s.tobytes() for s in np.split(signs, start[1:])] if len(start) else [], pa.binary())})


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many places each node has, and which of them an odd number of times."""
    for batch in batches:
        spots = [np.frombuffer(b"".join(s), np.uint16) for s in batch.column("spots").to_pylist()]
        odd = [np.packbits(np.bincount(s, minlength=SKETCH).astype(np.uint8) & 1).view(np.int64) for s in spots]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(len, spots), pa.int32()), jaccard._lists(odd)], names=["node", "held", "odd"])


def _packs(docs: DataFrame, nodes: DataFrame, values: Callable[[np.ndarray], np.ndarray], share: float) -> GroupedData:
    """The ranges of what values() gives of the nodes' sets, about share times as many as tokens.

    A root is told by 32 bits that are others in each range: two roots that are taken for one in a range (a chance of 2**-32) hide what they alone share
    there. Two values that are taken for one only make a candidate more.
    """
    total = int(share * (nodes.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0))
    parts = max(total // RANGE, min(RANGES, total >> 12), 1)
    return _texts(docs, nodes, "root").select("node", "root", "high", "low", "text").mapInArrow(_pack(parts, values), PACKS).groupBy("part")


def _open_nodes(docs: DataFrame, nodes: DataFrame, values: Callable[[np.ndarray], np.ndarray], share: float) -> DataFrame:
    """The nodes (with alone, tokens known so far that other roots lack) that can have a match of another root as far as these tokens tell."""
    alone = _packs(docs, nodes, values, share).applyInArrow(_alone, "node long, alone long").groupBy("node").agg(F.sum("alone").alias("more"))
    counted = nodes.join(alone, "node", "left").withColumn("alone", F.col("alone") + F.coalesce("more", F.lit(0))).drop("more")
    return written(counted.where(f"100 * alone <= {100 - PERCENT} * n"))


def _sketches(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that can have a match of another root by all their tokens, with held (those that other roots among these nodes have) and odd (a sketch of them)."""
    spots = _packs(docs, nodes, lambda own: own, 1).applyInArrow(_spots, "node long, spots binary").groupBy("node").agg(F.collect_list("spots").alias("spots"))
    return written(nodes.drop("alone").join(spots.mapInArrow(_sketched, "node long, held int, odd array<long>"), "node").where(f"100 * held >= {PERCENT} * n"))


def _rarest(shared: DataFrame, spare: DataFrame) -> DataFrame:
    """Entries (sign, node, times) without the most frequent signatures of each kind that a node (spare) doesn't need; nodes of equal signatures order them alike."""
    kind = F.pmod("sign", F.lit(KINDS)).cast("int")
    rank = F.row_number().over(Window.partitionBy("node", "kind").orderBy(F.desc("times"), F.desc("sign")))
    ranked = shared.join(spare, "node").withColumn("kind", kind).withColumn("rank", rank)
    return ranked.where(F.col("rank") > F.element_at("spare", F.col("kind") + 1)).drop("spare", "kind", "rank", "times")


def near_copies(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, key long, text; others are ignored): doc_id, key and root, the same for all that links reach.

    Rows of one key must have one text. Texts without words, null ones among them, are copies of each other.
    Repeated rows and null ids stay; an empty table gives none. A very long text is one set of 8 bytes a word.
    docs is read several times and must give the same texts each time; the tables between stay in the shared folder until delete_written().
    """
    shared_folder(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("key").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    marks = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", "text", F.xxhash64("text").alias("hash")).mapInArrow(_marked, MARKS))
    firsts = marks.where("n > 0").groupBy("high", "low").agg(F.min(F.struct("row", "hash", "n", "fp", "least", "second")).alias("r"), F.count("*").alias("times"))
    nodes = written(firsts.select("high", "low", "times", F.col("r.row").alias("node"), *(f"r.{c}" for c in ("hash", "n", "fp", "least", "second"))))

    def rooted(stars: DataFrame) -> DataFrame:
        roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))

    found = _grouped(docs, nodes.withColumn("root", F.col("node")), nodes.select("node", F.col("least").alias("group")))
    alike = components(by_fingerprint(nodes.select("node", "fp"))).select(F.col("u").alias("node"), F.col("v").alias("group"))
    alike = alike.unionByName(alike.select(F.col("group").alias("node"), "group").distinct()).select("node", F.xxhash64("group", F.lit(1)).alias("group"))
    again = _grouped(docs, rooted(components(found)), nodes.select("node", F.xxhash64("second", F.lit(2)).alias("group")).unionByName(alike))
    found = written(found.unionByName(again))
    stars = components(found)
    left = _open_nodes(docs, rooted(stars).withColumn("alone", F.lit(0).cast("long")), _some, 1 / SHARE)
    left = _open_nodes(docs, left, _others, 1 - 1 / SHARE)
    left = _sketches(docs, left)
    shared = written(_packs(docs, left, signatures, 1).applyInArrow(_of_several, "sign long, node long, times long"))
    known = written(left.join(shared.select("node").distinct(), "node", "left_semi"))
    chunks = known.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / jaccard.MEMBERS, F.sum(F.col("n").cast("long")) / jaccard.TOKENS)).alias("chunks"))
    known = written(known.join(chunks, "root").withColumn("group", F.xxhash64("root", F.pmod(F.xxhash64("node"), "chunks"))).drop("chunks"))
    sets = written(_texts(docs, known, "group").select("node", "group", "high", "low", "text").mapInArrow(_sets, "node long, group long, own array<long>, spare array<long>"))
    shared = written(_rarest(shared, sets.select("node", "spare")).join(known.select("node", "n"), "node"))
    linked = jaccard.between(shared, known.select("node", "group", "held", "odd"), sets, found, stars, PERCENT, SKETCH, apart=True)
    roots = components(linked).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted_sets = jaccard.rooted_sets(marks, roots)
    return marks.select("doc_id", "key", "high", "low").join(rooted_sets.select("high", "low", "root"), ["high", "low"]).select("doc_id", "key", "root")

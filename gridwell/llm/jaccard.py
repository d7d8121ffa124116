"""N-gram Jaccard join by a token-group matrix: texts whose sets of word n-grams are similar enough are linked, and no link is lost.

Texts with equal sets are one node. Which nodes can be similar at all is found by exact signatures: for sizes within a band, a
set's tokens are dealt by hash to one part more than similar sets can differ in, so that two such sets have some part in
common; a signature is the content of one part. Parts hold about nine tokens, so what a frequent
line or passage puts into them differs with the rest of each text. A part that is empty says nothing: sets that have too many of
these are dealt again by another hash.

Nodes that share signatures are partitioned into groups: by the least token of their sets (which similar sets share as often as
they are similar), and at most about 64 in one group. A group's row of the matrix is the union of its
members' tokens. Tokens that no other group has count for nothing between groups, so a node with many of these has no match outside its
own. All others meet, as queries, the groups of nodes that share a signature with them and whose sizes and sketches (which tokens are in an odd
number, by remainder) aren't further apart than similar sets can be; no member can have more in common with a query than the
union has, so a group is opened, and its members are compared, only if that overlap is large enough. Nodes of a
group are held against each other first, then all nodes of a signature against the group of one of them, and what links these already needs no
further comparison, so a large class of near copies costs about a comparison a node. Groups with many queries are dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import kept, mix, read, shared_folder, slices, written
from .components import components

WORDS, PERCENT = 3, 90
#: Hashes by which a set's tokens are dealt anew while too many parts are empty; with the last one empty parts count as well.
DEALS = 3
#: Members of a group and tokens of them, about; a set with more is a group of its own.
MEMBERS, TOKENS = 64, 1 << 20
#: Queries that are held against a copy of a group.
QUERIES = 4096

#: Bits of a sketch, one for each remainder of the tokens: whether an odd number of tokens have it.
BITS = 512

#: Rows of 8 bytes up to which a list of keys is broadcast; a longer one is joined by shuffles.
BROADCAST_KEYS = 1_000_000

MARKS = "row long, doc_id long, key long, hash long, high long, low long, n int, least long, odd array<long>, signatures array<long>"
LINKS = "u long, v long"


def _bands(percent: int) -> np.ndarray:
    """The least size of each band; a set is similar to sets of its own band, the next and the one before at most."""

    def made() -> np.ndarray:
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(100 * edges[-1] // percent + 1)
        return np.array(edges, np.int64)

    return kept(("bands of sizes", percent), made)


def _parts(scheme: int, percent: int) -> tuple[int, int]:
    """For pairs whose smaller set is in this band: how many tokens they can differ in, and into how many parts tokens are dealt."""
    differ = (int(_bands(percent)[scheme + 1]) - 1) * (100 - percent) // percent
    return differ, differ + 1 + differ // 200


def signatures(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of which two different sets (sorted distinct tokens) have at least one in common if they are similar enough."""
    found = []
    tokens = own.view(np.uint64)
    band = int(np.searchsorted(_bands(percent), len(own), side="right")) - 1
    values = mix(tokens + np.uint64(0x5851F42D4C957F2D))
    for scheme in range(max(band - 1, 0), band + 1):
        differ, n = _parts(scheme, percent)
        if not differ:
            continue  # only equal sets are similar
        for deal in range(DEALS):
            part = (mix(tokens ^ np.uint64((deal + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(n)).astype(np.int64)
            sizes = np.bincount(part, minlength=n)
            ends = np.cumsum(sizes)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[np.argsort(part, kind="stable")])])
            content = mix(sums[ends] - sums[ends - sizes]) + np.arange(n, dtype=np.uint64) + np.uint64((scheme << 8 | deal) << 40)
            empty = n - int(np.count_nonzero(sizes))
            last = deal == DEALS - 1
            found.append(mix(content if last else content[sizes > 0]))
            if empty < n - differ:
                if last:
                    found[-1] = mix(content[sizes > 0])
                break
    return np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)


def odd(own: np.ndarray) -> np.ndarray:
    """The sketch of a set: two sets differ in at least as many tokens as their sketches in bits."""
    return np.packbits(np.bincount(own & (BITS - 1), minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def similar(common: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes with so many common tokens are similar enough to one of n."""
    return 100 * common >= percent * (n + sizes - common)


class Group:
    """The members of a group and its row of the matrix."""

    def __init__(self, members: list[tuple[int, np.ndarray]]) -> None:
        self.held = [own for _, own in members]
        self.nodes = np.array([node for node, _ in members], np.int64)
        self.sizes = np.array([len(own) for _, own in members], np.int64)
        tokens = np.concatenate([own for _, own in members])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.member = tokens[order], np.repeat(np.arange(len(members)), self.sizes)[order]
        self.union = np.unique(tokens)

    def roots(self, percent: int) -> np.ndarray:
        """For each member the first of those that links within the group reach."""
        root = np.arange(len(self.nodes))
        for i in range(len(root)):
            met = root[self.matches(self.held[i], percent)]  # the member itself among them
            root[np.isin(root, met)] = met.min()
        return self.nodes[root]

    def matches(self, own: np.ndarray, percent: int) -> np.ndarray:
        """Which members are similar enough to own; if the union hasn't enough of own's tokens, no member is looked at."""
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        held = own[self.union[at] == own]
        if 100 * len(held) < percent * len(own):
            return np.zeros(0, np.int64)
        first, last = (np.searchsorted(self.tokens, held, side=s) for s in ("left", "right"))
        n = last - first
        places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        common = np.bincount(self.member[places], minlength=len(self.nodes))
        return np.flatnonzero(similar(common, len(own), self.sizes, percent))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, a text without words has none."""
    return set_of(simhash.hashed(text, words))


def set_of(digests: bytes) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(np.frombuffer(digests, ">i8").astype(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _checked(keys: DataFrame) -> DataFrame:
    """keys (one long column), to be broadcast if a count says that there are few."""
    keys = written(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _marks(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes = [simhash.hashed(t or b"", words) for t in part.column("text").cast(pa.binary()).to_pylist()]
            own = list(map(set_of, hashes))
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(o.tobytes()) for o in own), ">i8").astype(np.int64)
            least = pa.array([int(o[0]) if len(o) else None for o in own], pa.int64())
            sketches = _lists([odd(o) for o in own])
            signs = _lists([signatures(o, percent) if len(o) else o for o in own])
            given = [part.column(c) for c in ("row", "doc_id", "key", "hash")]
            columns = [*given, pa.array(digests[0::2]), pa.array(digests[1::2]), pa.array(map(len, own), pa.int32()), least, sketches, signs]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "key", "hash", "high", "low", "n", "least", "odd", "signatures"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [shingles(t or b"", words) for t in part.column("text").cast(pa.binary()).to_pylist()]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(o.tobytes()) for o in own), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(digests[0::2]), pa.array(digests[1::2]), _lists(own)], names=["high", "low", "own"])

    return run


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, int, np.ndarray]]:
    """Rows (group, salt, kind, node, own)."""
    for batch in batches:
        values = batch.column("own")
        ends, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False)
        group, salt, kind, node = (batch.column(c).to_pylist() for c in ("group", "salt", "kind", "node"))
        for i in range(batch.num_rows):
            yield (group[i], salt[i]), kind[i], node[i], flat[ends[i] : ends[i + 1]]


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _inside(percent: int):
    """Each member of a group with the first of those that links within the group reach, if it is another; rows are sorted by group and node."""

    def linked(members: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        if len(members) < 2:
            return []
        own = Group(members)
        return [(int(u), int(v)) for u, v in zip(own.nodes, own.roots(percent), strict=True) if u != v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for group, _, node, own in _arrays(batches):
            if group != key:
                if found := linked(members):
                    yield _pairs(found)
                key, members = group, []
            members.append((node, own.copy()))
        if found := linked(members):
            yield _pairs(found)

    return run


def _opened(percent: int):
    """Queries (kind 1) with the roots of the members (kind 0) of their group that they are similar to; rows are sorted by group, salt, kind and node, and one group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, own, roots, found = None, [], None, None, []
        for group, kind, node, tokens in _arrays(batches):
            if group != key:
                key, members, own = group, [], None
            if kind == 0:
                members.append((node, tokens.copy()))
                continue
            if own is None and members:
                own = Group(members)
                roots = own.roots(percent)
            if own is not None:
                found += [(node, int(v)) for v in np.unique(roots[own.matches(tokens, percent)])]
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    return run


def _open(queries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Queries (node, group) as u with v, the roots within the group of the members that they are similar to."""
    queries = written(queries)
    copies = written(queries.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).alias("copies")))
    asked = queries.join(copies, "group").join(sets.select("node", "own"), "node").select("group", F.pmod(F.xxhash64("node"), "copies").alias("salt"), F.lit(1).alias("kind"), "node", "own")
    held = sets.join(copies, "group").select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), "node", "own")
    return asked.unionByName(held).repartition("group", "salt").sortWithinPartitions("group", "salt", "kind", "node").mapInArrow(_opened(percent), LINKS)


def _near(other: str, percent: int, bits: int = BITS, apart: bool = False) -> str:
    """Whether a node (n tokens, held of them in several groups, a sketch) can be similar to another of another group, by columns with this prefix.

    apart: the sketches are of held tokens alone, so the other tokens of both, which they can't have in common, are counted beside them.
    """
    sizes = f"100 * {other}n >= {percent} * n AND {percent} * {other}n <= 100 * n AND {100 + percent} * least(held, {other}held) >= {percent} * (n + {other}n)"
    differ = " + ".join(f"bit_count(odd[{k}] ^ {other}odd[{k}])" for k in range(bits // 64))
    if apart:
        differ = f"n - held + {other}n - {other}held + {differ}"
    return f"{sizes} AND {100 + percent} * ({differ}) <= {100 - percent} * (n + {other}n)"


def links(marks: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (u, v) of nodes (row of the first text with a set) that connect exactly the nodes that similar sets connect; marks is a written table of docs."""
    alike = marks.where("n > 0").groupBy("high", "low").agg(F.min("row").alias("node"), F.count("*").alias("times")).where("times > 1")
    again = _checked(marks.select("row", "high", "low").join(alike, ["high", "low"]).where("row != node").select("row"))
    nodes = marks.where("n > 0").join(again, "row", "left_anti").withColumnRenamed("row", "node").drop("doc_id", "key")
    entries = nodes.select("node", "n", F.explode("signatures").alias("sign"))
    often = entries.groupBy("sign").agg(F.count("*").alias("times")).where("times > 1").select("sign")
    shared = written(entries.join(often, "sign"))
    known = written(nodes.drop("signatures").join(shared.select("node").distinct(), "node", "left_semi"))
    chunks = known.groupBy("least").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum(F.col("n").cast("long")) / TOKENS)).alias("chunks"))
    known = written(known.join(chunks, "least").withColumn("group", F.xxhash64("least", F.pmod(F.xxhash64("node"), "chunks"))).drop("chunks", "least"))
    wanted = _checked(known.select("hash").distinct())
    texts = docs.select("text", F.xxhash64("text").alias("hash")).join(wanted, "hash", "left_semi").dropDuplicates(["hash", "text"]).select("text")
    sets = texts.mapInArrow(_sets(words), "high long, low long, own array<long>").join(known.select("high", "low", "node", "group"), ["high", "low"])
    sets = written(sets.select("node", "group", "own"))

    # tokens that a single group has can't be in common with another group's members
    tokens = sets.select("node", "group", F.explode("own").alias("token"))
    several = tokens.groupBy("token").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a != b").select("token")
    held = tokens.join(several, "token").groupBy("node").agg(F.count("*").alias("held"))
    outside = written(known.select("node", "group", "n", "odd").join(held, "node").where(f"100 * held >= {percent} * n").select("node", "group", "held", "odd"))

    inside = sets.withColumns({"salt": F.lit(0), "kind": F.lit(0)}).repartition("group").sortWithinPartitions("group", "node")
    inside = written(inside.mapInArrow(_inside(percent), LINKS))
    return between(shared, outside, sets, inside, inside, percent)


def between(shared: DataFrame, outside: DataFrame, sets: DataFrame, before: DataFrame, stars: DataFrame, percent: int, bits: int = BITS, apart: bool = False) -> DataFrame:
    """Pairs (u, v) that connect, with those of before, which are among them, all nodes of different groups that similar sets connect.

    shared (sign, node, n) has the signatures of nodes, outside (node, group, held, odd) those that can have a match in another group, sets (node,
    group, own) their sets. bits and apart tell the sketches, see _near(). stars: each node that isn't the first of its component as u, that first one as v. All are written tables.
    """

    def rooted(roots: DataFrame) -> DataFrame:
        """Entries with the root of their node, of signatures that several roots have; roots has nodes whose root is another."""
        own = outside.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        every = written(shared.join(own, "node"))
        met = every.groupBy("sign").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min(F.struct("n", "node", "root", "group", "held", "odd")).alias("lead")).where("a != b")
        return every.join(met.select("sign", "lead"), "sign")

    first = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    led = rooted(first).where("root != lead.root AND group != lead.group").where(_near("lead.", percent, bits, apart)).select("node", F.col("lead.group").alias("group")).distinct()
    led = written(_open(led, sets, percent))
    joined = written(before.unionByName(led))
    second = components(joined).select(F.col("u").alias("node"), F.col("v").alias("root"))
    left = written(rooted(second).drop("lead"))
    names = {c: f"other_{c}" for c in ("node", "n", "group", "root", "held", "odd")}
    rest = left.join(left.withColumnsRenamed(names), "sign").where("group < other_group AND root != other_root").where(_near("other_", percent, bits, apart))
    return joined.unionByName(_open(rest.select("node", F.col("other_group").alias("group")).distinct(), sets, percent))


def marked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A written table of docs (doc_id long, text string and perhaps key long) with what links() takes: a number for each row, its set's digest and size, and signatures."""
    key = F.col("key") if "key" in docs.columns else F.lit(None).cast("long")
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", key.alias("key"), "text", F.xxhash64("text").alias("hash"))
    return written(keyed.mapInArrow(_marks(words, percent), MARKS))


def rooted_sets(marks: DataFrame, roots: DataFrame) -> DataFrame:
    """For each set (high, low) of marks: its node, the smallest doc_id that has it (first), and its root by roots (node, root)."""
    first = marks.groupBy("high", "low").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"))
    return first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def similar_texts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs (doc_id, text; others are ignored): doc_id, n (distinct n-grams of lower-cased words) and component_id.

    Two rows are linked where 100 * common >= percent * all of their n-grams; component_id is the smallest doc_id that links reach, itself included. A text with fewer
    words is one n-gram. Texts without words, null ones among them, have n = 0 and are linked with nothing, so they keep their own doc_id. A null id is
    nobody's component unless a component has no other. Repeated rows stay; an empty table gives none. A very long text is one set of
    8 bytes a word. docs is read twice and must give the same texts both times.
    """
    if not 0 < percent <= 100:
        raise ValueError("a per cent from 1 to 100")
    shared_folder(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = marked(docs, words, percent)
    roots = components(links(marks, docs, words, percent)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = written(rooted_sets(marks.where("n > 0"), roots))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("high", "low", "component_id")
    alone = marks.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n"), F.col("doc_id").alias("component_id"))
    return marks.where("n > 0").join(named, ["high", "low"]).select("doc_id", F.col("n").cast("long").alias("n"), "component_id").unionByName(alone)


def op11_jaccard(spark, sf_dir: str) -> DataFrame:
    """Sizes and components of all documents at a Jaccard similarity of 0.9 of three-word shingles."""
    return similar_texts(read(spark, sf_dir, "documents")).withColumnRenamed("n", "n_shingles")

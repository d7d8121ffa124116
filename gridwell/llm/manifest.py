"""A Merkle manifest of a dataset: leaves by source, a root, and for each row a proof that leads from its leaf to the root.

Rows are sorted by range of (source, key) and numbered without one task seeing them all. Every 4,096 neighbouring
leaves of a source are an aligned block, and a block is a task's unit. A treehash stack takes a block's leaves one by one
and gives its root. The nodes above blocks are few; they are joined level by level, sources' roots last,
and each block gets the path from its root to the manifest's, which all its leaves share. Then the
proofs are made by traversal: for each level a block holds the present run of siblings, and a treehash stack that reads one run ahead
builds the next, one leaf a step, so that the path moves from leaf to leaf with memory that grows with
the number of levels. What a proof has above its block is appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, read, shared_folder, written

ARITY, BITS = 16, 4
#: Levels of a block, so of 16**3 leaves.
BLOCK_LEVELS = 3
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a batch that tasks give back.
BATCH = 4096

RESULT = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(n: int) -> int:
    """How often n nodes are joined by 16 until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def leaf_of(*values: Column) -> Column:
    """The digest of values, each with its number of bytes before it, so that no two rows are taken for each other; a null is "-"."""
    own = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in own]), 256)


class Treehash:
    """Takes leaves in order and gives the digest of every 16**height of them; it holds 15 nodes a level at most."""

    def __init__(self, height: int) -> None:
        self.rows: list[list[str]] = [[] for _ in range(height)]

    def take(self, node: str) -> str | None:
        for row in self.rows:
            row.append(node)
            if len(row) < ARITY:
                return None
            node = digest("".join(row))
            row.clear()
        return node

    def rest(self) -> str | None:
        """The digest of what was taken since the last one, if anything; runs are shorter then."""
        node = None
        for row in self.rows:
            if node is not None:
                row.append(node)
            node = digest("".join(row)) if row else None
            row.clear()
        return node


class Paths:
    """The siblings of each leaf of a block, level by level, as what stands left and right of the leaf's own node; leaves are taken in order."""

    def __init__(self, leaves: list[str], height: int) -> None:
        self.leaves, self.height, self.at = leaves, height, 0
        self.spans = [ARITY ** (h + 1) for h in range(height)]
        self.stacks = [Treehash(h) for h in range(height)]
        self.ahead: list[list[str]] = [[] for _ in range(height)]
        for h, span in enumerate(self.spans):
            for i in range(min(span, len(leaves))):
                self._feed(h, i)
        self.runs, self.ahead = self.ahead, [[] for _ in range(height)]
        self.sides = [self._side(h) for h in range(height)]

    def _feed(self, h: int, i: int) -> None:
        node = self.stacks[h].take(self.leaves[i])
        if node is None and i == len(self.leaves) - 1:
            node = self.stacks[h].rest()
        if node is not None:
            self.ahead[h].append(node)

    def _side(self, h: int) -> tuple[str, str]:
        place = self.at // ARITY**h % ARITY
        return "".join(self.runs[h][:place]), "".join(self.runs[h][place + 1 :])

    def step(self) -> None:
        """On to the next leaf."""
        for h, span in enumerate(self.spans):
            if self.at + span < len(self.leaves):
                self._feed(h, self.at + span)
        self.at += 1
        for h, span in enumerate(self.spans):
            if self.at % (span // ARITY):
                break
            if self.at % span == 0:
                self.runs[h], self.ahead[h] = self.ahead[h], []
            if self.at < len(self.leaves):
                self.sides[h] = self._side(h)


def folded(node: str, sides: list[tuple[str, str]]) -> str:
    """The root that node and its siblings lead to."""
    for left, right in sides:
        node = digest(left + node + right)
    return node


def ranked(table: DataFrame, by: str | None, order: list[Column]) -> DataFrame:
    """table with _rank from 0 in this order within each value of by (a column that order begins with), and _n, how many rows the value has.

    Rows are sorted by range and written once; parts' counts are added to places within parts. Equal rows are numbered in any order.
    """
    tie = F.monotonically_increasing_id()  # so that equal rows may lie in several parts
    own = table.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    own = written(own.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    group = F.col(by) if by else F.lit(0)
    parts = own.groupBy("_part", group.alias("_group")).agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))  # a row for each part and value in it
    values = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_size").over(values.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", "_group", (before - F.col("_first")).alias("_move"), F.sum("_size").over(values).alias("_n"))
    met = own.withColumn("_own", group).join(parts.withColumnRenamed("_part", "_p"), (F.col("_part") == F.col("_p")) & F.col("_own").eqNullSafe(F.col("_group")))
    return met.withColumn("_rank", F.col("_at") + F.col("_move")).drop("_part", "_p", "_own", "_group", "_at", "_move")


def upper_paths(nodes: DataFrame) -> DataFrame:
    """nodes (g, i, m, node: of each g the numbers i from 0 to m - 1) to (g, i, root, lefts, rights): the siblings on the way to g's root."""
    last = nodes.agg(F.max("m")).first()[0] or 1
    level, runs, ends = nodes, [], []
    for _ in range(levels_of(last)):
        ends.append(level.where("m = 1"))
        joined = level.where("m > 1").groupBy("g", F.shiftright("i", BITS).alias("i")).agg(F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("i", "node"))).alias("run"))  # 16 nodes at most
        runs.append(written(joined.select("g", "i", F.ceil(F.col("m") / ARITY).alias("m"), F.col("run.node").alias("run"))))
        level = runs[-1].select("g", "i", "m", F.sha2(F.array_join("run", ""), 256).alias("node"))

    def tops(ended: DataFrame) -> DataFrame:
        none = F.array().cast("array<string>")
        return ended.select("g", "i", F.col("node").alias("root"), none.alias("lefts"), none.alias("rights"))

    paths = tops(level)
    for run, ended in zip(reversed(runs), reversed(ends), strict=True):
        each = run.drop("m").join(paths, ["g", "i"]).select("g", "i", "run", "root", "lefts", "rights", F.posexplode("run").alias("p", "_"))
        left, right = F.array_join(F.slice("run", F.lit(1), F.col("p")), ""), F.array_join(F.slice("run", F.col("p") + 2, F.lit(ARITY)), "")
        below = each.select("g", (F.col("i") * ARITY + F.col("p")).alias("i"), "root", F.concat(F.array(left), "lefts").alias("lefts"), F.concat(F.array(right), "rights").alias("rights"))
        paths = below.unionByName(tops(ended))
    return paths


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block, in order; the first is the block's path where it has kind 0. Blocks have 4,096 leaves at most."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (own := (row["g"], row["block"])) != key:
                if rows:
                    yield rows
                key, rows = own, []
            rows.append(row)
    if rows:
        yield rows


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _blocks(batches):
        stack, root = Treehash(min(BLOCK_LEVELS, levels_of(rows[0]["n"]))), None
        for row in rows:
            root = stack.take(row["leaf"])
        root = root or stack.rest()
        yield pa.RecordBatch.from_pylist([{"g": rows[0]["g"], "i": rows[0]["block"], "m": -(-rows[0]["n"] // ARITY**BLOCK_LEVELS), "node": root}])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for path, *rows in _blocks(batches):
        upper = list(zip(path["lefts"], path["rights"], strict=True))
        above = "".join(a + b for a, b in upper).encode()
        paths = Paths([r["leaf"] for r in rows], min(BLOCK_LEVELS, levels_of(path["n"])))
        for row in rows:
            proof = hashlib.sha256("".join(a + b for a, b in paths.sides).encode())
            proof.update(above)
            root = folded(row["seen"] or row["leaf"], paths.sides + upper)
            out.append((row["doc_id"], row["source"], row["leaf"], path["subroot"], path["root"], proof.hexdigest(), root, root == path["root"]))
            paths.step()
        if len(out) >= BATCH:
            yield flushed()
            out.clear()
    if out:
        yield flushed()


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves (doc_id, source, leaf, seen; others are ignored) to doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    seen is the digest of the row as it is found now, null where it is the leaf; folded_root is the root that it and the leaf's siblings lead to, and
    verified tells whether that is the manifest's. Null sources are a source of their own, before all others; null ids stand before others; repeated
    rows are leaves of their own, equal ones in any order. A single leaf is its own root and has no siblings; an empty table gives none. Texts stay
    where they are read: only digests are shuffled. Nothing that grows with the table is broadcast, and a source's leaves are dealt by blocks.
    """
    shared_folder(leaves.sparkSession)
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()]
    rows = ranked(leaves.select(F.col("doc_id").cast("long"), "source", "leaf", "seen"), "source", order)
    names = rows.where("_rank = 0").select("source", F.col("_n").alias("n"))
    sources = ranked(names, None, [F.col("source").asc_nulls_first()]).select(F.col("source").alias("name"), F.col("_rank").alias("g"), F.col("_n").alias("sources"))
    placed = rows.join(written(sources), F.col("source").eqNullSafe(F.col("name"))).drop("name")  # Spark broadcasts names while they are few
    placed = written(placed.select("doc_id", "source", "leaf", "seen", "g", "sources", F.col("_n").alias("n"), F.shiftright("_rank", BITS * BLOCK_LEVELS).alias("block"), F.col("_rank").alias("at")))
    dealt = placed.select("g", "block", "at", "n", "leaf").repartition("g", "block").sortWithinPartitions("g", "block", "at")
    blocks = written(dealt.mapInArrow(_roots, "g long, i long, m long, node string"))
    inner = written(upper_paths(blocks))
    subroots = inner.where("i = 0").select("g", F.col("root").alias("subroot"))
    of = placed.where("at = 0").select("g", "sources", "n").join(subroots, "g")
    outer = upper_paths(written(of.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.col("sources").alias("m"), F.col("subroot").alias("node"))))
    outer = outer.select(F.col("i").alias("g"), "root", F.col("lefts").alias("outer_lefts"), F.col("rights").alias("outer_rights")).join(of.select("g", "n"), "g")
    path = inner.withColumnsRenamed({"root": "subroot", "i": "block"}).join(outer, "g")
    path = path.select("g", "block", F.lit(-1).cast("long").alias("at"), "n", "subroot", "root", F.concat("lefts", "outer_lefts").alias("lefts"), F.concat("rights", "outer_rights").alias("rights"))
    both = placed.drop("sources").unionByName(path, allowMissingColumns=True)
    return both.repartition("g", "block").sortWithinPartitions("g", "block", "at").mapInArrow(_proofs, RESULT)


def op13_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents; rows whose id 5 divides (by crc32) are held against it with their texts in lower case."""
    docs = read(spark, sf_dir, "documents")
    lower = F.translate("text", A_TO_Z, A_TO_Z.lower())
    fields = {c: F.col(c) for c in FIELDS}
    seen = F.when(crc_mod("doc_id", 5) == 0, leaf_of(*(fields | {"text": lower}).values()))
    return manifest(docs.select("doc_id", "source", leaf_of(*fields.values()).alias("leaf"), seen.alias("seen"))).drop("source")


_LEAF = "sha256(concat({}))".format(", ".join(f"coalesce(concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}), '-')" for c in FIELDS))
_SEEN = _LEAF.replace("CAST(text AS VARCHAR)", "low").replace("':', text)", "':', low)")
#: crc32, a bit at a time: k counts the bits of the id's digits, and every eighth begins with the next digit.
_STEP = "CASE WHEN k % 8 = 0 THEN xor(c, ord(digits[k // 8 + 1])) ELSE c END"
_CRC = f"xor(list_reduce(range(8 * length(digits)), lambda c, k: xor(({_STEP}) >> 1, 3988292384 * (({_STEP}) & 1)), 4294967295), 4294967295)"


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels, and each node's siblings left and right of it."""
    run = "PARTITION BY g, lv, i // 16 ORDER BY i ROWS BETWEEN"
    return f"""
    {name} AS (SELECT g, CAST(0 AS BIGINT) AS lv, i, m, node FROM {leaves}
        UNION ALL SELECT g, lv + 1, i // 16, (m + 15) // 16, sha256(string_agg(node, '' ORDER BY i)) FROM {name} WHERE m > 1 GROUP BY g, lv, i // 16, m),
    {name}_sides AS (SELECT g, lv, i, coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE m > 1)"""


ORACLES = {
    "op13_manifest": f"""WITH RECURSIVE
    base AS (SELECT *, CAST(doc_id AS VARCHAR) AS digits, translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}') AS low FROM documents),
    d AS (SELECT doc_id, source, {_LEAF} AS leaf, CASE WHEN doc_id IS NOT NULL AND ({_CRC}) % 5 = 0 THEN {_SEEN} ELSE {_LEAF} END AS seen FROM base),
    rows_of AS (SELECT *, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
        count(*) OVER (PARTITION BY source) AS m, leaf AS node FROM d),
    {_tree("low_tree", "rows_of")},
    tops AS (SELECT CAST(0 AS BIGINT) AS g, g AS i, count(*) OVER () AS m, node FROM low_tree WHERE m = 1),
    {_tree("high_tree", "tops")},
    steps AS (SELECT rid, s.lv, l, r FROM rows_of JOIN low_tree_sides s ON s.g = rows_of.g AND s.i = rows_of.i >> CAST(4 * s.lv AS INTEGER)
        UNION ALL SELECT rid, 100 + s.lv, l, r FROM rows_of JOIN high_tree_sides s ON s.i = rows_of.g >> CAST(4 * s.lv AS INTEGER)),
    path AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY lv) AS k FROM steps),
    fold AS (SELECT rid, CAST(0 AS BIGINT) AS k, seen AS node FROM rows_of UNION ALL SELECT f.rid, f.k + 1, sha256(concat(l, node, r)) FROM fold f JOIN path p ON p.rid = f.rid AND p.k = f.k + 1),
    proofs AS (SELECT rid, sha256(string_agg(concat(l, r), '' ORDER BY k)) AS proof_sha256 FROM path GROUP BY rid)
    SELECT doc_id, leaf, (SELECT t.node FROM tops t WHERE t.i = rows_of.g) AS subroot, (SELECT node FROM high_tree WHERE m = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
        e.node AS folded_root, e.node = (SELECT node FROM high_tree WHERE m = 1) AS verified
    FROM rows_of JOIN (SELECT rid, max_by(node, k) AS node FROM fold GROUP BY rid) e USING (rid) LEFT JOIN proofs USING (rid)""",
}

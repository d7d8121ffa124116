"""Exact top-k search by inner product with a bit-sliced index.

Vectors are quantised to whole numbers. The index keeps, for a block of rows and each dimension, one
bitmap over the rows for each bit. A query's score is a weighted sum of dimensions: for each bit of the
weights the slices of the dimensions that have it are added by carry-save bitmap arithmetic, and
these sums are added with their shifts. A negative weight adds the complement of its slices. The
sums are again bit slices, from which the best rows are chosen from the most significant slice
downward; rows that tie at the boundary are resolved by the smallest id, and scores are read off exactly.

A task holds a shard of the index, some blocks of rows, and the queries pass by: what a shard finds for
a query is merged there, so only its best rows are sent on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read

#: Rows of an index block, blocks of a shard, and queries that are sent together.
BLOCK_ROWS, SHARD_BLOCKS, BLOCK_QUERIES = 32_768, 16, 64
#: Tasks at least; where there are fewer shards, the queries are dealt to copies of them.
LEAST_TASKS = 32
TOP = 5
SCALE = 256
#: Quantised components stay within this, and scores within a long: what lies beyond counts as the limit.
LARGEST, LONG = 1 << 62, (1 << 63) - 1

SENT = "task int, kind byte, part int, data binary"
FOUND = "query_id long, times long, part int, place int, vec_id long, score long"
INDEX, QUERIES = 0, 1


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x, as double; null where the vector or a component is null or not finite."""
    valid = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * F.lit(float(scale))), F.lit(LARGEST)), F.lit(-LARGEST)))
    return F.when(valid, whole)


class Slices:
    """The bit slices of a block's rows, in the order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows = len(ids)
        self.low = values.min(axis=0) if self.rows else np.zeros(values.shape[1], np.int64)
        above = values - self.low
        self.bits = [int(m).bit_length() for m in (above.max(axis=0) if self.rows else self.low)]
        words = -(-max(self.rows, 1) // 64)
        pad = np.zeros((words * 64, values.shape[1]), np.int64)
        pad[: self.rows] = above
        self.slices = [np.stack([self.bitmap(pad[:, d] >> b & 1) for b in range(n)]) if n else np.zeros((0, words), np.uint64) for d, n in enumerate(self.bits)]
        self.all = self.bitmap(np.arange(words * 64) < self.rows)

    @staticmethod
    def bitmap(flags: np.ndarray) -> np.ndarray:
        return np.packbits(flags.astype(bool), bitorder="little").view("<u8")

    def scores(self, weights: np.ndarray) -> tuple[np.ndarray, int]:
        """Bit slices (least significant first) of the rows' scores less a constant, and that constant."""
        weights = np.concatenate([weights, np.zeros(len(self.bits), np.int64)])[: len(self.bits)]
        constant = sum(int(w) * int(low) for w, low in zip(weights, self.low, strict=True))  # exact, however large
        size = [abs(int(w)) for w in weights]
        parts = [~s if w < 0 else s for s, w in zip(self.slices, weights, strict=True)]
        constant -= sum(a * ((1 << n) - 1) for a, n, w in zip(size, self.bits, weights, strict=True) if w < 0)
        words = len(self.all)
        width = max(1, sum(a * ((1 << n) - 1) for a, n in zip(size, self.bits, strict=True)).bit_length())
        total = np.zeros((width, words), np.uint64)
        for j in reversed(range(max(size, default=0).bit_length())):
            total[1:] = total[:-1].copy()
            total[0] = 0
            chosen = [p for p, a in zip(parts, size, strict=True) if a >> j & 1 and len(p)]
            if chosen:
                self.add(total, self.sum(chosen))
        return total, constant

    @staticmethod
    def sum(parts: list[np.ndarray]) -> np.ndarray:
        """Bit slices of the sum of numbers in bit slices, by carry-save steps and one carrying addition."""
        height = max(map(len, parts)) + len(parts).bit_length()
        ones, carries, over = (np.zeros((height, parts[0].shape[1]), np.uint64) for _ in range(3))
        for part in parts:
            low = slice(0, len(part))
            np.bitwise_and(ones, carries, out=over)
            np.bitwise_xor(ones, carries, out=ones)
            over[low] |= ones[low] & part
            ones[low] ^= part
            carries[1:] = over[:-1]
            carries[0] = 0
        Slices.add(ones, carries)
        return ones

    @staticmethod
    def add(to: np.ndarray, other: np.ndarray) -> None:
        """to plus other, in bit slices, in place; to is wide enough for the sum."""
        carry = np.zeros(to.shape[1], np.uint64)
        for i in range(len(to)):
            more = other[i] if i < len(other) else np.uint64(0)
            half = to[i] ^ more
            carry, to[i] = (to[i] & more) | (half & carry), half ^ carry

    def best(self, total: np.ndarray, k: int, without: int) -> np.ndarray:
        """Places of the k rows with the largest totals but those with the id without, ties to smaller ids."""
        own = slice(*np.searchsorted(self.ids, [without, without + 1]))
        rest = self.all.copy()
        for place in range(own.start, own.stop):
            rest[place >> 6] &= ~(np.uint64(1) << np.uint64(place & 63))
        sure = np.zeros_like(rest)
        for level in total[::-1]:
            tried = sure | (rest & level)
            n = int(np.bitwise_count(tried).sum())
            if n > k:
                rest &= level
            else:
                sure, rest = tried, rest & ~level
                if n == k:
                    return self.places(sure)
        tied = self.places(rest)[: k - int(np.bitwise_count(sure).sum())]
        return np.concatenate([self.places(sure), tied])

    @staticmethod
    def places(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def search(self, weights: np.ndarray, k: int, without: int) -> list[tuple[int, int]]:
        """Ids and scores of the k best rows but those with the id without, the best first."""
        total, constant = self.scores(weights)
        chosen = self.best(total, k, without)
        bits = (total[:, chosen >> 6] >> (chosen & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
        if len(total) < 62:
            scores = ((bits << np.arange(len(total))[:, None]).sum(axis=0) + constant).tolist() if abs(constant) < LARGEST else [int(x) + constant for x in (bits << np.arange(len(total))[:, None]).sum(axis=0)]
        else:
            scores = [sum(int(b) << i for i, b in enumerate(row)) + constant for row in bits.T]
        return sorted(zip(self.ids[chosen].tolist(), scores, strict=True), key=lambda x: (-x[1], x[0]))

    def pack(self) -> bytes:
        head = np.array([self.rows, len(self.bits), *self.bits], "<i8").tobytes()
        return b"".join([head, self.low.astype("<i8").tobytes(), self.ids.astype("<i8").tobytes(), *(s.tobytes() for s in self.slices)])

    @classmethod
    def unpack(cls, data: bytes) -> Slices:
        self = cls.__new__(cls)
        self.rows, dims = np.frombuffer(data, "<i8", 2).tolist()
        numbers = np.frombuffer(data, "<i8", 2 + 2 * dims + self.rows)
        self.bits, self.low, self.ids = numbers[2 : 2 + dims].tolist(), numbers[2 + dims : 2 + 2 * dims], numbers[2 + 2 * dims :]
        words, at = -(-max(self.rows, 1) // 64), 8 * len(numbers)
        self.slices = []
        for n in self.bits:
            self.slices.append(np.frombuffer(data, "<u8", n * words, at).reshape(n, words))
            at += 8 * n * words
        self.all = cls.bitmap(np.arange(words * 64) < self.rows)
        return self


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    """The column's lists as rows, with zeros after shorter ones."""
    values = table.column(column).to_pylist()
    out = np.zeros((len(values), max(map(len, values), default=0)), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _index(k: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        times = np.minimum(np.asarray(rows.column("times"), np.int64), k)  # of equal rows no more than k can be among the best
        packed = Slices(np.repeat(np.asarray(rows.column("vec_id"), np.int64), times), np.repeat(_matrix(rows, "value"), times, axis=0)).pack()
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["part", "data"])

    return run


def _queries(key: tuple, rows: pa.Table) -> pa.Table:
    weights = _matrix(rows, "value")
    packed = np.concatenate([[weights.shape[1]], np.column_stack([np.asarray(rows.column("vec_id"), np.int64), np.asarray(rows.column("times"), np.int64), weights]).ravel()]).astype("<i8").tobytes()
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["part", "data"])


def _search(k: int):
    """Rows in the order of task and kind: keeps a task's blocks of the index and answers the queries that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks = None, []
        for batch in batches:
            for own, kind, part, data in zip(*(batch.column(c).to_pylist() for c in ("task", "kind", "part", "data")), strict=True):
                if own != task:
                    task, blocks = own, []
                if kind == INDEX:
                    blocks.append(Slices.unpack(data))
                    continue
                numbers, rows = np.frombuffer(data, "<i8"), []
                for place, (query, times, *weights) in enumerate(numbers[1:].reshape(-1, int(numbers[0]) + 2)):
                    found = [x for block in blocks for x in block.search(np.array(weights, np.int64), k, int(query))]
                    rows += [(int(query), int(times), part, place, i, min(max(s, -LONG - 1), LONG)) for i, s in sorted(found, key=lambda x: (-x[1], x[0]))[:k]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["query_id", "times", "part", "place", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The k rows of vectors with the largest inner products for each row of queries: query_id, rank, vec_id, score.

    Both have vec_id and value (array of whole numbers); a row of vectors with the query's own vec_id is no
    candidate. Ties go to the smaller vec_id. Rows with null ids or values take no part; a shorter value has zeros
    behind. Repeated rows of vectors are candidates each; repeated queries are answered each. Sums are exact however
    large; a score beyond a long is given as the largest or smallest long. Blocks of queries are sent to shards of
    the index by number; neither table is gathered anywhere. No queries or no vectors, no rows.
    """
    vectors = vectors.where(F.col("vec_id").isNotNull() & F.col("value").isNotNull()).select(F.col("vec_id").cast("long"), "value")
    queries = queries.where(F.col("vec_id").isNotNull() & F.col("value").isNotNull()).select(F.col("vec_id").cast("long"), "value")
    blocks, parts = (max(1, -(-table.count() // size)) for table, size in ((vectors, BLOCK_ROWS), (queries, BLOCK_QUERIES)))
    per_shard = min(SHARD_BLOCKS, max(1, blocks // LEAST_TASKS))
    shards = -(-blocks // per_shard)
    copies = min(parts, -(-LEAST_TASKS // shards))  # more than one only where the index is small
    parts = max(parts, copies)

    def dealt(table: DataFrame, n: int) -> DataFrame:
        """Each different row once, with how often it is there, by a hash; equal rows meet in the counts, before they are dealt."""
        once = table.groupBy("vec_id", "value").agg(F.count("*").alias("times"))
        return once.withColumn("part", F.pmod(F.xxhash64("vec_id", "value"), F.lit(n)).cast("int")).repartition(n, "part").groupBy("part")

    def sent(packed: DataFrame, kind: int, to: Column) -> DataFrame:
        return packed.select("part", "data", F.explode(to).alias("task")).select(F.col("task").cast("int").alias("task"), F.lit(kind).cast("byte").alias("kind"), "part", "data")

    own = F.floor(F.col("part") / per_shard) * copies
    index = sent(dealt(vectors, blocks).applyInArrow(_index(k), "part int, data binary"), INDEX, F.sequence(own, own + copies - 1))
    asked = sent(dealt(queries, parts).applyInArrow(_queries, "part int, data binary"), QUERIES, F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: i * copies + F.col("part") % copies))
    found = index.unionByName(asked).repartition(shards * copies, "task").sortWithinPartitions("task", "kind").mapInArrow(_search(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "part", "place").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 nearest other vectors of each embedding whose vec_id is divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("value"))
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLES = {
    "op3_topk": """
        WITH x AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS d FROM embeddings WHERE vec_id IS NOT NULL),
        v AS (
            SELECT vec_id, d, CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) AS value FROM x
            WHERE vec_id NOT IN (SELECT vec_id FROM x WHERE x IS NULL OR NOT isfinite(x))
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.value * c.value) AS BIGINT) AS score
            FROM v q JOIN v c ON q.d = c.d AND q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
    """,
}

"""What several operators share: slicing record batches by bytes, hashing words, sampling labels."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; longer single texts are taken alone.
STEP_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose column holds at most step bytes, or one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        at = done = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, done + step, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value; a null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, a newline after each, and where each value starts (one more for the end)."""
    values = [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
    starts = np.zeros(len(values) + 1, np.int64)
    np.cumsum([len(v) + 1 for v in values], out=starts[1:])
    return np.frombuffer(b"\n".join([*values, b""]), np.uint8), starts


def kept(key: tuple, make):
    """What make() gives, made once in this process and for as long as it lives (Spark uses Python workers again)."""
    import sys
    import types

    store = sys.modules.setdefault("_kept_by_workers", types.ModuleType("_kept_by_workers")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (multiply and shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, kept between calls."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, STEP_BYTES + 4096)
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (BASE, BASE_INVERSE))
        return self.up[:n], self.down[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes wherever they stand."""
    up, down = powers.upto(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: ASCII white space, as bytes.split() takes it.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space; data ends with white space."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    return edge[0::2], edge[1::2]


def crc_mod(column: str, n: int) -> Column:
    """The remainder of crc32 of the column as text; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % F.lit(n), F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> list[tuple[str, int]]:
    """At most per_class whole texts of each class, the same at every run, with their labels.

    Null labels, ids and texts take no part. Where ids repeat, those that come first by hash of id and text count. Only
    these rows reach the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    met = texts.join(F.broadcast(chosen), "doc_id")  # the broadcast side has 2 * per_class ids at most
    rows = met.orderBy(F.xxhash64("doc_id"), "doc_id", "label", F.xxhash64("text")).limit(2 * per_class).collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.text))
    return [(r.text, r.label) for r in rows]


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoint(). A cluster names a shared one in spark.checkpoint.dir; only a local session gets one of its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


#: Folders of tables that written() made in this process and that nothing has deleted.
WRITTEN: list[str] = []


def written(table: DataFrame) -> DataFrame:
    """table from Parquet in the shared folder, packed and of a size that Spark knows, so that small ones are broadcast."""
    folder = f"{shared_folder(table.sparkSession)}/table-{uuid.uuid4().hex}"
    WRITTEN.append(folder)
    table.write.parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)  # without a job that reads the schema


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def delete_written(spark: SparkSession, since: int = 0) -> None:
    """Deletes what written() made after the first since tables, once nothing reads them any more."""
    while len(WRITTEN) > since:
        delete(spark, WRITTEN.pop())


def others(docs: DataFrame, results: list[str]) -> list[str]:
    """The columns of docs that aren't named like a result, in any case."""
    taken = {r.lower() for r in results}
    return [c for c in docs.columns if c.lower() not in taken]


def unused(name: str, *tables: DataFrame) -> str:
    """name with as many underscores behind it as it takes that no column of tables starts with it, in any case."""
    taken = [c.lower() for t in tables for c in t.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

"""Best-fit packing of token sequences with exact-complement hashing.

Documents become pieces of at most the capacity. What is planned is only the histogram of piece
lengths, which has no more entries than the capacity, so planning costs the same for any corpus.
An index by sum holds the pairs of lengths that make it, and the first lengths of triples that do;
from the longest length down, the gap that a length leaves is looked up among single lengths, sums of
two and sums of three, and a combination that fills it exactly is taken as often as its lengths
last. Counts only fall, so the index drops for good what can't be had any more. What finds no exact
complement is packed best fit, longest first. The plan gives ranges
of ranks within each length; the pieces get their ranks by two levels of counting, so that a length
with most of the pieces is spread over many tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_signs, vocabulary
from .common import kept, others, read, shared_folder, slices, unused

CAPACITY = 2048
#: Pieces of one length that are ranked together; more are dealt to more tasks.
RANKED_TOGETHER = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Range(NamedTuple):
    """Pieces of a length, from the first rank on: each bins pieces fill one sequence's places from offset on."""

    length: int
    first: int
    bins: int
    sequence: int
    offset: int


class Sums:
    """Single lengths and sums of two and three of them, by sum, with what is left of each length.

    A sum's list is made when it is first asked for, longest lengths first. counts may only fall between calls.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        self.triples: dict[int, list[int]] = {}

    def have(self, *lengths: int) -> bool:
        return all(self.counts[k] >= n for k, n in Counter(lengths).items())

    def pair(self, total: int, *spent: int) -> tuple[int, int] | None:
        """Two lengths with this sum, the longer first, that can be had beside spent."""
        if total not in self.pairs:
            there = self.counts[: total + 1] > 0
            longer = np.flatnonzero(there & there[::-1])
            longer = longer[2 * longer >= total]
            self.pairs[total] = [(int(a), total - int(a)) for a in longer if a < total]  # ascending, so the best are last
        own = self.pairs[total]
        while own and not self.have(*own[-1]):
            own.pop()
        return next(((a, b) for a, b in reversed(own) if self.have(a, b, *spent)), None)

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """Three lengths with this sum, the longest first."""
        if total not in self.triples:
            self.triples[total] = [int(a) for a in np.flatnonzero(self.counts[:total] > 0) if 3 * a >= total]
        own = self.triples[total]
        while own:
            a = own[-1]
            if self.have(a) and (two := self.pair(total - a, a)):
                return a, *two
            own.pop()
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill gap exactly, the fewest."""
        return (gap,) if self.counts[gap] > 0 else self.pair(gap) or self.triple(gap)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Range]:
    """Where the pieces of each length go; every length is from 1 to capacity."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    filled: list[tuple[Counter, int]] = []
    left: list[tuple[int, int]] = []
    sums = Sums(counts)
    for length in range(capacity, 0, -1):
        while n := int(counts[length]):
            counts[length] -= 1  # the one whose gap is to be filled
            own = () if length == capacity else sums.complement(capacity - length)
            counts[length] += 1
            if own is None:
                left.append((length, n))
                counts[length] = 0
                break
            need = Counter((length, *own))
            times = min(int(counts[k]) // m for k, m in need.items())
            for k, m in need.items():
                counts[k] -= times * m
            filled.append((need, times))
    gaps: list[int] = []  # of the open bins, in order, each with its contents and how many there are
    bins: dict[int, list[tuple[Counter, int]]] = {}

    def put(gap: int, content: Counter, times: int) -> None:
        if times:
            if gap not in bins:
                bisect.insort(gaps, gap)
                bins[gap] = []
            bins[gap].append((content, times))

    for length, n in left:
        while n:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                content, times = bins[gap].pop()
                if not bins[gap]:
                    del bins[gap], gaps[at]
            else:
                gap, content, times = capacity, Counter(), n
            each = min(gap // length, n)
            used = min(times, n // each)
            if content:
                put(gap, content, times - used)
            put(gap - each * length, content + Counter({length: each}), used)
            n -= used * each
    filled += [x for own in bins.values() for x in own]
    ranges, ranks, sequence = [], Counter(), 0
    for content, times in filled:
        offset = 0
        for length in sorted(content, reverse=True):
            ranges.append(Range(length, ranks[length], content[length], sequence, offset))
            ranks[length] += content[length] * times
            offset += content[length] * length
        sequence += times
    return sorted(ranges)


def _tokenizer(path: str | None):
    """The byte-level vocabulary of a tokenizers file, read by the faster of two libraries that give the same ids."""
    import json

    import tiktoken

    with open(vocabulary(path, "byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: b for b, c in enumerate(byte_signs())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=BYTE_PIECES, mergeable_ranks=ranks, special_tokens=special)


def _encode(coder, path: str | None, text: str) -> np.ndarray:
    """The ids of text. The faster library's pattern gives up on about a million white-space signs in a row; the other takes them."""
    try:
        return coder.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        from tokenizers import Tokenizer

        whole = kept(("byte_bpe_whole", path), lambda: Tokenizer.from_file(vocabulary(path, "byte_bpe_50k.json")))
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)


#: Fixed value: the pieces that the vocabulary was made for.
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _cut(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(("byte_bpe", path), lambda: _tokenizer(path))
        for part in slices(batches):
            rows: list[tuple] = []
            for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.append(_encode(coder, path, text or "").astype("<u4"), np.uint32(0)).astype("<u4")
                start, to = 0, (len(ids) - 1) % capacity + 1
                for piece in range(-(-len(ids) // capacity)):
                    rows.append((key, piece, start, to - start, zlib.crc32(ids[start:to].tobytes())))
                    start, to = to, to + capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """docs (doc_id, text; others are ignored) as pieces of at most capacity tokens, id 0 last.

    A null or empty text is id 0 alone. Only longer documents are cut; the first piece may be shorter. A very long text
    is encoded in one go, at about 4 bytes a token. Repeated rows and null ids stay; an empty table gives none.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(path, capacity), PIECES)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (with doc_id, piece and length from 1 to capacity) with sequence_id and offset.

    Places in a sequence are gapless from 0. Repeated rows are pieces of their own; null ids stay; columns named like
    the results give way, all others stay; an empty table gives none. parts is read three times, so it should be cheap to read.
    """
    spark = parts.sparkSession
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    ranges = plan(histogram, capacity)
    keys = np.array([r.length << 44 | r.first for r in ranges], np.int64)
    place = spark.sparkContext.broadcast((keys, np.array(ranges, np.int64).reshape(-1, 5)))  # its size depends on capacity alone
    salts = max(256, sum(histogram.values()) // RANKED_TOGETHER)
    own = unused("_own_", parts)
    salt, within, ahead, at, piece, size = (own + c for c in ("salt", "within", "ahead", "at", "piece", "size"))
    dealt = parts.withColumns({size: F.col("length").cast("long"), salt: F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts))})
    before = Window.partitionBy(size).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(size, salt).agg(F.count("*").alias(piece)).select(size, salt, F.coalesce(F.sum(piece).over(before), F.lit(0)).alias(ahead))
    number = F.row_number().over(Window.partitionBy(size, salt).orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn(within, number).join(sizes, [size, salt])

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length, rank):
        import pandas as pd

        keys, table = place.value
        _, first, bins, sequence, offset = table[np.searchsorted(keys, length.to_numpy() << 44 | rank.to_numpy(), side="right") - 1].T
        at = rank.to_numpy() - first
        return pd.DataFrame({"sequence_id": sequence + at // bins, "offset": offset + at % bins * length.to_numpy()})

    placed_at = placed.asNondeterministic()(size, F.col(within) + F.col(ahead))  # so that it is evaluated once
    names = others(parts, ["sequence_id", "offset"])
    return ranked.withColumn(at, placed_at).select(*names, f"{at}.sequence_id", f"{at}.offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """All pieces of docs with their places; see pieces() and pack(). Tokens are counted once and kept in the shared folder."""
    shared_folder(docs.sparkSession)
    return pack(pieces(docs, capacity, path).checkpoint(), capacity)


def op5_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """The places of all documents' pieces in sequences of at most 2048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"), CAPACITY, path)

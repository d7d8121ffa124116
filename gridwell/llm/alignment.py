"""How the tokens of two tokenizers correspond: a byte-level vocabulary (A) and a piece vocabulary (B) over the same bytes.

Each text is encoded by both; two pointers go over the cumulative ends of their tokens, the one that is behind moves, and
where both stand at the same byte a group ends. All pairs of A and B tokens of a group are links. The pairs of a
document (each once, with how often it is linked) are counted over the corpus by one aggregation, and the counts
and the highest count of each A id are joined back. The most frequent pairs, a fixed number, are broadcast, so that the greater part of
the links needs no shuffle; all others go through an equi-join, in which no key is frequent, since what is frequent is among the former.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import STEP_BYTES, kept, read, shared_folder, written
from .packing import _tokenizer as byte_tokenizer

#: Frequent pairs that are broadcast, 17 bytes each.
FREQUENT = 200_000
#: Links of a group up to which they are listed one by one; larger groups are counted by distinct ids.
WIDE = 1024

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
SCORED = "row long, n_best long, count_sum long, pairs array<long>, times array<long>"


#: Signs after an id: another of its side, its side's last in the group, the group's last.
COMMA, BAR, SEMICOLON = range(3)


def signed_names(n: int) -> np.ndarray:
    """The ids below n as text, with each of the signs behind them."""
    return np.array([[f"{i}{sign}" for i in range(n)] for sign in ",|;"], object)


class Coder:
    """Both vocabularies with the bytes of every token."""

    def __init__(self, a_path: str | None, b_path: str | None) -> None:
        import sentencepiece

        self.a_path = vocabulary(a_path, "byte_bpe_50k.json")
        self.a, self.b = byte_tokenizer(a_path), sentencepiece.SentencePieceProcessor(model_file=vocabulary(b_path, "piece_bpe_32k.model"))
        a_bytes = [self._a_token(i) for i in range(self.a.n_vocab)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int64) for t in (a_bytes, self.b_bytes))
        self.names = signed_names(max(len(a_bytes), len(self.b_bytes)))

    def _a_token(self, i: int) -> bytes:
        try:
            return self.a.decode_single_token_bytes(i)
        except KeyError:  # an id that the vocabulary leaves out
            return b""

    def encode_a(self, text: str) -> np.ndarray:
        """The ids of A; strings of special tokens are plain text. What the faster library's pattern gives up on goes to the other."""
        try:
            return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:
            from tokenizers import Tokenizer

            def whole():
                own = Tokenizer.from_file(self.a_path)
                own.encode_special_tokens = True
                return own

            return np.array(kept(("byte_bpe_plain", self.a_path), whole).encode(text, add_special_tokens=False).ids, np.int64)

    def both(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both, or None where a vocabulary doesn't give the text's bytes back."""
        data = b" " + text.encode()
        b = self.b.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a = self.encode_a(" " + text)
        # bytes are all that A has, so it can leave some out but not change them
        return (a, np.array(b, np.int64)) if int(self.a_lengths[a].sum()) == len(data) else None


def cuts(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of each side are before the end of each group; the last ends are equal."""
    j, y = 0, b_ends[0]
    a_cuts, b_cuts = [], []
    for i, x in enumerate(a_ends, 1):
        while y < x:
            j += 1
            y = b_ends[j]
        if y == x:
            a_cuts.append(i)
            b_cuts.append(j + 1)
    return a_cuts, b_cuts


class Links(NamedTuple):
    """A text's groups as text (a1,a2|b1;a3|b2), how many there are, and its distinct pairs (A id in the upper 32 bits) with how often each is linked."""

    groups: str
    n_groups: int
    pairs: np.ndarray
    times: np.ndarray


def linked(a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray, names: np.ndarray) -> Links:
    """The groups and links of two encodings of the same bytes; names has, for each of the signs after an id, all ids with it."""
    a_cuts, b_cuts = (np.array(c, np.int64) for c in cuts(np.cumsum(a_lengths[a]).tolist(), np.cumsum(b_lengths[b]).tolist()))
    a_from, b_from = (np.concatenate([np.zeros(1, np.int64), c[:-1]]) for c in (a_cuts, b_cuts))
    a_n, b_n = a_cuts - a_from, b_cuts - b_from
    # all ids in order, A's before B's in each group, with the sign that follows each
    text = np.empty(len(a) + len(b), object)
    a_sign, b_sign = np.full(len(a), COMMA), np.full(len(b), COMMA)
    a_sign[a_cuts - 1], b_sign[b_cuts - 1] = BAR, SEMICOLON
    text[np.arange(len(a)) + np.repeat(b_from, a_n)] = names[a_sign, a]
    text[np.arange(len(b)) + np.repeat(a_cuts, b_n)] = names[b_sign, b]
    groups = "".join(text.tolist())[:-1]
    size = a_n * b_n
    listed = np.where(size <= WIDE, size, 0)
    group = np.repeat(np.arange(len(size)), listed)
    place = np.arange(len(group)) - np.repeat(np.cumsum(listed) - listed, listed)
    found = [a[a_from[group] + place // b_n[group]] << 32 | b[b_from[group] + place % b_n[group]]]
    weights = [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(size > WIDE):
        (ua, ca), (ub, cb) = (np.unique(x[f : f + n], return_counts=True) for x, f, n in ((a, a_from[g], a_n[g]), (b, b_from[g], b_n[g])))
        found.append((ua[:, None] << 32 | ub[None, :]).ravel())
        weights.append((ca[:, None] * cb[None, :]).ravel())
    if len(found) == 1:
        pairs, times = np.unique(found[0], return_counts=True)
    else:
        pairs, back = np.unique(np.concatenate(found), return_inverse=True)
        times = np.zeros(len(pairs), np.int64)
        np.add.at(times, back, np.concatenate(weights))
    return Links(groups, len(a_cuts), pairs, times)


def _align(a_path: str | None, b_path: str | None):
    none = np.zeros(0, np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = kept(("two vocabularies", a_path, b_path), lambda: Coder(a_path, b_path))
        out, held = [], 0

        def flushed() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]).astype({"doc_id": "Int64"})

        for frame in frames:
            for row, key, text in zip(frame["row"], frame["doc_id"], frame["text"], strict=True):
                key = None if pd.isna(key) else int(key)
                ids = coder.both(text) if isinstance(text, str) and text else None
                if ids is None:
                    out.append((row, key, 0, 0, 0, 0, "", none, none))
                else:
                    own = linked(*ids, coder.a_lengths, coder.b_lengths, coder.names)
                    out.append((row, key, len(ids[0]), len(ids[1]), own.n_groups, int(own.times.sum()), own.groups, own.pairs, own.times))
                    held += len(text)
                if held > STEP_BYTES:
                    yield flushed()
                    out, held = [], 0
        if out:
            yield flushed()

    return run


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text; others are ignored): row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    groups is the text a1,a2|b1;a3|b2,b3 of ids in order; pairs has the distinct linked ids, A's in the upper 32 bits, and times how often each
    is linked. Null and empty texts and those whose bytes a vocabulary doesn't give back have zeros and no groups. Repeated rows
    are documents of their own, null ids stay, an empty table gives none. A very long text is encoded in one go; a group with very
    many links is counted by its distinct ids. The paths' files are read on the executors.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInPandas(_align(a_path, b_path), ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (how many documents have it linked) and best (whether no other pair of its A id has more)."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))  # a row per A id
    return counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """aligned with n_best (links whose pair is its A id's most frequent, ties included) and count_sum (the counts of all links, summed).

    frequent: pairs that are broadcast; results don't depend on it. Both tables are read more than once, so they should be written ones.
    """
    head = counts.orderBy(F.desc("n"), "pair").limit(frequent).toArrow().sort_by("pair")  # so many rows at most
    known = aligned.sparkSession.sparkContext.broadcast(tuple(head.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, n, best = known.value
        for frame in frames:
            rows = []
            for row, own, times in zip(frame["row"], frame["pairs"], frame["times"], strict=True):
                at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
                hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
                at, weight = at[hit], times[hit]
                rows.append((row, int(weight[best[at]].sum()), int((weight * n[at]).sum()), own[~hit], times[~hit]))
            yield pd.DataFrame(rows, columns=["row", "n_best", "count_sum", "pairs", "times"])

    part = written(aligned.where(F.size("pairs") > 0).select("row", "pairs", "times").mapInPandas(run, SCORED))
    rest = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    whole = part.drop("pairs", "times").join(sums, "row", "left")
    whole = whole.select("row", *[(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))])
    return aligned.join(whole, "row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op12_alignment(spark, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Groups and links of all documents, with the corpus-wide counts of their pairs."""
    shared_folder(spark)
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = align(read(spark, sf_dir, "documents"), a_path, b_path).select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", groups, "pairs", "times")
    aligned = written(aligned)
    scored = score(aligned, written(pair_counts(aligned)))
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

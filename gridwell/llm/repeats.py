"""Removal of passages that documents repeat, by fixed-block anchors.

A window of 13 words always covers a whole block of 7 of those that a document is cut into from its
start. So each document's non-overlapping blocks are indexed, every rolling window of 7 words probes
that index, and only where a probe hits is a passage extended to windows of 13 words, which are then
held against each other by digests of their bytes (BLAKE2b of 128 bits): the smallest document with a
window keeps it, and neighbouring windows that go make maximal repeats. Blocks and probes are met by
quick hashes of 32 bits; where these agree by chance, the digests tell the windows apart.

Documents are dealt into groups of bounded size by a hash. Groups send their blocks and probes to
buckets of hash values, packed into one binary row for a group and bucket. A bucket's blocks alone
are held, its probes pass by, so buckets are wider than groups and packed rows stay long. What a group
already sees twice isn't sent again, so a passage that many documents share costs an entry per group, not
one per document, and no pairs are formed anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_BYTES, Powers, joined, kept, mix, others, read, slices, span_hashes, unused, words_of

WINDOW = 13
#: Bytes of text in a group of documents, and those whose blocks or windows meet in a bucket; the fewest groups and buckets.
GROUP_BYTES, LEAST_GROUPS = 8 << 20, 64
BLOCK_BUCKET_BYTES, WINDOW_BUCKET_BYTES = 64 << 20, 16 << 20

BLOCKS, PROBES, KNOWN = 0, 1, 2
SENT = "bucket int, kind byte, grp int, hashes binary, docs binary, at binary"
FOUND = "grp int, at binary"


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


SENT_NAMES, SENT_KINDS = ["bucket", "kind", "grp", "hashes", "docs", "at"], [pa.int32(), pa.int8(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
FOUND_NAMES, FOUND_KINDS = ["grp", "at"], [pa.int32(), pa.binary()]


def _code(numbers: np.ndarray) -> bytes:
    """Ascending numbers of 32 bits as differences, their bytes by place, so that shuffles compress the upper ones away."""
    return np.diff(numbers.astype(np.uint32), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _decode(code: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(code, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _cut(text: bytes) -> list[bytes]:
    """text in parts of about STEP_BYTES, cut at white space, so that hashing a very long one needs no more memory."""
    cuts = [0]
    while len(text) - cuts[-1] > 2 * STEP_BYTES:
        space = re.compile(rb"[\t-\r ]").search(text, cuts[-1] + STEP_BYTES)
        if space is None:
            break
        cuts.append(space.start())
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class Words:
    """The words of a group's documents in the order of doc_id: a hash of each, its row, and where each row's words start."""

    def __init__(self, docs: pa.Table) -> None:
        powers = kept(("powers",), Powers)
        self.docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # the same order whenever the group is read
        self.key = self.docs.column("doc_id").combine_chunks()
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in slices(self.docs.select(["text"]).to_batches()):
            if part.num_rows == 1 and part.column("text")[0].is_valid:
                own = [np.frombuffer(piece + b"\n", np.uint8) for piece in _cut(part.column("text")[0].as_py().encode())]
                spans = [words_of(data) for data in own]
                hashes += [span_hashes(data, *span, powers) for data, span in zip(own, spans, strict=True)]
                counts.append(np.array([sum(len(first) for first, _ in spans)]))
                continue
            data, starts = joined(part.column("text"))
            first, last = words_of(data)
            hashes.append(span_hashes(data, first, last, powers))
            counts.append(np.diff(np.searchsorted(first, starts)))
        self.hashes, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.row = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)

    def rolling(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Quick hashes of the n words from each place on, and whether they are all in one document that has an id."""
        places = max(0, len(self.hashes) - n + 1)
        total = np.zeros(places, np.uint64)
        for k in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + self.hashes[k : k + places]
        within = (self.row[:places] == self.row[n - 1 :]) & self.key.is_valid().to_numpy(zero_copy_only=False)[self.row[:places]] if places else np.zeros(0, bool)
        return mix(total), within


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys (numbers or rows of them) starts, one more for the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    new = sorted_keys[1:] != sorted_keys[:-1]
    return np.concatenate([[0], np.flatnonzero(new.any(axis=1) if new.ndim > 1 else new) + 1, [len(sorted_keys)]])


def _by_bucket(hashes: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket that has any: which entries of at it has, in their order."""
    own = _bucket(hashes[at], buckets)
    order = np.argsort(own.astype(np.uint16) if buckets <= 1 << 16 else own, kind="stable")
    cuts = _runs(own[order])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(own[order[a]]), order[a:b]


def _anchors(block: int, buckets: int):
    """A group's blocks and probes for each bucket, and the places that it knows to be repeated without asking."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        group = key[0].as_py()
        words = Words(docs)
        hashes, within = words.rolling(block)
        places = np.flatnonzero(within)
        order = places[np.argsort(hashes[places], kind="stable")]
        cuts = _runs(hashes[order])
        rows: list[tuple] = []
        shared = np.zeros(len(hashes), bool)
        if len(order):
            several = words.row[order[cuts[:-1]]] != words.row[order[cuts[1:] - 1]]  # rows ascend within a run
            shared[order] = np.repeat(several, np.diff(cuts))
        aligned = places[(places - words.starts[words.row[places]]) % block == 0]
        once = aligned[np.unique(hashes[aligned], return_index=True)[1]]
        for bucket, chosen in _by_bucket(hashes, once, buckets):
            rows.append((bucket, BLOCKS, group, hashes[once[chosen]].astype("<u4").tobytes(), None, None))
        probes = places[~shared[places]]
        for bucket, chosen in _by_bucket(hashes, probes, buckets):
            rows.append((bucket, PROBES, group, hashes[probes[chosen]].astype("<u4").tobytes(), None, _code(probes[chosen])))
        if shared.any():
            rows.append((group % buckets, KNOWN, group, None, None, _code(np.flatnonzero(shared))))
        return _table(rows, SENT_NAMES, SENT_KINDS)

    return run


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of bucket and kind: keeps one bucket's blocks, and tells each group's probes that another group's block meets."""
    bucket, blocks, index = None, [], None
    for batch in batches:
        rows = []
        for own, kind, group, hashes, at in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "grp", "hashes", "at")), strict=True):
            if own != bucket:
                bucket, blocks, index = own, [], None
            if kind == KNOWN:
                rows.append((group, at))
            elif kind == BLOCKS:
                blocks.append((np.frombuffer(hashes, "<u4"), group))
            elif blocks:
                if index is None:
                    value = np.concatenate([h for h, _ in blocks])
                    source = np.repeat(np.array([g for _, g in blocks], np.int32), [len(h) for h, _ in blocks])
                    order = np.lexsort((source, value))
                    value, source = value[order], source[order]
                    cuts = _runs(value)
                    index = value[cuts[:-1]], source[cuts[:-1]], source[cuts[1:] - 1]
                    del order, value, source
                probe = np.frombuffer(hashes, "<u4")
                spot = np.minimum(np.searchsorted(index[0], probe), len(index[0]) - 1)
                hit = (index[0][spot] == probe) & ((index[1][spot] != group) | (index[2][spot] != group))
                if hit.any():
                    rows.append((group, _code(_decode(at)[hit])))
        if rows:
            yield from _table(rows, FOUND_NAMES, FOUND_KINDS).to_batches()


def _places(found: pa.Table, n: int) -> np.ndarray:
    """Which of n places any row of found names."""
    at = np.zeros(n, bool)
    for code in found.column("at").to_pylist():
        at[_decode(code)] = True
    return at


def _plain(text: bytes) -> bytes:
    """The words of text with one space between; a very long text is taken in parts."""
    return b" ".join([b" ".join(words) for part in _cut(text) if (words := part.split())])


def _digests(words: Words, places: np.ndarray, window: int) -> np.ndarray:
    """Digests of 128 bits (two columns) of the words of the windows that start at places, which ascend and stay in their documents."""
    rows, counts = np.unique(words.row[places], return_counts=True)
    out, done = [], 0
    for row, n in zip(rows.tolist(), counts.tolist(), strict=True):
        plain = _plain(words.docs.column("text")[row].as_py().encode())
        space = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        first, last = np.concatenate([[0], space + 1]), np.concatenate([space, [len(plain)]])
        own = places[done : done + n] - words.starts[row]
        out += [blake2b(plain[a:b], digest_size=16).digest() for a, b in zip(first[own].tolist(), last[own + window - 1].tolist(), strict=True)]
        done += n
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 2)


def _code_ids(ids: np.ndarray) -> bytes:
    """Ascending ids, each different one once."""
    own, place = np.unique(ids, return_inverse=True)
    return len(own).to_bytes(4, "little") + own.astype("<i8").tobytes() + _code(place)


def _decode_ids(code: bytes) -> np.ndarray:
    n = int.from_bytes(code[:4], "little")
    return np.frombuffer(code, "<i8", n, 4)[_decode(code[4 + 8 * n :])]


def _candidates(block: int, window: int, buckets: int):
    """A group's windows around hits: those that an earlier document of the group has go at once, the first of each is sent to its bucket."""

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows and found.num_rows:
            group = key[0].as_py()
            words = Words(docs)
            within = words.rolling(window)[1]
            hit = np.concatenate([[0], np.cumsum(_places(found, len(words.hashes)))])
            near = np.flatnonzero(within & (hit[window - block + 1 :][: len(within)] > hit[: len(within)]))
            digests = _digests(words, near, window)
            ids = np.asarray(words.key.fill_null(0))[words.row[near]]
            order = np.lexsort((near, digests[:, 1], digests[:, 0]))
            cuts = _runs(digests[order])
            first = np.repeat(ids[order[cuts[:-1]]], np.diff(cuts)) if len(order) else ids
            later = ids[order] > first
            gone, sent = np.sort(near[order[later]]), np.sort(order[~later])
            if len(gone):
                rows.append((group % buckets, KNOWN, group, None, None, _code(gone)))
            for bucket, chosen in _by_bucket(digests[:, 0], sent, buckets):
                own = sent[chosen]
                rows.append((bucket, PROBES, group, digests[own].tobytes(), _code_ids(ids[own]), _code(near[own])))
        return _table(rows, SENT_NAMES, SENT_KINDS)

    return run


def _resolve(sent: pa.Table) -> pa.Table:
    """A bucket's windows: those that a document with a smaller id has as well, by group."""
    rows, entries = [], []
    for kind, group, digests, docs, at in zip(*(sent.column(c).to_pylist() for c in ("kind", "grp", "hashes", "docs", "at")), strict=True):
        if kind == KNOWN:
            rows.append((group, at))
        else:
            entries.append((group, np.frombuffer(digests, "<u8").reshape(-1, 2), _decode_ids(docs), at))
    if entries:
        digests, docs = (np.concatenate([e[i] for e in entries]) for i in (1, 2))
        order = np.lexsort((docs, digests[:, 1], digests[:, 0]))
        cuts = _runs(digests[order])
        gone = np.zeros(len(order), bool)
        gone[order] = docs[order] > np.repeat(docs[order[cuts[:-1]]], np.diff(cuts))
        done = 0
        for group, _, own, at in entries:
            part = gone[done : done + len(own)]
            done += len(own)
            if part.any():
                rows.append((group, _code(_decode(at)[part])))
    return _table(rows, FOUND_NAMES, FOUND_KINDS)


def _kept(window: int, names: list[str], results: list[str]):
    """A group's documents with the text that is left."""

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        words = Words(docs)
        n = len(words.hashes)
        cover = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(_places(found, n)) if found.num_rows else np.zeros(0, np.int64)
        cover[at] += 1
        cover[at + window] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        lost = np.concatenate([[0], np.cumsum(gone)])
        lost = lost[words.starts[1:]] - lost[words.starts[:-1]]
        texts: list[bytes] = []
        spans: list[list[dict]] = []
        for i, text in enumerate(words.docs.column("text").cast(pa.binary()).to_pylist()):
            own: list[dict] = []
            left = []
            at = int(words.starts[i])
            for part in _cut(text or b""):
                parts = part.split()
                if lost[i]:
                    parts, at = [w for w, g in zip(parts, gone[at : at + len(parts)].tolist(), strict=True) if not g], at + len(parts)
                if parts:
                    left.append(b" ".join(parts))
            if lost[i]:
                edge = np.flatnonzero(np.diff(gone[words.starts[i] : words.starts[i + 1]].view(np.int8), prepend=0, append=0))
                own = [{"start": int(a), "length": int(b - a)} for a, b in zip(edge[0::2], edge[1::2], strict=True)]
            texts.append(b" ".join(left))
            spans.append(own)
        out = [words.docs.column(c) for c in names]
        out += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words.counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]
        return pa.table(out, names=[*names, *results])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: str = "") -> DataFrame:
    """docs (doc_id, text and any others) with kept, n_words, n_removed and removed (spans of words: start, length).

    A word goes if a window of window words that covers it also starts in a document with a smaller doc_id.
    kept has the other words, with one space between. A null or empty text has no words. A row with a null
    doc_id keeps all its words and takes none from others; rows with the same doc_id take none from each
    other. A text of any length is one value, whose words are taken in parts. Columns of docs that are named like a
    result (with prefix before its name) give way to it. An empty table gives none.
    """
    block = (window + 1) // 2
    results = [prefix + c for c in ("kept", "n_words", "n_removed", "removed")]
    names = others(docs, results)
    own = unused("_group", docs)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, block_buckets, window_buckets = (max(LEAST_GROUPS, -(-total // size)) for size in (GROUP_BYTES, BLOCK_BUCKET_BYTES, WINDOW_BUCKET_BYTES))
    dealt = docs.select(*names).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn(own, F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    sent = dealt.groupBy(own).applyInArrow(_anchors(block, block_buckets), SENT)
    hits = sent.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_probe, FOUND)
    windows = dealt.groupBy(own).cogroup(hits.groupBy("grp")).applyInArrow(_candidates(block, window, window_buckets), SENT)
    gone = windows.groupBy("bucket").applyInArrow(_resolve, FOUND)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    kinds = (T.StringType(), T.LongType(), T.LongType(), T.ArrayType(span))
    schema = T.StructType([dealt.schema[c] for c in names] + [T.StructField(n, k) for n, k in zip(results, kinds, strict=True)])
    return dealt.groupBy(own).cogroup(gone.groupBy("grp")).applyInArrow(_kept(window, names, results), schema)


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    """What is left of all documents without passages that an earlier document has."""
    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES = {
    "op9_repeats": rf"""
        WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS words FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 1))) AS i FROM d)),
        first AS (SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, {WINDOW})) AS k FROM windows JOIN first USING (s) WHERE first_id < doc_id)),
        placed AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
}

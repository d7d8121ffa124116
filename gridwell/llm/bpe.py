"""Byte-pair encoding and decoding of words with word ends, by a contiguous array of part boundaries and ranks.

A text is normalised (NFC, runs of white space to one space, lower case), split into letters, single
digits and runs of other signs, and each piece's bytes are written as printable signs, the last with
the mark of a word's end. A piece's parts are merged in the order of the vocabulary's ranks: its part
boundaries and the rank of each adjacent pair stand in two short arrays; the lowest rank is looked
for by a scan, its boundary is deleted and the ranks of the neighbouring pairs are worked out again.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, read, slices

#: Fixed value: the pieces that the vocabulary was made for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters and numbers that are newer than the tables that texts are cut by (Unicode 16), and stand for other signs there.
LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb "
    "11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 "
    "191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
#: Lower-case forms that Python's tables don't have yet: single ones, and the first and last of ranges with their distance.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER_RANGES = [(0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27)]
#: Words whose codes are remembered in a generation; the last two generations are kept.
REMEMBERED = 250_000
#: Parts up to which a scan for the lowest rank is used; longer pieces take a heap over the same boundaries.
SHORT = 256
NO_RANK = 1 << 60

SCHEMA = "doc_id long, ids array<int>, decoded string"


def byte_signs() -> list[str]:
    """A printable sign for each byte: itself where it is printable Latin-1, else the next free sign from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encodes and decodes with a vocabulary file of the tokenizers library that has word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        #: By the ids of a pair (left in the upper bits): its rank in the upper bits, the id that it merges to in the lower.
        self.ranks: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[self.ids[left] << 32 | self.ids[right]] = rank << 32 | self.ids[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        later = "".join("-".join(chr(int(c, 16)) for c in span.split("-")) for span in LATER.split())
        self.lower = LOWER | {c: c + step for a, b, step in LOWER_RANGES for c in range(a, b + 1)}
        #: Texts with signs on which the tables of Python, of its regex module and of the vocabulary's library differ: they are rare.
        self.maybe_later, self.has_later = re.compile("[\u0558-\U0010ffff]"), re.compile(f"[{later}{''.join(map(chr, self.lower))}]")
        self.pieces_of_later = regex.compile(PIECES.replace("[^\\s\\p{L}\\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{later}]]").replace("[\\p{L}]", f"[\\p{{L}}--[{later}]]").replace("[\\p{N}]", f"[\\p{{N}}--[{later}]]"), regex.V1)
        signs = byte_signs()
        self.first = [self.ids[c] for c in signs]
        self.last = [self.ids[c + self.end] for c in signs]
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, parts: list[int]) -> list[int]:
        """parts after all merges that the ranks allow, lowest rank first, leftmost of equals."""
        if len(parts) > SHORT:
            return self._merged_long(parts)
        rank = self.ranks.get
        adjacent = [rank(left << 32 | right, NO_RANK) for left, right in zip(parts, parts[1:], strict=False)]
        while adjacent:
            low = min(adjacent)
            if low == NO_RANK:
                break
            i = adjacent.index(low)
            parts[i] = own = low & 0xFFFFFFFF
            del parts[i + 1], adjacent[i]
            if i:
                adjacent[i - 1] = rank(parts[i - 1] << 32 | own, NO_RANK)
            if i < len(adjacent):
                adjacent[i] = rank(own << 32 | parts[i + 1], NO_RANK)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same merges; candidates wait in a heap, since a scan of a very long piece takes its square."""
        rank, n = self.ranks.get, len(parts)
        after, before, part = [*range(1, n), -1], [-1, *range(n - 1)], list(parts)
        heap = [(r, i) for i in range(n - 1) if (r := rank(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j < 0 or rank(part[i] << 32 | part[j]) != low:
                continue
            part[i], part[j], after[i] = low & 0xFFFFFFFF, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := rank(part[k] << 32 | part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
        return [p for p in part if p >= 0]

    def _word(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            parts = [self.first[b] for b in data]
            parts[-1] = self.last[data[-1]]
            ids = tuple(self.merged(parts))
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        self.known[piece] = ids
        return ids

    def _plain(self, text: str, ids: list[int]) -> None:
        # white space only parts pieces, so its runs need no replacing; each sign is lowered by itself, so a last sigma is like any other
        pieces = self.pieces
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
            if self.maybe_later.search(text) and self.has_later.search(text):
                text, pieces = text.translate(self.lower), self.pieces_of_later
        for piece in pieces.findall(text):
            ids += self.known.get(piece) or self._word(piece)

    def encode(self, text: str) -> list[int]:
        """The ids of text."""
        ids: list[int] = []
        at = 0
        if self.specials and "<" in text:
            for m in self.specials.finditer(text):
                self._plain(text[at : m.start()], ids)
                ids.append(self.special[m[0]])
                at = m.end()
        self._plain(text[at:] if at else text, ids)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens of ids, joined by spaces, as without a decoder; unknown ids have none."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def vocabulary(path: str | None, name: str) -> str:
    """path, or the place of the public vocabulary called name on this machine."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def _coder(path: str | None) -> WordBpe:
    """This worker's coder for the vocabulary, with the words that it remembers."""
    return kept(("bpe", path), lambda: WordBpe(vocabulary(path, "word_bpe_49k.json")))


def _encoded(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for part in slices(batches):
            ids = [coder.encode(text or "") for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(coder.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text; others are ignored): its ids and the text that they decode to.

    A null text is an empty one and has no ids; repeated rows and null ids stay; an empty table gives none. A very long
    text is one list of ids, and a very long word is merged by a heap over the same boundaries, in n log n steps.
    path: the vocabulary file, read on the executors; by default the public one that is installed there.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encoded(path), SCHEMA)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of tokens (doc_id, ids array<int>): doc_id and the decoded text; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([coder.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded string")


def op10_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of all documents' ids and of what they decode to."""
    coded = encode(read(spark, sf_dir, "documents"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

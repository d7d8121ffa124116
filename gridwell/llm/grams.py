"""Hashed n-grams of texts, as language and toxicity models take them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: ASCII letters in lower case, other signs of ASCII as a space, everything beyond as it is.
FOLD = np.array([b if 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(128)], np.uint8)
#: The same for bytes.
FOLD_BYTES = np.concatenate([FOLD, np.arange(128, 256, dtype=np.uint8)])
MULTIPLIER = np.uint32(2654435761)
#: Signs that are hashed at once, so that a long text needs no more memory.
BLOCK = 1 << 18


def _buckets(data: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """A bucket below 2**bits for each run of n numbers of data, for each n of sizes."""
    out = []
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(sizes) + 1):
        if n > len(data):
            break
        code = code[: len(data) - n + 1] * np.uint32(16777619) + data[n - 1 :]
        if n in sizes:
            out.append((code + np.uint32(n)) * MULTIPLIER >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def grams(text: bytes, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """A bucket below 2**bits for each n-gram of the text's bytes, for each n of sizes; a space stands before and after the text."""
    return _buckets(FOLD_BYTES[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32), sizes, bits)


def _parts(length: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """Blocks of a text: where each starts, where its n-grams start before, and where those of the longest end."""
    for at in range(0, length, BLOCK):
        yield at, min(at + BLOCK, length), min(at + BLOCK + reach - 1, length)


def gram_counts(text: bytes, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """How often each bucket has an n-gram of the text's bytes."""
    if len(text) <= BLOCK:
        return np.bincount(grams(text, sizes, bits), minlength=1 << bits)
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    total = np.zeros(1 << bits, np.int64)
    for n in sizes:
        for at, _, end in _parts(len(data), n):
            total += np.bincount(_buckets(FOLD_BYTES[data[at:end]].astype(np.uint32), (n,), bits), minlength=1 << bits)
    return total


def character_grams(text: bytes, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of the text's characters (UTF-8), ascending and each once, and how often; a space stands before and after."""
    if text.isascii():
        signs, dtype = b" " + text + b" ", np.uint8
    else:
        signs, dtype = (" " + text.decode("utf-8", "replace") + " ").encode("utf-32-le", "replace"), np.dtype("<u4")
    data = np.frombuffer(signs, dtype)

    def folded(part: np.ndarray) -> np.ndarray:
        return np.where(part < 128, FOLD[np.minimum(part, 127)], part).astype(np.uint32)

    if len(data) <= BLOCK:
        return np.unique(_buckets(folded(data), sizes, bits), return_counts=True)
    total = np.zeros(1 << bits, np.int64)
    for n in sizes:
        for at, _, end in _parts(len(data), n):
            total += np.bincount(_buckets(folded(data[at:end]), (n,), bits), minlength=1 << bits)
    found = np.flatnonzero(total)
    return found, total[found]

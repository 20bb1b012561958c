"""Words of a text as bytes, and hashes of runs of words, for the operators that run in Python."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

#: Odd multipliers of the rolling hashes of runs of words.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def utf8(text: str | None) -> bytes:
    """The text's bytes; nothing for null."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def split_words(text: str | None) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D: what bytes.split() splits at."""
    return utf8(text).split()


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """Of each run of width values: entry i is of hashes[i : i + width]."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        out *= np.uint64(multiplier)
        out += hashes[j : j + n]
    return mix(out)


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to most or less, or that hold one row."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def covered(length: int, starts: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """Mask of the positions below length that lie in any of the spans."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, length), -1)
    return np.cumsum(change[:length]) > 0

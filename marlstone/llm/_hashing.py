"""Vectorised hashing of the texts in an Arrow batch: no Python per byte, word or document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class Powers:
    """Powers of the odd base and of its inverse modulo 2^64, grown as longer texts come."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.letters = _splitmix(256, 7)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = (_powers(base, n) for base in (_BASE, _INVERSE))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


class Rolling:
    """Hashes of any byte spans of ``data``: equal spans have equal hashes, wherever they start."""

    def __init__(self, data: np.ndarray, powers: Powers):
        powers.upto(len(data) + 1)
        self.powers = powers
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(powers.letters[data] * powers.up[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.powers.down[start])

    def all_of(self, k: int) -> np.ndarray:
        """Of every span of k bytes, by start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.powers.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding(values: np.ndarray, width: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbouring values, in linear time."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values
    pick = np.minimum if least else np.maximum
    rows = -(-len(values) // width)
    padded = np.full(rows * width, _MASK if least else 0, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(rows, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column without nulls; row i is bytes[offsets[i]:offsets[i + 1]]."""
    wide = "large" in str(column.type)
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def in_chunks(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``most`` bytes, or one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(inside: bytes | None = None, outside: bytes | None = None) -> np.ndarray:
    """Which byte values belong to words; given by those inside or outside the class."""
    table = np.zeros(256, bool) if inside is not None else np.ones(256, bool)
    table[np.frombuffer(inside if inside is not None else outside, np.uint8)] = inside is not None
    return table


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text and the end): maximal runs of word bytes, A-Z lower-cased, none across texts."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    inside = is_word[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Rolling(low, powers).spans(starts, ends), np.searchsorted(starts, offsets)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbouring words, by first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = mix(total + words[j : j + n] + np.uint64(j + 1)) if k <= 4 else total * np.uint64(_BASE) + words[j : j + n]
    return total if k <= 4 else mix(total)

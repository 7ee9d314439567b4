"""Words, windows and lines of many texts at once, as numpy arrays over the bytes of an Arrow column.

A slice holds whole texts. Hashes have 64 bits: an odd-multiplier polynomial over random byte values, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text per slice; a longer text makes a slice of its own.
SLICE_BYTES = 256 << 10

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
# A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(_STEP))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, SLICE_BYTES + 1)
_INVERSES = _powers(_BASE_INVERSE, SLICE_BYTES + 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes that does not depend on where the span lies."""
    n = len(data)
    powers, inverses = _POWERS, _INVERSES
    if n >= len(powers):
        powers, inverses = _powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE_VALUES[data] * powers[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(_U) * _U(_STEP))


@dataclass
class Texts:
    """Some whole texts: rows ``first`` to ``first + count`` of a batch, their bytes and where each begins."""

    first: int
    count: int
    data: np.ndarray
    offsets: np.ndarray

    def texts(self) -> list[str]:
        data = self.data.tobytes()
        return [data[a:b].decode() for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column to slices of whole texts; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        begin, end = offsets[first], offsets[last]
        yield Texts(first, last - first, data[begin:end], offsets[first : last + 1] - begin)
        first = last


@dataclass
class Words:
    """Words of a slice: byte spans, hashes, the text of each and its position there."""

    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    text: np.ndarray
    position: np.ndarray
    hashes: np.ndarray

    def windows(self, k: int) -> np.ndarray:
        """Indices of words at which k consecutive words of one text begin."""
        return np.flatnonzero(self.position + k <= self.counts[self.text])

    def window_hashes(self, k: int, begins: np.ndarray, seed: int = _STEP) -> np.ndarray:
        """Hash of the k words from each index on."""
        total = np.zeros(len(begins), _U)
        for j in range(k):
            total = total * _U(seed | 1) + self.hashes[begins + j]
        return mix(total)


def words(texts: Texts, lower: bool = False, other: np.ndarray = WHITE) -> Words:
    """Words are the longest runs of bytes that are not in ``other``."""
    data = LOWER[texts.data] if lower else texts.data
    inside = ~other[data]
    begins, lasts = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    lasts[:-1] &= ~inside[1:]
    edges = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    begins[edges] = inside[edges]
    lasts[edges[1:] - 1] = inside[edges[1:] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(lasts) + 1
    before = np.searchsorted(starts, texts.offsets)
    counts = np.diff(before)
    text = np.repeat(np.arange(texts.count), counts)
    position = np.arange(len(starts)) - before[:-1][text]
    return Words(starts, ends, counts, text, position, span_hashes(data, starts, ends))


def group_sizes(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (text, hash) entry: how many entries equal it, and how many of those come before it."""
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(order)))
    size, earlier = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    size[order] = sizes[group]
    earlier[order] = np.arange(len(order)) - first[group]
    return size, earlier


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])


def covered(begins: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of k words that starts at one of ``begins``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + k, -1)
    return np.cumsum(edge[:n]) > 0

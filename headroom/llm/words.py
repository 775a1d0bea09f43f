"""Words, lines and their hashes out of the bytes of many texts at once, in numpy.

The bytes of a group of texts lie one after another.  A polynomial prefix hash
over them (modulo 2^64, with a random value per byte) gives the hash of any
span in one subtraction and one multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from headroom.llm.common import SEPARATORS

GROUP_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Spans:
    """Spans of a byte array: first byte, byte after the last, text they belong to, hash."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray


class Hashed:
    """Prefix hashes over ``data``; ``bounds`` are the offsets of the texts in it."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        n = len(data) + 1
        self.back = powers(pow(BASE, -1, 1 << 64), n)
        self.prefix = np.zeros(n, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, n)[:-1], dtype=np.uint64, out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> Spans:
        text = np.searchsorted(self.bounds, start, side="right") - 1
        value = (self.prefix[end] - self.prefix[start]) * self.back[start]
        return Spans(start, end, text, mix(value + (end - start).astype(np.uint64)))

    def words(self) -> Spans:
        inside = ~IS_SEPARATOR[self.data]
        cut = np.zeros(len(self.data) + 1, dtype=bool)
        cut[self.bounds] = True
        before = np.concatenate(([False], inside))
        after = np.concatenate((inside, [False]))
        start = np.flatnonzero(after & (~before | cut))
        end = np.flatnonzero(before & (~after | cut))
        return self.spans(start, end)

    def lines(self) -> Spans:
        feeds = np.flatnonzero(self.data == 0x0A)
        start = np.union1d(self.bounds[:-1][np.diff(self.bounds) > 0], feeds + 1)
        start = start[start < len(self.data)]
        # up to the next line feed or the end of the text
        feed = np.append(feeds, len(self.data))[np.searchsorted(feeds, start)]
        text = np.searchsorted(self.bounds, start, side="right")
        return self.spans(start, np.minimum(feed, self.bounds[text]))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; null is empty.  Reads Arrow's own buffers."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    return data, bounds


def groups(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, bounds) of runs of texts of up to ``most`` bytes, or of one longer text."""
    data, bounds = texts_of(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        part = bounds[first : last + 1]
        yield first, last, data[part[0] : part[-1]], part - part[0]
        first = last


def pieces(data: np.ndarray, most: int = GROUP_BYTES) -> Iterator[np.ndarray]:
    """A long text in pieces that end after a line feed; a longer line stays whole."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > most:
            feeds = np.flatnonzero(data[at : at + most] == 0x0A)
            while not len(feeds) and at + most < len(data):
                most *= 2
                feeds = np.flatnonzero(data[at : at + most] == 0x0A)
            end = at + int(feeds[-1]) + 1 if len(feeds) else len(data)
        yield data[at:end]
        at = end

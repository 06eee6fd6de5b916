"""Words and substrings of whole Arrow string columns as 64-bit hashes, with numpy.

A polynomial hash over running sums gives the hash of any span of bytes in
constant time. Texts are taken in blocks of about a megabyte, cut between words,
so that neither a wide batch nor one very long text needs memory many times its
size. Two different spans share a 64-bit hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, ``size`` of each at least."""
    if not _powers or len(_powers[0]) < size:
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(max(size, BLOCK + 1), base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of byte spans of one block."""

    def __init__(self, block: np.ndarray):
        forward, self._back = _power_tables(len(block) + 1)
        self._sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * forward[: len(block)], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        return mix((self._sums[end] - self._sums[start]) * self._back[start] + size * np.uint64(0xD6E8FEB86659FD93))


def bytes_and_offsets(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column one after another, and where each value starts; a null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def is_blank(data: np.ndarray) -> np.ndarray:
    """Space, tab, line feed, vertical tab, form feed, carriage return."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Cuts the bytes into ranges of about ``size``, at ends of values or else at a blank."""
    at, total = 0, int(offsets[-1])
    while at < total:
        end = min(at + size, total)
        if end < total:
            value_end = int(offsets[np.searchsorted(offsets, end, side="right") - 1])
            if value_end > at:
                end = value_end
            else:
                step = size
                while True:
                    found = np.flatnonzero(is_blank(data[end : end + step]))
                    limit = int(offsets[np.searchsorted(offsets, at, side="right")])
                    if len(found) or end + step >= limit:
                        end = min(end + int(found[0]) if len(found) else limit, limit)
                        break
                    end += step
        yield at, end
        at = end


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of every text with A-Z lowered,
    in order, and the number of words of each text."""
    data, offsets = bytes_and_offsets(column)
    found, owners = [], []
    for at, end in blocks(data, offsets):
        block = lower_ascii(data[at:end])
        inside = np.concatenate(([False], ~is_blank(block), [False]))
        cuts = offsets[(offsets > at) & (offsets < end)] - at
        opens = inside[1:-1] & ~inside[:-2]
        closes = inside[1:-1] & ~inside[2:]
        opens[cuts] |= inside[1:-1][cuts]
        closes[cuts - 1] |= inside[1:-1][cuts - 1]
        start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        found.append(Spans(block).hash(start, stop))
        owners.append(np.searchsorted(offsets, start + at, side="right") - 1)
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    if not found:
        return np.zeros(0, np.uint64), counts
    counts += np.bincount(np.concatenate(owners), minlength=len(counts))
    return np.concatenate(found), counts

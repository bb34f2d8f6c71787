"""Vectorised text scanning over Arrow string buffers.

A block is a run of whole documents, at most ``BLOCK_BYTES`` of text unless one document alone is longer.
Words, lines and windows of a block are found and hashed with numpy on the UTF-8 bytes; no Python loop
runs over words. Hashes are polynomial prefix sums modulo 2**64 over random byte values, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 256 << 10

# white space of the word classes: \x20 and \x09-\x0D
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, lower-case letters and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int) -> None:
        base = (int(_values(seed)[7]) | 1) & (2**64 - 1)
        self._bases = (base, pow(base, -1, 2**64))
        self._tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self._tables[0]) < n:
            m = len(self._tables[0])
            self._tables = [np.concatenate([t, t * np.uint64(pow(b, m, 2**64))]) for b, t in zip(self._bases, self._tables, strict=True)]
        return self._tables[0][:n], self._tables[1][:n]


BYTES_A, BYTES_B = _values(11), _values(23)
POW_A, POW_B, POW_W = Powers(31), Powers(47), Powers(59)


class Prefix:
    """Prefix sums of a sequence of uint64 values, from which any range is hashed in constant time."""

    def __init__(self, values: np.ndarray, powers: Powers) -> None:
        up, self._down = powers.get(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))

    def rolling(self, width: int) -> np.ndarray:
        """A hash for every start of a full window, not mixed with its length."""
        n = len(self._sums) - width
        return mix((self._sums[width:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)


@dataclass
class Block:
    """Whole documents: one byte buffer and, for document i, its range offsets[i]:offsets[i+1]."""

    buf: np.ndarray
    offsets: np.ndarray
    rows: pa.RecordBatch

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(self.rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, len(array) + 1 + array.offset)[array.offset :].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, target: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts record batches into blocks at document borders."""
    for batch in batches:
        buf, offsets = raw(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + target, side="right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield Block(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], batch.slice(lo, hi - lo))
            lo = hi


def range_hashes(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of the ranges that follow one another up to ``ends``, taken in pieces that fit a cache."""
    begins = np.append(0, ends[:-1])
    one, two = np.empty(len(ends), np.uint64), np.empty(len(ends), np.uint64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + BLOCK_BYTES, side="right")))
        part, at = buf[begins[lo] : ends[hi - 1]], begins[lo]
        for out, second in ((one, False), (two, True)):
            out[lo:hi] = byte_prefix(part, second).ranges(begins[lo:hi] - at, ends[lo:hi] - at)
        lo = hi
    return one, two


@dataclass
class Words:
    """Words of a block in order; those of document i are first[i]:first[i+1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes for which ``inside`` holds, never across documents."""
    n = len(buf)
    on = np.zeros(n + 2, np.int8)
    on[1:-1] = inside[buf]
    left = on[1:-1] > on[:-2]
    right = on[1:-1] > on[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    left[cut] |= on[1:-1][cut] > 0
    right[cut - 1] |= on[1:-1][cut - 1] > 0
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def byte_prefix(buf: np.ndarray, second: bool = False) -> Prefix:
    return Prefix(BYTES_B[buf], POW_B) if second else Prefix(BYTES_A[buf], POW_A)


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of every full window of ``width`` words that stays in one document."""
    rolled = Prefix(hashes, POW_W).rolling(width)
    ok = np.ones(len(rolled), bool)
    for k in range(1, width):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    at = np.flatnonzero(ok)
    return at, rolled[at]


def covered(n: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Boolean mask of the positions inside any range starting at ``starts``."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return np.cumsum(marks[:-1]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values over first[i]:first[i+1] for every i; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first])

"""Words of whole Arrow text columns as NumPy arrays.

A text column is read as one byte buffer with row offsets; word borders, word
codes and n-gram codes are computed for a block of rows at a time without a
Python loop over words.  Codes are polynomial hashes modulo 2**64, finished
by a bijective mixer; callers that need equality of content beyond 64 bits add
a second code or compare the bytes.

Nulls count as empty texts.  Blocks hold whole rows, about ``BLOCK_BYTES``
of text each; one row is never split, so the largest text bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

# Separators: space and the bytes 0x09-0x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# A-Z to a-z, everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 2 * BLOCK_BYTES:  # a very long text's tables are not kept
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets, starting at 0."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return buf, offsets - offsets[0]


@dataclass
class Words:
    """Words of a block of rows: byte range of each, and each row's first word."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n_rows + 1 word indexes

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def codes(self, ends: np.ndarray | None = None, starts: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit code of each word, or of the byte ranges given."""
        start = self.start if starts is None else starts
        end = self.end if ends is None else ends
        power, inverse = _powers(_BYTE_BASE, len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))

    def ngrams(self, codes: np.ndarray, n: int, family: int = 0) -> np.ndarray:
        """The code of ``n`` words from each word on; those that run over the
        end of the last row are cut off, other rows' ends are left to
        :meth:`whole`."""
        if len(codes) < n:
            return np.zeros(0, np.uint64)
        power, inverse = _powers(_WORD_BASES[family], len(codes) + 1)
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * power[:-1], out=total[1:])
        at = np.arange(len(codes) - n + 1)
        return mix((total[at + n] - total[at]) * inverse[at])

    def whole(self, n: int) -> np.ndarray:
        """Indexes of the words that start ``n`` words of one row."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))
        return np.flatnonzero(left >= n)


def words_of(column: pa.Array, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    """Maximal runs of bytes that are no separators, row by row."""
    buf, offsets = text_buffer(column)
    if lower:
        buf = LOWER[buf]
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Words(buf, none, none, np.zeros(len(offsets), np.int64))
    inside = ~separators[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)  # a row begins here
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return Words(buf, start, end, np.searchsorted(start, offsets, "left"))

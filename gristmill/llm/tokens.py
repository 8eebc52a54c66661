"""Words and n-grams of whole Arrow columns of text as 64-bit hashes, by numpy over the column's bytes.

Word classes here only tell ASCII bytes apart, and every byte of a multi-byte UTF-8 character is above 0x7F, so
working on bytes gives the same words as working on characters. A word's hash is a polynomial in a fixed odd base
over random 64-bit values of its bytes, got from prefix sums modulo 2**64; collisions of different words or n-grams
have a chance near 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _FOLDED[97:123]
_BASE, _GRAM = (_rng.integers(1, 2**62, 2, dtype=np.int64) * 8 + 5).view(np.uint64)


def _class(chars: set[int]) -> np.ndarray:
    lut = np.ones(256, bool)
    lut[list(chars)] = False
    return lut


#: [^\x20\x09-\x0D]+
SPACED = _class({0x20, *range(0x09, 0x0E)})
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z; so upper-case letters are of a word too
ALNUM = _class({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


#: Bytes, and words, whose prefix sums are taken at a time: what a scan holds beside the text doesn't grow with 8 bytes a byte.
_AT_ONCE = 1 << 16


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64; longer ones than `_AT_ONCE` are made anew when asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up, self.down = self._made(_AT_ONCE)

    def _made(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (self.base, self.inverse))
        return up, down

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = (self.up, self.down) if n <= _AT_ONCE else self._made(n)
        return up[:n], down[:n]


_BASE_POWERS, _GRAM_POWERS = _Powers(_BASE), _Powers(_GRAM)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Text:
    """The texts of some rows: their bytes, where each row begins, their words and the words' hashes."""

    data: np.ndarray  # uint8
    offsets: np.ndarray  # rows + 1
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # rows + 1: the first word of each row
    hashes: np.ndarray  # uint64

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if large else np.int32, len(column) + 1, column.offset * (8 if large else 4)).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def release() -> None:
    """Gives freed memory back: Python workers live on after a task, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `most` bytes of `column` each, or one row if that alone has more."""
    for batch in batches:
        _, offs = column_bytes(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        batch = None
        release()


def scan(column: pa.Array, words: np.ndarray, fold: bool = False) -> Text:
    """Words of each row by the byte class `words`; fold: their hashes take A-Z as a-z."""
    data, offs = column_bytes(column)
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Text(data, offs, z, z, np.zeros(len(offs), np.int64), np.zeros(0, np.uint64))
    inside = words[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < n]
    begin[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    letters = _FOLDED if fold else _BYTE
    i = 0
    while i < len(starts):  # words that lie in so many bytes, or one longer word
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _AT_ONCE, "right")))
        part = data[low : ends[j - 1]]
        up, down = _BASE_POWERS.to(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(letters[part] * up, out=sums[1:])
        hashes[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    return Text(data, offs, starts, ends, np.searchsorted(starts, offs), mix(hashes))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of words i to i + k - 1, for each i; they may run from one row into the next."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = max(1, _AT_ONCE - k)
    for i in range(0, n, step):
        part = hashes[i : i + step + k - 1]
        up, down = _GRAM_POWERS.to(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up, out=sums[1:])
        out[i : i + step] = (sums[k:] - sums[:-k]) * down[: len(part) - k + 1]
    return mix(out)


def gram_rows(text: Text, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word) of each k words that stand in one row."""
    n = len(text.hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = text.rows
    at = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
    return row[at], at


def binary_array(blob: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over one buffer; offsets count bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(blob))])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)

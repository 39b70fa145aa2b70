"""Words and their hashes from Arrow text columns, a slice of rows at a time.

A word is a maximal run of bytes other than space and \\x09-\\x0D, as in ``[^\\x20\\x09-\\x0D]+``.
All functions work on whole texts; slices end between rows only, so memory follows the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
LONG_WORD = 256

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

# Odd 64-bit multipliers for mixing.
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass
class Words:
    """Words of rows ``first``.. of a column; ``bounds[i]:bounds[i+1]`` are row i's words."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))

    def row_end(self) -> np.ndarray:
        """For each word the index after its row's last word."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds))

    def windows(self, k: int) -> np.ndarray:
        """Indices of words that start k consecutive words of one row."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(np.arange(n) + k <= self.row_end()[:n])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte data and the rows' offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def split_words(column: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The column's words in slices of whole rows; ``lower`` maps A-Z to a-z."""
    data, at = text_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1)
        part = data[at[i] : at[j]]
        if lower:
            part = _LOWER[part]
        yield _words(i, part, at[i : j + 1] - at[i])
        i = j


def _words(first: int, data: np.ndarray, at: np.ndarray) -> Words:
    n = len(data)
    space = np.ones(n + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    inside = ~space[1:-1]
    before, after = space[:-2].copy(), space[2:].copy()
    edges = at[(at > 0) & (at < n)]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return Words(first, data, starts, ends, np.searchsorted(starts, at))


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; longer words hash by a digest."""
    length = words.ends - words.starts
    padded = np.zeros(len(words.data) + 8, dtype=np.uint8)
    padded[: len(words.data)] = words.data
    eight = np.ndarray((len(words.data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    with np.errstate(over="ignore"):
        h = (length.astype(np.uint64) + np.uint64(seed)) * _M1
        which, step = np.arange(len(length)), 0
        short = length <= LONG_WORD
        if not short.all():
            which = which[short]
        while len(which):
            x = eight[words.starts[which] + step]
            left = length[which] - step
            tail = left < 8
            if tail.any():
                x = np.where(tail, x & ((np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1)), x)
            x = x * _M2
            x ^= x >> np.uint64(29)
            y = (h[which] ^ x) * _M3
            h[which] = y ^ (y >> np.uint64(32))
            step += 8
            which = which[left > 8]
        for i in np.flatnonzero(~short):
            digest = hashlib.blake2b(words.data[words.starts[i] : words.ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
            h[i] = np.frombuffer(digest.digest(), dtype="<u8")[0]
        return mix(h)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of k consecutive word hashes, for every start where k words follow in the slice."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64((0xD6E8FEB86659FD93 + 2 * salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        # Horner's rule over the binary digits of k: (have) words, then twice as many, then one more.
        acc, power, have = h.copy(), base, 1
        for bit in bin(k)[3:]:
            acc = acc[: len(acc) - have] * power + acc[have:]
            power, have = power * power, 2 * have
            if bit == "1":
                acc = acc[: len(acc) - 1] * base + h[have:]
                power, have = power * base, have + 1
        return mix(acc[:n] + np.uint64(k))


def sliding_min(a: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive values."""
    if len(a) < k:
        return a[:0]
    m, have = a, 1
    while 2 * have <= k:
        m, have = np.minimum(m[:-have], m[have:]), 2 * have
    return np.minimum(m[: len(a) - k + 1], m[k - have : k - have + len(a) - k + 1])

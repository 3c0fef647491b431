"""Words and their hashes for whole Arrow batches, as numpy arrays.

All functions work on UTF-8 bytes. That is exact here, because every word class in use
either contains all bytes from 0x80 on or is defined on ASCII separators only. Hashes have
64 bits; two texts are compared by hash only within one pair or one lookup, where a chance
collision has a probability of about 1e-15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def not_space() -> np.ndarray:
    """Class of ``[^\\x20\\x09-\\x0D]``."""
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Class of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of lower-cased text."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    table[0x41:0x5B] = True  # upper case, which is lowered first
    return table


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * SLICE_BYTES), base, dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[key] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalize 64-bit values (splitmix64)."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about SLICE_BYTES of text: first row, end row, bytes, offsets.

    Null texts are empty. A row longer than the limit is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of some rows: starts, ends (byte positions), hashes and bounds by row."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, hashed: bool = True):
        size = len(buf)
        inside = table[buf]
        before = np.zeros(size, dtype=bool)
        after = np.zeros(size, dtype=bool)
        if size:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            before[offsets[:-1][offsets[:-1] < size]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: word numbers: row i has bounds[i] to bounds[i + 1]
        self.bounds = np.searchsorted(self.starts, offsets)
        self._total: np.ndarray | None = None
        self.hashes = self._hash(buf) if hashed else None

    def stems(self, size: int) -> np.ndarray:
        """Hashes of the words' first bytes; a shorter word's hash is that of the word."""
        with np.errstate(over="ignore"):
            span = self._total[np.minimum(self.ends, self.starts + size)] - self._total[self.starts]
            return mix(span * _power(_BINV, len(self._total), "inv")[self.starts])

    def _hash(self, buf: np.ndarray) -> np.ndarray:
        self._total = total = np.zeros(len(buf) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * _power(_B, len(buf), "b"), out=total[1:])
            span = total[self.ends] - total[self.starts]
            return mix(span * _power(_BINV, len(buf) + 1, "inv")[self.starts])


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and for each row the bounds in them.

    A row with fewer words, but not none, has one gram of all its words.
    """
    counts = np.diff(words.bounds)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate(([0], np.cumsum(n)))
    first = np.repeat(words.bounds[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    width = np.repeat(np.minimum(counts, k), n)
    out = np.zeros(len(first), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            step = np.zeros(len(first), dtype=np.uint64)
            live = width > j
            step[live] = words.hashes[first[live] + j]
            out = np.where(live, out * np.uint64(0xD6E8FEB86659FD93) + step, out)
        return mix(out + width.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), bounds

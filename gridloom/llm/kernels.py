"""Vectorised byte and word kernels shared by the text operators.

Everything here works on one bounded block of documents at a time: a flat
``uint8`` buffer plus document offsets, as Arrow lays strings out. Hashes are
polynomial fingerprints modulo 2**64 over random symbol values, finished with a
mixing step; they are deterministic across processes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Words of ``[^\x20\x09-\x0D]+``.
SPACE_SEP = np.zeros(256, bool)
SPACE_SEP[[0x20, 9, 10, 11, 12, 13]] = True
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on lower-cased text; capital letters fold to small ones.
ALNUM_SEP = np.zeros(256, bool)
ALNUM_SEP[:128] = True
ALNUM_SEP[0x30:0x3A] = ALNUM_SEP[0x41:0x5B] = ALNUM_SEP[0x61:0x7B] = False

_FOLDED = _BYTE_VALUES.copy()
_FOLDED[0x41:0x5B] = _BYTE_VALUES[0x61:0x7B]

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, BLOCK_BYTES + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _pow, _inv = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``window`` takes the fingerprint of any range."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def window(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def windows(sums: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all ranges of k symbols."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[k:] - sums[:n]) * powers(len(sums))[1][:n] + np.uint64(k))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges [a, b) of at most ``limit`` bytes, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def word_bounds(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more entry than rows)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~sep[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    at, to = offsets[full], offsets[full + 1] - 1
    first[at], last[to] = inside[at], inside[to]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A fingerprint for each word; fold takes A-Z for a-z. Works in runs of words, so that its memory does not follow a long row."""
    values = _FOLDED if fold else _BYTE_VALUES
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        base = starts[i]
        out[i:j] = window(prefix(values[buf[base : ends[j - 1]]]), starts[i:j] - base, ends[i:j] - base)
        i = j
    return out


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[buf]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x[:n].copy() if span == w else np.minimum(x[:n], x[w - span : w - span + n])


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row index of each item, from the index of each row's first item."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

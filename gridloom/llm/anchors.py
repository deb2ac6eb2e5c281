"""Content-defined anchors: which long windows repeat, without a row for every window.

A window is ``length`` consecutive symbols (words or bytes). Its anchor is the
least fingerprint among its k-symbol grams, the leftmost of equal ones. Equal
windows have equal anchors at equal places, so only occurrences of one anchor
need comparing. Neighbouring windows mostly share an anchor occurrence: a row
stands for such a run of windows, about 2 / (length - k + 2) rows for each symbol.
"""

from __future__ import annotations

import numpy as np

from . import kernels

_LOW = np.uint64((1 << 24) - 1)
#: Windows searched at once: with a window's length more, their grams' places fit the low bits, so that the leftmost of equal grams is the least in texts of any length.
PIECE = 1 << 23


def _places(grams: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each span consecutive grams, the leftmost of equal ones."""
    out = []
    for lo in range(0, len(grams) - span + 1, PIECE):
        part = grams[lo : lo + PIECE + span - 1]
        least = kernels.sliding_min((part & ~_LOW) | np.arange(len(part), dtype=np.uint64), span)
        out.append((least & _LOW).astype(np.int64) + lo)
    return np.concatenate(out)


def runs(sums: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For the rows that bounds part: (row, first window start within the row, number of windows, anchor, context).

    sums: prefix sums of the symbols. The context is a fingerprint of all symbols
    that the run's windows cover and of the anchor's place among them.
    """
    n = len(sums) - 1
    empty = np.zeros(0, np.int64)
    if n < length or not (np.diff(bounds) >= length).any():
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    grams = kernels.windows(sums, k)
    place = _places(grams, length - k + 1)
    start = np.arange(len(place))
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(place)]
    valid = start + length <= bounds[row + 1]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    if not len(at):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    count = np.add.reduceat(valid.astype(np.int64), at)
    anchor = grams[place[at]]
    context = kernels.mix(kernels.window(sums, at, at + count + length - 1) + (place[at] - at).astype(np.uint64))
    return row[at], at - bounds[row[at]], count, anchor, context


def window_prints(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    return kernels.window(sums, starts, starts + length)

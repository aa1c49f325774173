"""Content-defined anchors of a byte string: equal passages have equal anchors inside them."""

from __future__ import annotations

import numpy as np

GRAM = 8


def anchors(raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that hold the smallest 8-byte gram (the last, if equal) of some `width` grams,
    and for each but the first, the start of the first group of grams it is smallest of.

    Two neighbouring anchors are neighbours in every copy of a string that holds both the last
    group of the one and the first group of the other.
    """
    n = len(raw) - GRAM + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return lowest(np.ndarray((n,), "<u8", np.ascontiguousarray(raw), strides=(1,)), width)


def lowest(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """`anchors` of a text that is given as its grams, 64 bits each."""
    n = len(grams)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = grams * np.uint64(0x9E3779B97F4A7C15)
    bits = np.uint64(max(1, int(n).bit_length()))
    h &= ~((np.uint64(1) << bits) - np.uint64(1))
    h |= np.arange(n - 1, -1, -1, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n - width + 1], ahead[width - 1:n])
    turns = np.flatnonzero(low[1:] != low[:-1]) + 1
    low = low[np.concatenate(([0], turns))]
    at = np.uint64(n - 1) - (low & ((np.uint64(1) << bits) - np.uint64(1)))
    return at.astype(np.int64), turns

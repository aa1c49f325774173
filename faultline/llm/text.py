"""Vectorised helpers over the UTF-8 bytes of Arrow string columns, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE[_LOWER]
_PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base and its inverse to the powers 0 .. n-1, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BACK)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] \
        if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def portions(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """`chunks` of a string column, whose text is not copied for it."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return chunks(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), limit)


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running polynomial hash: entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    up, _ = powers(len(data))
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up, out=out[1:])
    return out


def running(codes: np.ndarray) -> np.ndarray:
    """`prefix_hash` of a sequence of 64-bit codes."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes hash alike wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start]
               + (end - start).astype(np.uint64) * _PLACE[7])


def words(data: np.ndarray, offsets: np.ndarray,
          between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than those `between` words (ASCII white space)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~between[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[-1]]
    before[heads] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    after[tails] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, row and hash of the words, A-Z lower-cased."""
    start, end, row = words(data, offsets)
    return start, end, row, range_hash(prefix_hash(data, lower=True), start, end)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row, the sorted distinct hashes of its k-word shingles.

    A row with fewer words has its whole word sequence as one; a row without words has none.
    """
    _, _, row, h = word_hashes(data, offsets)
    rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    out = []
    if len(h) >= k:
        whole = h[: len(h) - k + 1] * _PLACE[0]
        for j in range(1, k):
            whole = whole + h[j: len(h) - k + 1 + j] * _PLACE[j]
        whole = mix(whole)
    for r in range(rows):
        lo, hi = first[r], first[r + 1]
        if hi - lo >= k:
            out.append(np.unique(whole[lo:hi - k + 1]))
        elif hi > lo:
            few = h[lo:hi] * _PLACE[: hi - lo]
            out.append(mix(few.sum(dtype=np.uint64)[None] + _U(int(hi - lo))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

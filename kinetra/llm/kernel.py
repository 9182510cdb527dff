"""Vectorised word hashing over Arrow text columns, shared by the operators that count words.

A word's 64-bit hash is the wrapped sum of pseudo-random values keyed by (position in word, byte),
mixed with its length; a whole batch is hashed by array operations, without a Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_TABLE_LEN = 48
SLAB = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _keyed(position: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix((position.astype(U) << U(8)) + byte.astype(U) + U(0x9E3779B97F4A7C15))


_KEYS = _keyed(np.repeat(np.arange(_TABLE_LEN), 256), np.tile(np.arange(256), _TABLE_LEN))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column and the rows' offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spans(flat: np.ndarray, offsets: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``split`` does not mark, broken at row offsets."""
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~split[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs, computed slab by slab so that memory stays bounded."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLAB, "right")))
        s, e = starts[at:to], ends[at:to]
        length = e - s
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(int(length.sum())) - np.repeat(begin, length)
        byte = flat[place + np.repeat(s, length)]
        value = _KEYS[np.minimum(place, _TABLE_LEN - 1) * 256 + byte]
        far = np.flatnonzero(place >= _TABLE_LEN)
        if len(far):
            value[far] = _keyed(place[far], byte[far])
        out[at:to] = mix(np.add.reduceat(value, begin) + length.astype(U) * U(0xD6E8FEB86659FD93))
        at = to
    return out


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, bounds): row i has hashes[bounds[i]:bounds[i + 1]]; words are runs without
    space or the bytes 0x09 to 0x0D; ``lower`` folds A-Z only."""
    flat, offsets = text_buffer(column)
    if lower:
        flat = LOWER[flat]
    starts, ends = _spans(flat, offsets, SPACE)
    return span_hashes(flat, starts, ends), np.searchsorted(starts, offsets)


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word runs of one row; with fewer words, of the whole sequence."""
    if not len(w):
        return np.zeros(0, U)
    span = min(k, len(w))
    h = np.full(len(w) - span + 1, U(span), U)
    for i in range(span):
        h = mix(h) + w[i : len(w) - span + 1 + i]
    return np.unique(mix(h))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)

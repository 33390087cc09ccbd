"""Numpy passes over Arrow string columns: bytes, offsets, spans of words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 17  # bytes that one pass holds; a longer text is a slice by itself


def slices(column: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """Parts of a string column with about `size` bytes each."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield column.slice(at, end - at)
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets in them; null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray, separator: int = ord("~")) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes between two separators of one row."""
    at = np.flatnonzero(data == separator)
    row = np.searchsorted(off, at, "right") - 1
    between = (row[1:] == row[:-1]) & (np.diff(at) > 1)
    return at[:-1][between] + 1, at[1:][between], row[:-1][between]


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefix: np.ndarray, mark: bytes) -> pa.Array:
    """The strings of spans, those with `prefix` behind a mark."""
    lead = prefix * len(mark)
    size = end - start + lead
    first = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(int(first[-1])) - np.repeat(first[:-1] - start + lead, size)
    out = data[np.maximum(at, 0)] if len(at) else np.zeros(0, np.uint8)
    marked = first[:-1][prefix]
    for k, c in enumerate(mark):
        out[marked + k] = c
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(first.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out)))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 (fixed constants of a public algorithm)."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span: its bytes as coefficients of a polynomial."""
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    power = mix(np.arange(1, int(size.max()) + 1, dtype=np.uint64)) | np.uint64(1)
    value = (data[place + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)) * power[place]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64))

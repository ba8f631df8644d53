"""Arrow text batches as flat numpy arrays: no Python object for each word.

A batch's texts lie in one UTF-8 buffer. Words are found on its bytes and
dictionary-encoded by Arrow, so that per-word work is done once for each
distinct word of a slice of a few megabytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def only(*ranges: tuple[int, int]) -> np.ndarray:
    """The gaps of words of these bytes (first and last of each range) and of all bytes beyond ASCII."""
    gaps = np.ones(256, bool)
    gaps[128:] = False
    for a, b in ranges:
        gaps[a : b + 1] = False
    return gaps


def unique(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of x in order, and how often each is there."""
    x = np.sort(x)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.r_[first, len(x)])


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: Python workers stay, and the next operator's tasks run beside or in them."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Words(NamedTuple):
    codes: np.ndarray  # position of each word in `distinct`
    offsets: np.ndarray  # documents' first words, and the end
    distinct: pa.BinaryArray
    starts: np.ndarray  # each word's first byte in `data`
    stops: np.ndarray
    data: np.ndarray  # all bytes of the texts


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and each text's first byte, with the end. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices with about `most` bytes of text, or one row. Behind the last, freed memory is given back."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size.astype(np.int64)), 0
        while at < len(size):
            end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            end = max(end, at + 1)
            yield batch.slice(at, end - at)
            at = end
    release()


def words(texts: pa.Array, lower: bool = False, gaps: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that aren't gaps (a table of 256; space and 9 to 13 if none is given), of each text; lower: after A-Z became a-z."""
    data, ends = flat(texts)
    n = len(data)
    if lower:
        data = LOWER[data]
    gap = np.ones(n + 1, bool)
    gap[:n] = gaps[data]
    first = np.zeros(n + 1, bool)
    first[ends] = True
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = gap[:-1]
    starts = np.flatnonzero((before | first)[:n] & ~gap[:n])
    after = gap[1:] | first[1:]
    stops = np.flatnonzero(after & ~gap[:n]) + 1
    offsets = np.searchsorted(starts, ends)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=bounds[1:])
    codes, distinct = _encoded(data[~gap[:n]], bounds)
    return Words(codes, offsets, distinct, starts, stops, data)


def _encoded(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    kind = pa.binary() if bounds[-1] < 2**31 else pa.large_binary()
    bounds = bounds.astype(np.int32 if kind == pa.binary() else np.int64)
    array = pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def hashes(distinct: pa.Array, key: str = "0123456789123456") -> np.ndarray:
    """A keyed 64-bit hash of each of these byte strings; the same on every machine."""
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(distinct.to_numpy(zero_copy_only=False), hash_key=key, categorize=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of all these spans, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)

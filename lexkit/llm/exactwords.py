"""Words of a byte class as Arrow strings, without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lexkit.llm.flatwords import buffer_of

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values belong to a word: all but the given inclusive ranges."""
    inside = np.ones(256, bool)
    for a, b in ranges:
        inside[a:b + 1] = False
    return inside


def word_array(texts: pa.Array, inside: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """(words, first): the runs of ``inside`` bytes of every text with A-Z
    lower-cased; ``first[i]:first[i + 1]`` are the words of text i (null: none).
    Every byte from 0x80 on must be inside, so words are whole characters."""
    data, offsets = buffer_of(texts)
    low = _LOWER[data]
    part = inside[low]
    n = len(part)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    begin, stop = part.copy(), part.copy()
    if n:
        begin[1:] &= ~part[:-1] | border[1:-1]
        stop[:-1] &= ~part[1:] | border[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(low[part]))
    return words, np.searchsorted(start, offsets)

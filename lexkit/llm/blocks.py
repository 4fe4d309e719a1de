"""Number arrays as compact byte blocks for the shuffle."""

from __future__ import annotations

import numpy as np


def planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, all first bytes first: equal bytes stand together,
    which the shuffle's compression needs."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def numbers(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers as the differences of neighbours, in as
    many byte planes as the largest needs (the first byte says how many)."""
    gap = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gap.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + gap.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    width = raw[0]
    part = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    gap = np.zeros((part.shape[1], 8), np.uint8)
    gap[:, :width] = part.T
    return np.cumsum(gap.view(np.uint64).ravel(), dtype=np.uint64)

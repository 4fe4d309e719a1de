"""Vectorised word splitting and hashing over Arrow string batches.

A batch is one flat UTF-8 buffer with document offsets; word borders, word
hashes and n-gram hashes are numpy operations over that buffer, so no Python
object exists per word.  Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z
lower-cased; hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
_WINDOW = 1 << 20
_BYTE = np.random.default_rng(7_919).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = U64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * _WINDOW)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` holding about ``limit`` bytes of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // limit)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as the empty text."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1 + texts.offset)[texts.offset:].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a string array: ``start``/``end`` byte positions in ``data``,
    ``doc`` (row number), ``hash`` (64 bits); ``offsets`` are the rows' borders,
    ``first[i]:first[i + 1]`` the words of row i."""

    def __init__(self, texts: pa.Array, hashed: bool = True):
        self.data, self.offsets = data, offsets = buffer_of(texts)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        border = np.zeros(len(data) + 1, bool)
        border[offsets] = True
        begin, stop = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1] | border[1:-1]
            stop[:-1] &= ~inside[1:] | border[1:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.hash = self.spans(self.start, self.end) if hashed else None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the lower-cased bytes of every span (spans in order of start)."""
        out = np.empty(len(start), U64)
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(start, start[a] + _WINDOW)))
            lo, hi = int(start[a]), int(end[a:b].max())
            part = self.data[lo:hi]
            part = np.where((part >= 65) & (part <= 90), part + 32, part)
            up, down = _power(len(part) + 1)
            total = np.zeros(len(part) + 1, U64)
            np.cumsum(_BYTE[part] * up[:len(part)], dtype=U64, out=total[1:])
            out[a:b] = (total[end[a:b] - lo] - total[start[a:b] - lo]) * down[start[a:b] - lo]
            a = b
        return mix(out)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row number, hash) of every run of ``n`` words inside one row."""
        if len(self.hash) < n:
            return np.empty(0, np.int64), np.empty(0, U64)
        m = len(self.hash) - n + 1
        h = np.zeros(m, U64)
        for k in range(n):
            h = h * _STEP + self.hash[k:k + m]
        ok = self.doc[:m] == self.doc[n - 1:]
        return self.doc[:m][ok], mix(h[ok] + U64(n))


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct ``n``-word shingle hashes of every row; a row with fewer
    words has its whole word sequence as one shingle, a row without words none."""
    w = Words(texts)
    doc, h = w.grams(n)
    first = np.searchsorted(doc, np.arange(len(w.offsets)))
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    out = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    for i in short:
        x = U64(0)
        for v in w.hash[w.first[i]:w.first[i + 1]]:
            x = U64((int(x) * int(_STEP) + int(v)) % 2**64)
        out[i] = mix(np.array([x], U64) + U64(1000 + w.counts[i]))
    return out

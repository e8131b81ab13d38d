"""Vectorised words, shingles and lines of Arrow text columns.

A word is a longest run of bytes other than the six ASCII white-space characters,
so no multi-byte character is ever cut.  All helpers take whole texts; temporary
arrays are bounded by cutting the byte buffer at white space.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
_LONG = 256  # bytes
_SEGMENT = 1 << 20  # bytes of text hashed at once; longer words get a segment of their own
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_CODES = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(20240118).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow that gives freed memory back when a task ends: Python workers outlive their tasks."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim is not None:
                trim(0)

    return whole


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, _SEGMENT + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if isinstance(texts, (list, np.ndarray)):
        texts = pa.array(texts, pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset:].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where runs outside ``gap`` start and end; runs do not cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~gap[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def run_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of every given byte run (sorted, not overlapping).

    Polynomials modulo 2^64 give some strings of over 1,000 letters the same value, whatever
    their base, so runs longer than ``_LONG`` are hashed by xxhash.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        # as many runs as end within one segment, one at least
        j = max(i + 1, int(np.searchsorted(stop, start[i] + _SEGMENT, "right")))
        lo, hi = int(start[i]), int(stop[j - 1])
        up, down = _powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_CODES[data[lo:hi]] * up, out=total[1:])
        a, b = start[i:j] - lo, stop[i:j] - lo
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
        i = j
    out = mixed(out)
    far = np.flatnonzero(stop - start > _LONG)
    out[far] = [xxhash.xxh3_64_intdigest(data[a:b].tobytes()) for a, b in zip(start[far].tolist(), stop[far].tolist())]
    return out


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the offsets of the texts in that array."""
    data, offsets = buffers(texts)
    start, stop = spans(data, offsets)
    return run_hashes(data, start, stop), np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words; a shorter text of one word or more is one shingle."""
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], count)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    left = np.repeat(np.minimum(n, size), count)
    total = np.zeros(len(at), np.uint64)
    for i in range(size):
        term = padded[at + i] * _PLACES[i]
        total += term if i == 0 else np.where(left > i, term, np.uint64(0))
    return mixed(total), ends


def slices(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column of about ``most`` bytes each, one row at least."""
    _, offsets = buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, len(texts))
        i = j

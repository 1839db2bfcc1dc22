"""Vectorised byte and word kernels shared by the text operators.

Everything here works on an Arrow string column seen as one UTF-8 buffer plus
offsets, so a batch of documents costs a handful of numpy passes and no
per-word Python objects.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: A long identifier standing for NULL inside the operators; it sorts last.
NULL_ID = 2**63 - 1
#: Bytes hashed at once: the temporary arrays of a block stay in a core's cache.
BLOCK = 1 << 15

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside words for classifiers: ASCII that is no letter and no digit.
NOT_ALNUM = np.ones(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    NOT_ALNUM[_lo:_hi] = False

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
for _c in range(65, 91):  # A-Z hash as a-z
    _BYTE[_c] = _BYTE[_c + 32]
_BYTE_CASED = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_MUL = _rng.integers(1, 2**63, 16, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its len+1 offsets; null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if "string" in str(arr.type) else b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids(column) -> np.ndarray:
    """A long column as numpy, NULL as NULL_ID."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, U64), np.full(n, _INVERSE, U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, cased: bool = True) -> np.ndarray:
    """64-bit content hashes of raw[start:end) for ascending, non-empty spans that may overlap.

    A polynomial hash by prefix sums, block by block; the few spans that cross
    a block edge are put together from their parts.
    """
    table = _BYTE_CASED if cased else _BYTE
    out = np.zeros(len(start), U64)
    up, down = _powers(BLOCK)
    carried: list[int] = []
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        sums = np.empty(len(part) + 1, U64)
        sums[0] = 0
        np.cumsum(table[part] * up[: len(part)], out=sums[1:])
        top = at + len(part)
        a, b = np.searchsorted(start, [at, top])
        for j in carried:  # begun in an earlier block
            e = min(int(end[j]), top)
            out[j : j + 1] += sums[e - at] * np.full(1, pow(_BASE, at - int(start[j]), 1 << 64), U64)
        carried = [j for j in carried if end[j] > top]
        s, e = start[a:b], end[a:b]
        inside = np.minimum(e, top)
        out[a:b] = (sums[inside - at] - sums[s - at]) * down[s - at]
        carried += (np.flatnonzero(e > top) + a).tolist()
    return mix(out + (end - start).astype(U64) * _MUL[15])


def word_spans(raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (maximal runs outside gap, never across documents), and each document's first word (len+1)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~gap[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = word[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every document's word shingles, with len+1 offsets.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.
    Fewer words than size make one shingle of them all; none make none.
    """
    start, end, first = word_spans(raw, offsets)
    words = span_hashes(raw, start, end, cased=False)
    counts = np.diff(first)
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(int(out_offsets[-1]), U64)
    if len(words) >= size:
        rolling = np.zeros(len(words) - size + 1, U64)
        for k in range(size):
            rolling += words[k : k + len(rolling)] * _MUL[k]
        long = counts >= size
        src = np.repeat(first[:-1][long] - out_offsets[:-1][long], per[long])
        dst = np.flatnonzero(np.repeat(long, per))
        out[dst] = rolling[dst + src]
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        w = words[first[d] : first[d + 1]]
        out[out_offsets[d]] = np.append(w * _MUL[: len(w)], _MUL[8 + len(w)]).sum(dtype=U64)
    return mix(out), out_offsets


def batches(batch, most: int = 4 << 20):
    """Slices of an Arrow batch or table whose text column, named text, holds about most bytes (one row at least)."""
    sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to

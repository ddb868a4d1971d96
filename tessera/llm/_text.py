"""Vectorised words, word hashes and word n-grams of whole Arrow string columns.

A word is a maximal run of bytes outside [\\x20\\x09-\\x0D]. Hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_GRAM = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values (wrapping arithmetic)."""
    x = (x + U(salt & 0xFFFFFFFFFFFFFFFF)).astype(U, copy=False)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U), 0x1234567)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables up to a few chunks are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 4096), base, dtype=U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def chunks(text: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each, at least one row."""
    off = _offsets(text)
    i, n = 0, len(text)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one large_string array; nulls become empty."""
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    return column.fill_null("") if column.null_count else column


def _offsets(text: pa.Array) -> np.ndarray:
    if not len(text):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array and the row offsets into them, starting at 0."""
    off = _offsets(text)
    data = text.buffers()[2] if len(text) else None
    if data is None:
        return np.zeros(0, dtype=np.uint8), off - off[0]
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row the range of its words: (hash, ptr of rows + 1).

    Rows are hashed in chunks, so beside the result it takes memory for one chunk, or for the longest text.
    """
    parts, ptrs, n = [], [np.zeros(1, dtype=np.int64)], 0
    for lo, hi in chunks(text):
        h, ptr = _hashed(text.slice(lo, hi - lo), lower)
        parts.append(h)
        ptrs.append(ptr[1:] + n)
        n += len(h)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=U), np.concatenate(ptrs)


def _hashed(text: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    data, off = raw(text)
    n = len(data)
    if not n:
        return np.zeros(0, dtype=U), np.zeros(len(off), dtype=np.int64)
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    same = word[1:] & word[:-1]
    first[1:] &= ~same
    last[:-1] &= ~same
    cut = off[(off > 0) & (off < n)]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(_BYTES[_FOLDED[data] if lower else data] * powers(_BASE, n), out=total[1:])
    inverse = powers(pow(_BASE, -1, 1 << 64), n)
    h = mix((total[end] - total[start]) * inverse[start], 77) + (end - start).astype(U)
    return mix(h), np.searchsorted(start, off).astype(np.int64)


def grams(h: np.ndarray, ptr: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and the range of each row's.

    short: a row with fewer words, but not without any, has one gram, its whole sequence.
    """
    size = np.diff(ptr)
    if not len(h):
        return h, np.zeros(len(ptr), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    full = (ptr[1:][row] - np.arange(len(h))) >= k
    m = max(0, len(h) - k + 1)
    g = np.zeros(len(h), dtype=U)
    if m:
        acc = h[:m].copy()
        for j in range(1, k):
            acc = acc * _GRAM + h[j : j + m]
        g[:m] = mix(acc, k)
    count = np.maximum(size - k + 1, 0)
    if short:
        for i in np.flatnonzero((size > 0) & (size < k)):
            acc = h[ptr[i] : ptr[i] + 1].copy()
            for j in range(ptr[i] + 1, ptr[i + 1]):
                acc = acc * _GRAM + h[j : j + 1]
            g[ptr[i]] = mix(acc, int(size[i]))[0]
            full[ptr[i]] = True
            count[i] = 1
    out = np.zeros(len(ptr), dtype=np.int64)
    np.cumsum(count, out=out[1:])
    return g[full], out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))

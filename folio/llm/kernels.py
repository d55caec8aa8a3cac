"""numpy kernels over whole Arrow batches of text: words, hashes, n-grams, per-document sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, space
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: lower case, and every ASCII character but letters and digits as a space
LETTERS = np.array([b + 32 if 65 <= b < 91 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], dtype=np.uint8)

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
PIECE = 1 << 21


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and each row's bounds in them; a null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, bounds


def row_pieces(bounds: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes, one row at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche in place."""
    h ^= h >> np.uint64(32)
    h *= _C2
    h ^= h >> np.uint64(29)
    h *= _C3
    h ^= h >> np.uint64(32)
    return h


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of each row, and the rows' bounds among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    solid = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(SPACE[data], out=solid[1:-1])
    first = solid[1:] & ~solid[:-1]  # at i: a word starts at byte i
    last = ~solid[1:] & solid[:-1]  # at i: a word ends before byte i
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    cut = inner[solid[inner] & solid[inner + 1]]  # a word of one row touches a word of the next
    first[cut] = True
    last[cut] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, bounds)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), dtype="<u8", buffer=buf, strides=(1,))
    left = (ends - starts).astype(np.int64)
    h = (left.astype(np.uint64) + np.uint64(seed)) * _C1
    at, todo, part = starts, np.arange(len(starts)), h.copy()
    while len(todo):
        v = view[at]
        short = left < 8
        if short.any():
            v[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        part ^= v
        mix(part)
        h[todo] = part
        more = left > 8
        todo, at, left, part = todo[more], at[more] + 8, left[more] - 8, part[more]
    return h


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, bytes read through the table, and the rows' bounds among them; data holds the rows of
    bounds[0]:bounds[-1]."""
    data = data[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if table is not None:
        data = table[data]
    starts, ends, at = word_spans(data, bounds)
    return hash_spans(data, starts, ends), at


def grams(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each row, and the rows' bounds among them."""
    count = np.maximum(np.diff(at) - n + 1, 0)
    to = np.concatenate([[0], np.cumsum(count)])
    if n == 1:
        return h, at
    if not to[-1]:
        return np.zeros(0, np.uint64), to
    first = np.repeat(at[:-1] - to[:-1], count) + np.arange(to[-1])
    out = h[first] * _C1
    for j in range(1, n):
        out ^= h[first + j]
        mix(out)
        out *= _C1
    return out, to


def pair_hash(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    return mix((a * _C1 + np.uint64(salt)) ^ b)


def row_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of x over the rows' bounds; 0 where a row has nothing. x may have more axes."""
    out = np.zeros((len(at) - 1, *x.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = np.add.reduceat(x, at[full], axis=0, dtype=np.float64)
    return out


def row_counts(kinds: np.ndarray, bounds: np.ndarray, width: int, slab: int = 1 << 18) -> np.ndarray:
    """How often each of `width` kinds occurs in the rows' bounds, a slab of the positions at a time."""
    out = np.zeros((len(bounds) - 1, width), np.int64)
    for lo in range(0, len(kinds), slab):
        hi = min(lo + slab, len(kinds))
        first, last = int(np.searchsorted(bounds, lo, "right")) - 1, int(np.searchsorted(bounds, hi, "left"))
        row = np.repeat(np.arange(last - first), np.diff(np.clip(bounds[first : last + 1], lo, hi)))
        out[first:last] += np.bincount(row * width + kinds[lo:hi], minlength=(last - first) * width).reshape(-1, width)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))

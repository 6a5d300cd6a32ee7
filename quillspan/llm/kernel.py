"""Vectorised text kernel for Arrow batches: words, their hashes and shingles, without a Python loop per word.

Words are ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so the UTF-8 bytes are split directly.
A word's hash is a polynomial over random values of its bytes, read off prefix sums of a whole block of
texts and then mixed; all arithmetic is modulo 2**64. Hashes depend on nothing but the word, so they are
equal on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once: the temporary arrays then fit a processor's cache.
SEGMENT = 1 << 17
#: Bytes of text handled at once; one longer text makes a block of its own.
BLOCK = 1 << 21

_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd multipliers of the words of a shingle, by place.
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], np.uint64)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a text column: first row, row after the last, their bytes, and row offsets into these. A null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs starts[i]:ends[i], which are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        s = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, s + SEGMENT, "right")))
        n = int(ends[j - 1] - s)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data[s : s + n]] * _power(_BASE, n), out=total[1:])
        a = starts[i:j] - s
        out[i:j] = (total[ends[i:j] - s] - total[a]) * _power(_INVERSE, n + 1)[a]
        i = j
    return mix(out)


def _bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True, cut at row offsets."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, word offsets of the rows (one more than rows), and byte starts and ends of the words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    starts, ends = _bounds(~_SPACE[data], offsets)
    return _hash_runs(data, starts, ends, _BYTE_LOWER if lower else _BYTE), np.searchsorted(starts, offsets), starts, ends


def shingles(hashes: np.ndarray, at: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k-word windows in order, window offsets of the rows, and the first word of each window.

    short: a row with 1 to k - 1 words gives its whole sequence as one window, unequal to any longer one.
    """
    n, counts = len(hashes), np.diff(at)
    if n >= k:
        whole = hashes[: n - k + 1] * _PLACE[0]
        for j in range(1, k):
            whole += hashes[j : n - k + 1 + j] * _PLACE[j]
        fits = np.zeros(n + 1, np.int32)
        full = counts >= k
        np.add.at(fits, at[:-1][full], 1)
        np.add.at(fits, at[1:][full] - k + 1, -1)
        first = np.flatnonzero(np.cumsum(fits)[: n - k + 1])
        out = whole[first]
    else:
        first, out = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if short and (few := (counts > 0) & (counts < k)).any():
        more_at, more = [], []
        for size in range(1, k):
            begin = at[:-1][few & (counts == size)]
            x = np.full(len(begin), int(_PLACE[7]) * size % (1 << 64), np.uint64)
            for j in range(size):
                x += hashes[begin + j] * _PLACE[j]
            more_at.append(begin)
            more.append(x)
        first, out = np.concatenate([first, *more_at]), np.concatenate([out, *more])
        order = np.argsort(first, kind="stable")
        first, out = first[order], out[order]
    return mix(out), np.searchsorted(first, at), first


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their offsets."""
    row = row_of(at)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, np.searchsorted(r, np.arange(len(at)))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind != "b" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]

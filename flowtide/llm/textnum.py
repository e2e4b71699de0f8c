"""Vectorised text work on Arrow string columns (no per-row Python strings).

A string column is one UTF-8 byte buffer plus offsets; words, word hashes and
word shingles of all its rows are found with a handful of numpy passes.  Rows
are taken in slices of bounded bytes, so memory does not follow the batch.
Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which never
occur inside a multi-byte UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, dtype=bool)
_STOP[[44, 46]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the one of splitmix64) on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words(buf: np.ndarray, offs: np.ndarray, stops: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row its range of words.

    ``stops``: a full stop or comma after an ASCII letter begins a new word.
    """
    inside = ~_SPACE[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if stops:
        part = _STOP[buf[1:]] & _LETTER[buf[:-1]]
        first[1:] |= part
        last[:-1] |= part
    cuts = offs[(offs > 0) & (offs < len(buf))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word (multilinear in its bytes, then mixed)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int32)
    place -= np.repeat(at.astype(np.int32), lens)
    chars = buf[~_SPACE[buf]].astype(np.uint64)
    chars += np.uint64(1)
    chars *= multipliers(int(lens.max()), 7)[place]
    return mix(np.add.reduceat(chars, at) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(w: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles in order, and each row's range.

    A row of one to ``k - 1`` words gives its whole sequence as one shingle; a
    row without words gives none.
    """
    count = np.diff(rows)
    if not len(w):
        return w, np.zeros(len(rows), np.int64)
    end = np.repeat(rows[1:], count)
    i = np.arange(len(w))
    b = multipliers(k + 1, 11)
    acc = np.zeros(len(w), np.uint64)
    for j in range(min(k, len(w))):
        acc[: len(w) - j] += np.where(i[: len(w) - j] + j < end[: len(w) - j], w[j:] * b[j], np.uint64(0))
    short = count < k
    own = i + k <= end
    lone = rows[:-1][short & (count > 0)]
    own[lone] = True
    acc[lone] += count[short & (count > 0)].astype(np.uint64) * b[k]
    n = np.where(short, np.minimum(count, 1), count - k + 1)
    return mix(acc[own]), np.concatenate([[0], np.cumsum(n)])


def distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, ascending, and their ranges."""
    h = h.copy()
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[rows[:-1][rows[:-1] < len(h)]] = True
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[rows]

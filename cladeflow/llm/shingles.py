"""Vectorised word and shingle hashing over Arrow string columns.

Texts are read from the Arrow buffers as UTF-8 bytes; a word is a maximal run of
bytes other than ``\\x20`` and ``\\x09-\\x0D``, after A-Z are lower-cased. Word and
shingle fingerprints are 64 bits wide, computed with numpy over slices of half a MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; longer single texts are a slice of their own.
SLICE = 512 << 10

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["up"]) < n:
        size = max(n, SLICE + 64)
        with np.errstate(over="ignore"):
            for k, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(size, base, U)
                steps[0] = 1
                _pow[k] = np.cumprod(steps)
    return _pow["up"][:n], _pow["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = x.astype(U, copy=True)
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, rows, bytes, offsets)`` of slices of a string column; null reads as empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, j - i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and row of every word; words never cross rows."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~sep[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(off, s, "right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each byte range ``[s, e)``."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_TABLE[data] * up[:-1], out=total[1:])
        return mix((total[e] - total[s]) * down[s] + (e - s).astype(U))


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and fingerprint of every ``k``-word shingle, and words per row.

    A row of 1 to ``k-1`` words has its whole word sequence as its only shingle.
    """
    rows = len(off) - 1
    s, e, row = words(lower_ascii(data), off)
    count = np.bincount(row, minlength=rows)
    if len(s) == 0:
        return row, np.zeros(0, U), count
    h = word_hashes(lower_ascii(data), s, e)
    with np.errstate(over="ignore"):
        padded = np.concatenate([h, np.zeros(k, U)])
        begin = np.concatenate([[0], np.cumsum(count)])
        place = np.arange(len(h)) - begin[row]
        left = count[row] - place
        out = np.zeros(len(h), U)
        for j in range(k):
            part = padded[j : j + len(h)] * U(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
            out += np.where(left > j, part, U(0))
        keep = (left >= k) | (place == 0)
        return row[keep], mix(out[keep] + np.minimum(left[keep], k).astype(U)), count


def distinct_by_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and fingerprints without repeats, ascending by (row, fingerprint)."""
    if len(h) == 0:
        return row, h
    h = h.copy()
    cuts = np.flatnonzero(np.diff(row)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(h)]]), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]

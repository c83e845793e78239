"""Vectorised word hashing over Arrow string buffers.

Words are hashed where they lie in the buffer, all at once: a polynomial in an
odd base modulo 2**64 over per-byte random numbers, taken from a running sum,
then mixed. Words of more than ``LONG`` bytes are hashed by BLAKE2 instead: a
polynomial modulo a power of two lets some pairs of long words collide for
every base. Python objects are made for these alone. A word that goes on
beyond a piece is carried on, so words of any length count whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a word from which on BLAKE2 is used.
LONG = 64
#: Bytes handled at once; working memory is about 60 times this.
PIECE = 1 << 19

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation but for the marks inside obscured words.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[128:] = False
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    NOT_WORD[_c] = False

_POWERS = np.empty(PIECE + 2, dtype=np.uint64)
_BACK = np.empty(PIECE + 2, dtype=np.uint64)
_POWERS[0] = _BACK[0] = 1
_POWERS[1:] = np.cumprod(np.full(PIECE + 1, _BASE, dtype=np.uint64))
_BACK[1:] = np.cumprod(np.full(PIECE + 1, _INVERSE, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _piece(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, start of each word) of at most PIECE bytes; words also end at ``bounds``."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~breaks[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    starts[cut] = inside[cut]
    begin = np.flatnonzero(starts)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    end = np.flatnonzero(ends) + 1
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _POWERS[: len(data)], out=running[1:])
    hashes = mix((running[end] - running[begin]) * _BACK[begin] + (end - begin).astype(np.uint64))
    for k in np.flatnonzero(end - begin > LONG):
        hashes[k] = _digest(_long(data[begin[k] : end[k]]))
    return hashes, begin


def _long(data: np.ndarray, begun=None):
    """The hash object of a long word's bytes, after those of ``begun``; A-Z count as a-z."""
    begun = hashlib.blake2b(digest_size=8) if begun is None else begun
    begun.update(data.tobytes().lower())
    return begun


def _digest(word) -> int:
    return int.from_bytes(word.digest(), "little")


def _cuts(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Row ranges [a, b) with byte ranges [p, q) of at most PIECE bytes; long rows are cut at break bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1
        if b > a:
            yield a, b, int(offsets[a]), int(offsets[b])
            a = b
            continue
        p, end = int(offsets[a]), int(offsets[a + 1])
        while p < end:
            q = min(p + PIECE, end)
            if q < end:
                back = np.flatnonzero(breaks[data[p:q]])
                q = p + int(back[-1]) + 1 if len(back) else q
            yield a, a + 1, p, q
            p = q
        a += 1


def words(column: pa.Array, breaks: np.ndarray = WHITE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, row of each word) for consecutive groups of rows; A-Z count as a-z."""
    data, offsets = buffers(column)
    held: list[np.ndarray] = []
    open_word = None  # the part of a word that the piece before was
    for a, b, p, q in _cuts(data, offsets, breaks):
        if b > a + 1:
            hashes, begin = _piece(data[p:q], offsets[a : b + 1] - p, breaks)
            yield a, b, hashes, np.searchsorted(offsets[a + 1 : b + 1] - p, begin, "right") + a
            continue
        if open_word is not None:
            ends = np.flatnonzero(breaks[data[p:q]])
            stop = p + int(ends[0]) if len(ends) else q
            open_word = _long(data[p:stop], open_word)
            if stop < q or q == offsets[b]:
                held.append(np.array([_digest(open_word)], np.uint64))
                open_word = None
            p = stop
        if p < q and q < offsets[b] and not breaks[data[q - 1]]:  # nothing but a part of one word
            open_word = _long(data[p:q])
        elif p < q:
            held.append(_piece(data[p:q], np.zeros(0, np.int64), breaks)[0])
        if q == offsets[b]:
            hashes = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held = []
            yield a, b, hashes, np.full(len(hashes), a, dtype=np.int64)


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, row of each) within rows; a row of fewer words gives its whole sequence as one."""
    if not len(hashes):
        return hashes, rows
    weights = np.array([pow(3, 17 * j + 1, 1 << 64) for j in range(n)], dtype=np.uint64)
    out, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) >= n:
        total = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
        for j in range(n):
            total += hashes[j : len(hashes) - n + 1 + j] * weights[j]
        whole = rows[: len(rows) - n + 1] == rows[n - 1 :]
        out, at = mix(total[whole]), rows[: len(rows) - n + 1][whole]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    length = np.diff(np.r_[first, len(rows)])
    short = [(first[k], length[k]) for k in np.flatnonzero(length < n)]
    if short:
        tail = np.array([mix(np.sum(hashes[s : s + c] * weights[:c] + np.uint64(c), keepdims=True))[0] for s, c in short], dtype=np.uint64)
        out, at = np.r_[out, tail], np.r_[at, rows[[s for s, _ in short]]]
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, in order of (row, value)."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], rows[keep]

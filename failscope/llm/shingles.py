"""Hashed word-shingle sets of whole texts, vectorised over Arrow batches.

Words are what lies between ASCII white space, after lower-casing A-Z, so everything is done
on UTF-8 bytes. A word's hash is a polynomial of its bytes modulo 2^64, taken from prefix sums
over a whole block of texts, then mixed; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def seeds(count: int, salt: int) -> np.ndarray:
    """``count`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, count + 1, dtype=_U) * _U(_BASE) + _U(salt)) | _U(1)


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a fixed odd base, and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            column = np.full(size, base, dtype=_U)
            column[0] = 1
            _POWERS[name] = np.multiply.accumulate(column)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and how many words each text has."""
    n = len(data)
    texts = len(bounds) - 1
    if n == 0:
        return np.empty(0, _U), np.zeros(texts, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = bounds[:-1][bounds[:-1] < n]
    begins[firsts] = solid[firsts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    lasts = bounds[1:][bounds[1:] > 0] - 1
    ends[lasts] = solid[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    up, down = powers(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum((lower.astype(_U) + _U(1)) * up, out=sums[1:])
    words = (sums[end] - sums[start]) * down[start]
    words = mix(words ^ ((end - start).astype(_U) * _U(0xD6E8FEB86659FD93)))
    owner = np.searchsorted(bounds, start, side="right") - 1
    return words, np.bincount(owner, minlength=texts)


def _block_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    words, counts = _word_hashes(data, bounds)
    factors = seeds(size, 77)
    if len(words) >= size:
        total = words[: len(words) - size + 1] * factors[0]
        for k in range(1, size):
            total = total + words[k: len(words) - size + 1 + k] * factors[k]
        rolled = mix(total)
    at = 0
    for count in counts.tolist():
        if count >= size:
            yield np.unique(rolled[at: at + count - size + 1])
        elif count:
            short = (words[at: at + count] * factors[:count]).sum(dtype=_U) + _U(count)
            yield mix(np.array([short], _U))
        else:
            yield np.empty(0, _U)
        at += count


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of distinct shingle hashes of each text (null: empty).

    Fewer than ``size`` words make one shingle of the whole sequence; none make no shingle.
    """
    column = texts.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_BYTES, "right")) - 1)
        to = min(to, len(column))
        yield from _block_sets(
            data[bounds[at]: bounds[to]], bounds[at: to + 1] - bounds[at], size)
        at = to

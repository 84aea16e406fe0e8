"""Word hashes of whole Arrow text columns, computed on their UTF-8 bytes without a Python loop.

A word's hash is a polynomial in its bytes (A-Z lower-cased) over random 64-bit byte values, from a
running sum over the slice, then mixed; separators are ASCII, so bytes and code points split alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]
_OTHER = np.random.default_rng(20240301).integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
_OTHER[65:91] = _OTHER[97:123]
#: Two random values a byte, A-Z like a-z, for two independent hashes.
BYTE_TABLES = (_BYTE, _OTHER)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text handled at once, so that the arrays over them stay in a core's cache; a longer text is handled alone.
SLICE = 1 << 16

SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[32, *range(9, 14)]] = True
#: Space and ASCII punctuation.
MARK_BYTES = SPACE_BYTES.copy()
MARK_BYTES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, U(base & (1 << 64) - 1))
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 bounds; null is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, bounds


def slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``SLICE`` bytes together."""
    at, n = 0, len(bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def word_hashes(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``data[bounds[i]:bounds[i + 1]]``, and the words' bounds by text."""
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, back = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    hashes = mix((total[last] - total[first]) * back[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, bounds)


_TURN = np.random.default_rng(11).integers(1, 1 << 63, 64, np.uint64) * U(2) + U(1)


def runs(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash, for each word, of the words at ``offsets`` from it; the tail that has not all is left out."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, U(len(offsets)))
    for k, at in enumerate(offsets):
        out += hashes[at : at + n] * _TURN[k]
    return mix(out)

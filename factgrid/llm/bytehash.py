"""Vectorised hashing of words and byte windows over batches of texts.

A batch of UTF-8 texts is one flat byte array. A polynomial prefix sum over
mixed byte values gives the hash of any byte range with two look-ups, so whole
batches are hashed by a few numpy passes and no per-word Python code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_BYTES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 20)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        got = _powers[base] = np.multiply.accumulate(p)
    return got[:n]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of at most ``limit`` bytes (one row at least).

    Yields ``(first row, bytes, starts)``; ``starts`` has one entry more than
    the run has rows. Null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any byte range."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _power(_STEP, len(data)), out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges ``start``..``end``."""
    back = _power(_BACK, len(c))
    return mix((c[end] - c[start]) * back[start] + (end - start).astype(np.uint64))


def spans(data: np.ndarray, starts: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes not in ``outside`` inside each text, after lower-casing A-Z.

    Returns the lower-cased bytes, the row of each run, and its start and end.
    """
    low = _LOWER[data]
    solid = ~outside[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[starts] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    s = np.flatnonzero(begin)
    e = np.flatnonzero(stop) + 1
    return low, np.searchsorted(starts, s, side="right") - 1, s, e


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text after lower-casing A-Z.

    Returns word hashes, the row of each word, and each word's start and end.
    """
    low, row, s, e = spans(data, starts)
    return span_hash(prefix(low), s, e), row, s, e


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return mix(a * _U(0xD6E8FEB86659FD93) + (b ^ (b >> _U(32))) * _U(0xA5A5A5A5A5A5A5A7) + _U(1))

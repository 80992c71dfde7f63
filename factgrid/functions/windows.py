"""Hashes of all byte windows of a length, and filters of such hashes.

A run of texts is one array of bytes. Prefix sums of random values of the bytes,
each times a power of an odd number, give the hash of any window as a
difference; so all windows of a length take a few numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}
#: Bits of a filter for each hash, bits of a stored block, and of a filter at most (8 MB).
BITS_EACH, BLOCK_LOG2, MOST_LOG2 = 16, 15, 26
#: Bytes of a run of texts: a task's arrays have up to 8 bytes for each of them, a dozen of such arrays at a time.
RUN_BYTES = 1 << 17


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = _powers[base] = np.multiply.accumulate(got)
    return got[:n]


class Windows:
    """Hashes of the windows of a run of texts."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts = data, starts
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * _power(_BASE, len(data)), out=self.sums[1:])
        #: How far each byte's text goes on from it.
        self.left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(data))

    def of(self, size: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places (of ``at``, if given) at which a window of ``size`` bytes lies within its text, and the windows' hashes."""
        at = np.flatnonzero(self.left >= size) if at is None else at[self.left[at] >= size]
        x = (self.sums[at + size] - self.sums[at]) * _power(_BACK, len(self.sums))[at] + _U(size)
        x = (x ^ (x >> _U(32))) * _U(0xBEA225F9EB34556D)
        x = (x ^ (x >> _U(29))) * _U(0xBEA225F9EB34556D)
        return at, x ^ (x >> _U(32))


def runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, starts)`` of runs of rows of at most ``limit`` bytes, one row at least; nulls are empty. No text is copied."""
    if not len(column):
        return
    held = column.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = held.buffers()
    ends = np.frombuffer(ends, np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(held):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


class Filter:
    """A bitmap of hashes: what it does not hold is not there."""

    def __init__(self, log2: int, bits: np.ndarray):
        self.log2, self.bits = log2, bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        a, b = ((x & _U((1 << self.log2) - 1)).astype(np.int64) for x in (h, h >> _U(31)))
        return (self.bits[a >> 3] >> (a & 7).astype(np.uint8) & self.bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def hash_of(column: Column) -> Column:
    """The hash of whole texts or bytes, as ``Windows`` has it for a window with the same bytes."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        out = np.zeros(len(s), np.int64)
        for first, data, starts in runs(pa.array(s.tolist(), pa.binary())):
            w = Windows(data, starts)
            size = np.diff(starts)
            for n in np.unique(size[size > 0]).tolist():
                at, h = w.of(n)
                rows = np.flatnonzero(size == n)
                out[first + rows] = h[np.searchsorted(at, starts[rows])].view(np.int64)
        return pd.Series(out)

    return run(column.cast("binary"))


def filter_of(hashes: DataFrame, count: int) -> Filter:
    """A filter of the column ``h`` of about ``count`` rows, made block by block in Spark; it has at most 8 MB, whatever their number."""
    log2 = min(max((BITS_EACH * count).bit_length(), BLOCK_LOG2), MOST_LOG2)
    all_bits = F.lit((1 << log2) - 1)
    places = F.array(F.col("h").bitwiseAND(all_bits), F.shiftrightunsigned("h", 31).bitwiseAND(all_bits))
    bits = hashes.select(F.explode(places).alias("p"))
    blocks = bits.groupBy(F.shiftright("p", BLOCK_LOG2).alias("b")).agg(F.expr(f"bitmap_construct_agg(p & {(1 << BLOCK_LOG2) - 1})").alias("m"))
    out = np.zeros((1 << (log2 - BLOCK_LOG2), 1 << (BLOCK_LOG2 - 3)), np.uint8)
    for r in blocks.toLocalIterator():  # 4 KB each, 2,048 at most
        out[r["b"]] = np.frombuffer(r["m"], np.uint8)
    return Filter(log2, out.ravel())

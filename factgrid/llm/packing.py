"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Only lengths matter for a packing, and there are at most ``capacity`` of them:
the whole table is reduced to a histogram, the histogram is packed, and every
piece finds its place by its rank among the pieces of its length. For the
longest open length the gap is looked up among single, pair and triple sums of
available lengths and combinations that fill it exactly are used as often as
counts allow; only what no combination fills is placed by best fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoded_batches
from .common import stash

CAPACITY = 1024
END_ID = 2


def _times(pattern: list[int], have: np.ndarray) -> int:
    """How often a pattern can be taken from the counts ``have``."""
    size, need = np.unique(pattern, return_counts=True)
    return int((have[size] // need).min())


class _Sums:
    """Index of single, pair and triple sums of the lengths that are left.

    ``pair[s]`` is the largest length to look at for two lengths with the sum
    ``s``, ``triple[s]`` that for three. Counts only fall, so what cannot be
    filled now cannot be filled later: the entries only move down, and all
    look-ups together read each combination of a sum once.
    """

    def __init__(self, capacity: int):
        self.pair = np.arange(capacity + 1) - 1
        self.triple = np.arange(capacity + 1) - 2

    def find_pair(self, gap: int, have: np.ndarray, note: bool = True) -> list[int] | None:
        b = int(self.pair[gap])
        while 2 * b >= gap > b:
            a = gap - b
            if have[b] > (a == b) and have[a] > 0:
                if note:
                    self.pair[gap] = b
                return [b, a]
            b -= 1
        if note:
            self.pair[gap] = 0
        return None

    def find(self, gap: int, have: np.ndarray) -> list[int] | None:
        """One, two or three lengths of positive count with the sum ``gap``."""
        if have[gap]:
            return [gap]
        if two := self.find_pair(gap, have):
            return two
        c = int(self.triple[gap])
        while 3 * c >= gap and c > 0:
            if have[c] and (two := self.find_pair(gap - c, have)):
                if c in two:  # one less of ``c`` is there for the pair; that is no fall of its count
                    have[c] -= 1
                    two = self.find_pair(gap - c, have, note=False)
                    have[c] += 1
                if two:
                    self.triple[gap] = c
                    return [c, *two]
            c -= 1
        self.triple[gap] = 0
        return None


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence) and how many sequences use each.

    ``counts[l]`` pieces have length ``l``; lengths are 1 to ``capacity``. Every
    step exhausts a length up to less than a pattern's need, so the number of
    patterns is bounded by the capacity and not by the number of pieces. A gap
    that no combination fills exactly takes the largest length that fits, and
    what is left of it is looked up again.
    """
    have = counts.astype(np.int64).copy()
    sums, out = _Sums(capacity), []
    for size in range(capacity, 0, -1):
        while have[size]:
            pattern, gap = [size], capacity - size
            left = have.copy()
            left[size] -= 1
            while gap:
                exact = sums.find(gap, left)
                if exact:
                    pattern += exact
                    break
                fits = np.flatnonzero(left[1 : gap + 1])
                if not len(fits):
                    break
                best = int(fits[-1]) + 1
                pattern.append(best)
                left[best] -= 1  # as the pattern is used at least once, this is no more than what goes
                gap -= best
            n = _times(pattern, have)
            for x in pattern:
                have[x] -= n
            out.append((pattern, n))
    return out


def _places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Per length, ranges of ranks with the sequence and offset of the first rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, n in patterns:
        at = 0
        for x in pattern:
            lo = used.get(x, 0)
            rows.append((x, lo, base, at))
            used[x] = lo + n
            at += x
        base += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "low", "sequence", "offset"), cols))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every text with their rank among the equal lengths of the same task."""

    def run(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch, first, ids, n in encoded_batches(batches, path):
            end = np.cumsum(n)
            ids = np.insert(ids, end, end_id).astype("<u4")
            n = n + 1
            end = np.cumsum(n)
            head = (n - 1) % capacity + 1
            pieces = (n - 1) // capacity + 1
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            at = (end - n)[row] + start
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            order = np.argsort(length, kind="stable")
            size, count = np.unique(length, return_counts=True)
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen[size], count)
            seen[size] += count
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(first + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each text.

    A text is its token ids and ``end_id``; null and empty texts are the end id
    alone. Only texts of more than ``capacity`` ids are cut, the first piece may
    be shorter. Sequences hold at most ``capacity`` ids and are gapless from 0.
    Rows with a null doc_id and repeated rows are packed like any other; an
    empty table gives an empty result; other columns are not read.
    """
    pieces = stash(token_pieces(docs, path, capacity, end_id))
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stash(counts.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r.length] = r.n
    at = _places(pack_histogram(histogram, capacity))

    def place(of_task: pa.Table, first_ranks: pa.Table) -> pa.Table:
        """The pieces of one task of the first pass, with the first rank there of each length."""
        first = np.zeros(capacity + 1, np.int64)
        first[first_ranks["length"].to_numpy()] = first_ranks["first"].to_numpy()
        length = of_task["length"].to_numpy()
        rank = of_task["rank"].to_numpy() + first[length]
        edge = np.searchsorted(at["length"], np.arange(capacity + 2))
        where = np.empty(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            a, b = edge[length[part[0]]], edge[length[part[0]] + 1]
            where[part] = a + np.searchsorted(at["low"][a:b], rank[part], side="right") - 1
        out = of_task.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(at["sequence"][where] + rank - at["low"][where])).append_column("offset", pa.array(at["offset"][where]))

    # a task's pieces and its at most ``capacity`` offsets meet by the task: nothing that grows is broadcast
    dealt = pieces.groupBy("task").cogroup(offsets.select("task", "length", "first").groupBy("task"))
    return dealt.applyInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

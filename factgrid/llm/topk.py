"""Exact top-k by integer inner product with a vector-approximation file.

Every vector is kept twice: exactly in one table, and as quantised cells (one
byte a dimension, scaled to the vector's own range) in pages of another, which
is all that the two searching passes read. Each page meets each block of
queries: the first pass finds the k-th best lower bound of every query, the
second returns the ids whose upper bound reaches it. Only these ids are joined
with their exact vectors, and each query takes them in the order of their bounds
until its k-th result is certain.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Queries of one block and vectors of one page, on average; vectors of a page whose bounds are held at once (16 MB a matrix of a block).
QUERY_BLOCK, PAGE, TILE = 512, 1 << 15, 1 << 12
_LONG = 2**63


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, v`` with v = floor(scale * x) per component, as packed doubles (which hold these integers exactly).

    Rows with a null id or vector, an empty vector, or null or non-finite
    components are left out; so are doubles too large to be scaled.
    """

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.values
                if i is None or x is None or not len(x) or x.null_count:
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * x.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(v).all():
                    ids.append(i)
                    out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return df.select(F.col(id_col).cast("long"), vector).mapInArrow(run, "vec_id long, v binary")


def product(q: np.ndarray, v: np.ndarray) -> int:
    """The exact inner product of two integer vectors held as doubles."""
    if float(np.abs(q) @ np.abs(v)) < 2**52:
        return int(q @ v)
    return sum(int(a) * int(b) for a, b in zip(q.tolist(), v.tolist()))


def cells_of(v: np.ndarray) -> tuple[np.ndarray, int]:
    """Cells ``c`` (int8) and shift ``s``: every component lies from c * 2**s to (c + 1) * 2**s - 1."""
    most = float(np.abs(v).max())
    s = max(0, math.frexp(most)[1] - 7)
    c = np.floor(np.ldexp(v, -s))
    return c.astype(np.int8), s


def _pages(store: DataFrame, k: int) -> DataFrame:
    """One row per page: ids, shifts and cells of its vectors, by vector length.

    Of equal vectors a page keeps those that can be results: k of each id, and
    2 * k in all by id, since a query's own rows are at most k of these.
    """

    def pack(page, rows):
        rows.sort(key=lambda r: (len(r[2]), r[3], r[0]))
        kept, same, own = [], 0, 0
        for n, r in enumerate(rows):
            last = rows[n - 1] if n else None
            if last and (last[2], last[3]) == (r[2], r[3]):
                own = own + 1 if last[0] == r[0] else 0
            else:
                same = own = 0
            if own < k and same < 2 * k:
                kept.append(r)
                same += 1
        for size in sorted({len(r[2]) for r in kept}):
            some = [r for r in kept if len(r[2]) == size]
            yield page, size, np.array([r[0] for r in some]).tobytes(), np.array([r[1] for r in some], np.int32).tobytes(), b"".join(r[2] for r in some)

    def batch_of(out):
        page, size, ids, shifts, cells = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(page, pa.int32()), pa.array(size, pa.int32()), *[pa.array(x, pa.binary()) for x in (ids, shifts, cells)]], names=["page", "dims", "ids", "shifts", "cells"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            for page, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if page != now and held:
                    yield batch_of(list(pack(now, held)))
                    held = []
                now = page
                held.append(row)
        if held:
            yield batch_of(list(pack(now, held)))

    dealt = store.select("page", "vec_id", "shift", "cells", "digest").repartition("page").sortWithinPartitions("page")
    return dealt.mapInArrow(run, "page int, dims int, ids binary, shifts binary, cells binary")


def narrow(q: np.ndarray) -> bytes:
    """Integers held as doubles, in the fewest bytes a value that hold them all (2, 4 or 8)."""
    most = np.abs(q).max(initial=0)
    return q.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64).tobytes()


def wide(b: bytes, n: int, dims: int) -> np.ndarray:
    """What ``narrow`` has packed, as doubles."""
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(b) // (n * dims)]
    return np.frombuffer(b, kind).reshape(n, dims).astype(np.float64)


class _Bounds:
    """Bounds of the products of a block of queries with the vectors of a page, a tile of the page at a time."""

    def __init__(self, ids: bytes, shifts: bytes, cells: bytes, dims: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.unit = np.ldexp(1.0, np.frombuffer(shifts, np.int32).astype(np.int64))
        self.cells = np.frombuffer(cells, np.int8).reshape(-1, dims)

    def _of(self, qids: np.ndarray, q: np.ndarray, side, sign: int):
        # product of the cells' lower corners, what the cells' width adds on this side, and rounding outwards
        wider, size = side(q, 0).sum(axis=1), 1e-12 * q.shape[1] * np.abs(q).sum(axis=1)
        for a in range(0, len(self.ids), TILE):
            unit = self.unit[a : a + TILE]
            bound = q @ (self.cells[a : a + TILE] * unit[:, None]).T
            bound += np.multiply.outer(wider, unit - 1)
            bound += np.multiply.outer(sign * size, 129 * unit)
            bound[qids[:, None] == self.ids[None, a : a + TILE]] = -np.inf  # a query's own id is no candidate
            yield self.ids[a : a + TILE], bound

    def lower(self, qids: np.ndarray, q: np.ndarray):
        """Ids of each tile and lower bounds."""
        return self._of(qids, q, np.minimum, -1)

    def upper(self, qids: np.ndarray, q: np.ndarray):
        """Ids of each tile and upper bounds."""
        return self._of(qids, q, np.maximum, 1)


def _meet(pages: DataFrame, blocks: DataFrame, n_pages: int, answer, schema: str) -> DataFrame:
    """``answer(bounds by dims, block, ids, vectors, floors)`` of every page with every block of queries.

    The blocks are dealt to all pages; a task holds one page and one block of
    one vector length at a time.
    """
    none = F.lit(None).cast("binary")
    left = pages.select("page", F.lit(0).alias("part"), F.lit(0).alias("block"), "dims", "ids", "shifts", "cells", none.alias("floors"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))).alias("page")
    right = blocks.select(every, F.lit(1).alias("part"), "block", "dims", "ids", none.alias("shifts"), F.col("vectors").alias("cells"), "floors")
    dealt = left.unionAll(right).repartition("page").sortWithinPartitions("page", "part", "block")

    def run(batches):
        now, have = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                page, part, block, dims, ids, shifts, cells, floors = (c[i].as_py() for c in batch.columns)
                if page != now:
                    now, have = page, {}
                if not part:
                    have[dims] = _Bounds(ids, shifts, cells, dims)
                elif dims in have:
                    ids = np.frombuffer(ids, np.int64)
                    yield from answer(have[dims], block, ids, wide(cells, len(ids), dims), floors)

    return dealt.mapInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = QUERY_BLOCK, page: int = PAGE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of ``vectors`` for each of ``queries``.

    Both have ``vec_id, v`` from ``integer_vectors``. The score is the integer
    inner product; a query's own id is no candidate; ties go to the smaller
    vec_id; a query with fewer candidates gets all. Only vectors of the
    query's length are candidates. Scores are ranked exactly at any size; one
    that no long can hold is shown as the nearest long. Empty inputs give an
    empty result. Repeated rows of vectors are ranked each; of queries that
    share an id one is answered. Other columns are not read.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    n_pages = max(1, math.ceil(n / page))

    def approximate(batches):
        for batch in batches:
            cells, shifts, digests = [], [], []
            for b in batch.column(1).to_pylist():
                c, s = cells_of(np.frombuffer(b, np.float64))
                cells.append(c.tobytes())
                shifts.append(s)
                digests.append(hashlib.blake2b(b, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shifts, pa.int32()), pa.array(cells, pa.binary()), pa.array(digests, pa.binary())], names=["vec_id", "v", "shift", "cells", "digest"])

    store = vectors.select("vec_id", "v").mapInArrow(approximate, "vec_id long, v binary, shift int, cells binary, digest binary")
    store = stash(store.withColumn("page", F.pmod(F.xxhash64("vec_id"), F.lit(n_pages)).cast("int")))
    pages = stash(_pages(store, k))
    asked = stash(queries.select("vec_id", "v").dropDuplicates(["vec_id"]))
    n_blocks = max(1, math.ceil(asked.count() / block))
    dims = (F.length("v") / 8).cast("int").alias("dims")
    own = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block")
    rows = asked.select(own, dims, "vec_id", "v").groupBy("block", "dims").agg(F.collect_list(F.struct("vec_id", "v")).alias("r"))  # a block

    def pack(batches):
        for batch in batches:
            ids, q = [], []
            for r in batch.column(2).to_pylist():
                ids.append(np.array([x["vec_id"] for x in r]).tobytes())
                q.append(narrow(np.frombuffer(b"".join(x["v"] for x in r), np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(q, pa.binary())], names=["block", "dims", "ids", "vectors"])

    blocks = stash(rows.mapInArrow(pack, "block int, dims int, ids binary, vectors binary"))

    def lows(bounds, block, ids, q, _):
        best = np.full((len(ids), k), -np.inf)
        for _, low in bounds.lower(ids, q):
            low = low if low.shape[1] <= k else -np.partition(-low, k - 1, axis=1)[:, :k]
            best = -np.partition(-np.concatenate((best, low), axis=1), k - 1, axis=1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([q.shape[1]], pa.int32()), pa.array([best.tobytes()], pa.binary())], names=["block", "dims", "lows"])

    def floor(batches):
        best: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, d, low in zip(*(c.to_pylist() for c in batch.columns)):
                low = np.frombuffer(low).reshape(-1, k)
                low = np.concatenate((best[b, d], low), axis=1) if (b, d) in best else low
                best[b, d] = -np.partition(-low, k - 1, axis=1)[:, :k]
        for (b, d), low in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([d], pa.int32()), pa.array([low.min(axis=1).tobytes()], pa.binary())], names=["block", "dims", "floors"])

    first = _meet(pages, blocks.withColumn("floors", F.lit(None).cast("binary")), n_pages, lows, "block int, dims int, lows binary")
    floors = first.repartition("block", "dims").mapInArrow(floor, "block int, dims int, floors binary")

    def candidates(bounds, block, ids, q, floors):
        floors = np.frombuffer(floors)[:, None]
        for page_ids, high in bounds.upper(ids, q):
            # fewer than k vectors leave the floor at minus infinity, where a query's own id is too
            at, which = np.nonzero((high >= floors) & np.isfinite(high))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(page_ids[which]), pa.array(high[at, which])], names=["query_id", "vec_id", "high"])

    found = _meet(pages, blocks.join(stash(floors), ["block", "dims"]), n_pages, candidates, "query_id long, vec_id long, high double")
    # each exact vector is read for those queries only that it may answer; rows that share an id share their greatest bound
    found = found.groupBy("query_id", "vec_id").agg(F.max("high").alias("high"))
    exact = found.join(store.select("vec_id", "v"), "vec_id").select("query_id", "vec_id", "high", "v")
    lead = asked.select(F.col("vec_id").alias("query_id"), F.lit(None).cast("long").alias("vec_id"), F.lit(float("inf")).alias("high"), "v")
    dealt = lead.unionAll(exact).repartition("query_id").sortWithinPartitions("query_id", F.desc("high"), F.col("vec_id").asc_nulls_first())

    def certain(batches):
        now, q, held, done = None, None, [], False

        def out():
            rows = [(now, r + 1, i, max(min(-s, _LONG - 1), -_LONG)) for r, (s, i) in enumerate(held)]
            a, b, c, d = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            vec = batch.column(3)
            for n, (i, j, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if j is None:
                    if held:
                        yield out()
                    now, q, held, done = i, np.frombuffer(vec[n].as_py(), np.float64), [], False
                    continue
                done = done or len(held) == k and high < -held[-1][0]
                if done:
                    continue  # the rest is bounded below the k-th result
                v = np.frombuffer(vec[n].as_py(), np.float64)
                if len(v) == len(q):
                    held.append((-product(q, v), j))
                    held.sort()
                    del held[k:]
        if held:
            yield out()

    return dealt.mapInArrow(certain, "query_id long, rank int, vec_id long, score long")

"""Near-duplicate documents by HyperMinHash registers, banding and full verification.

1. One pass over the texts gives each document its set size, a 128-bit set
   fingerprint and a sketch: per bucket the minimum of a hash over the set is
   kept as its leading-zero count (6 bits) and the next 10 mantissa bits.
2. Documents with equal sets fold into their smallest id before anything else
   is shuffled; a group of copies of any size is one row from there on.
3. Bands of compressed registers give buckets. In each bucket every member is
   paired with the member that shares most buckets and with the smallest id.
   Pairs pass a collision-corrected Jaccard estimate, then a count on full sets.
4. Buckets whose members still lie in different components are given further
   pivots, drawn among their components, which unite most of what belongs
   together. What stays mixed is compared across components, block against
   block, so that no link is lost to the choice of pivots; buckets inside one
   component need no more pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import chunks, mix, pair_hash, words
from .common import connected_components, forget, stash

_U = np.uint64
REGISTERS = 256
#: Members of a bucket that are compared with each other at once, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Rounds of further pivots in mixed buckets.
ROUNDS = 2
MANTISSA = 10
_rng = np.random.default_rng(7)
_MUL = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def compress(low: np.ndarray) -> np.ndarray:
    """Registers (uint16) of minima: leading zeros in the high 6 bits, mantissa in the low 10."""
    top = np.frexp((low >> _U(11)).astype(np.float64))[1]  # exact: 53 bits
    lead = np.where(top > 0, 53 - top, 63).astype(np.uint64)
    place = _U(63) - lead
    shift = np.where(place >= MANTISSA, place - _U(MANTISSA), _U(0))
    return (lead << _U(MANTISSA) | (low >> shift) & _U(2**MANTISSA - 1)).astype(np.uint16)


def sketch(items: np.ndarray, block: int = 1024) -> np.ndarray:
    """The registers of a set of 64-bit hashes."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), block):
        h = items[i : i + block, None] * _MUL + _ADD
        np.minimum(low, h.min(axis=0), out=low)
    return compress(low)


def shingle_sets(column: pa.Array, size: int):
    """Yield ``(row, distinct shingle hashes in order)`` for each text of a column.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a shingle is
    ``size`` words; a text with fewer words is one shingle as a whole.
    """
    for first, data, starts in chunks(column):
        h, row, _, _ = words(data, starts)
        n_rows = len(starts) - 1
        n = np.bincount(row, minlength=n_rows)
        end = np.cumsum(n)
        roll = h
        for k in range(1, size):
            roll = pair_hash(roll[: len(h) - k], h[k:]) if len(h) > k else roll[:0]
        for r in range(n_rows):
            a, b = int(end[r] - n[r]), int(end[r])
            if n[r] >= size:
                got = np.unique(roll[a : b - size + 1])
            elif n[r]:
                one = h[a : a + 1]
                for k in range(a + 1, b):
                    one = pair_hash(one, h[k : k + 1])
                got = mix(one + _U(n[r]))
            else:
                got = h[:0]
            yield first + r, got


@lru_cache(maxsize=4096)
def _chance(a: int, b: int) -> float:
    """Chance that registers of two disjoint sets of about 2**(a/2) and 2**(b/2) items collide."""
    cell = (1 + np.arange(2**MANTISSA) / 2**MANTISSA)[None, :] * 0.5 ** np.arange(1, 50)[:, None]
    width = 0.5 ** (np.arange(1, 50) + MANTISSA)[:, None]
    p = [np.exp(n * np.log1p(-cell)) - np.exp(n * np.log1p(-np.minimum(cell + width, 1 - 1e-16))) for n in (2 ** (a / 2), 2 ** (b / 2))]
    return float((p[0] * p[1]).sum())


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, corrected for chance collisions."""
    same = (x == y).mean(axis=1)
    gx, gy = (np.rint(2 * np.log2(np.maximum(n, 1))).astype(int) for n in (nx, ny))
    chance = np.array([_chance(min(a, b), max(a, b)) for a, b in zip(gx.tolist(), gy.tolist())])
    return (same - chance) / (1 - chance)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def signatures(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, f1, f2, sketch`` of each row, in one pass without a shuffle."""

    def run(batches):
        for batch in batches:
            rows, n, f1, f2, sk = [], [], [], [], []

            def out():
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(sk, pa.binary())],
                    names=["doc_id", "n_shingles", "f1", "f2", "sketch"],
                )

            for r, s in shingle_sets(batch.column(1), size):
                rows.append(r)
                n.append(len(s))
                f1.append(mix(s).sum(dtype=np.uint64))
                f2.append(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                sk.append(sketch(s).tobytes() if len(s) else b"")
            if rows:
                yield out()

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary")


def _buckets(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(1)).astype(np.uint64)
            keys = np.empty((len(m), bands), np.uint64)
            for b in range(bands):
                k = np.full(len(m), b + 1, np.uint64)
                for c in range(b * rows, b * rows + rows):
                    k = mix(k * _U(0x9E3779B97F4A7C15) + m[:, c])
                keys[:, b] = k
            ids = np.repeat(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(m))), pa.array(ids)], names=["bucket", "band", "id"])

    return reps.select("id", "sketch").mapInArrow(run, "bucket long, band int, id long")


def _alike(pairs: DataFrame, reps: DataFrame, threshold: float, slack: float) -> DataFrame:
    """The pairs whose estimate is not far below the threshold."""
    least = threshold - slack * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    s = reps.select("id", "n", "sketch")
    both = pairs.join(s.toDF("a", "na", "sa"), "a").join(s.toDF("b", "nb", "sb"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c = {k: batch.column(k) for k in batch.schema.names}
                j = estimate(_matrix(c["sa"]), _matrix(c["sb"]), c["na"].to_numpy(), c["nb"].to_numpy())
                yield pa.RecordBatch.from_arrays([c["a"], c["b"]], names=["a", "b"]).filter(pa.array(j >= least))

    # a set of under threshold x the other's size cannot reach the threshold
    return both.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).mapInArrow(run, "a long, b long")


def shingle_arrays(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """``id, items`` of each row: its full set of shingle hashes."""

    def run(batches):
        for batch in batches:
            ids, sets, held = [], [], 0
            for r, s in shingle_sets(batch.column(1), size):
                ids.append(r)
                sets.append(s.view(np.int64))
                held += len(s)
                if held > 1 << 19:
                    yield _set_batch(batch, ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield _set_batch(batch, ids, sets)

    return docs.select("doc_id", text).mapInArrow(run, "id long, items array<long>")


def _set_batch(batch, ids, sets):
    edge = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(sets)))], names=["id", "items"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets."""
    both = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    both = both.select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("n"))
    return both.where(F.lit(100) * F.col("n") >= F.lit(percent) * (F.col("nx") + F.col("ny") - F.col("n"))).select("a", "b")


def _small(sets: DataFrame) -> DataFrame:
    """``id, items``: sets of 32-bit hashes; intersections of these are never too small."""

    def run(batches):
        for batch in batches:
            col = batch.column(1)
            out = [np.unique(x.values.to_numpy().astype(np.uint32)).tobytes() for x in col]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "items"])

    return sets.mapInArrow(run, "id long, items binary")


def _mixed(members: DataFrame, reps: DataFrame, comp: DataFrame) -> DataFrame:
    """``bucket, band, id, component, parts`` of the members of buckets that hold several components, in blocks of bounded size."""
    owned = members.select("bucket", "band", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    owned = owned.join(reps.select("id", "n"), "id")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(4 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("parts")
    mixed = owned.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), parts).where("x <> y").select("bucket", "parts")
    return stash(owned.drop("n").join(mixed, "bucket"))


def _united(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` of all nodes when ``links`` (a, b) are added to what ``comp`` holds."""
    first = links.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
    late = connected_components(first.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    old = comp.withColumnRenamed("component", "c").join(late.toDF("c", "to"), "c", "left").select("node", F.coalesce("to", "c").alias("component"))
    # ends of links that had no component of their own
    return old.unionAll(late.join(comp.select("node"), "node", "left_anti")).distinct()


def _across(owned: DataFrame, reps: DataFrame, sets: DataFrame, rows: int, threshold: float, slack: float) -> DataFrame:
    """Pairs of one mixed bucket in different components that may be linked.

    Buckets are cut into blocks and blocks compared pairwise: first on their
    registers, then by sets of short hashes, which can only overstate a
    similarity. A pair is looked at in its first common band only.
    """
    least = threshold - slack * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    body = reps.select("id", "n", "sketch").join(_small(sets.join(owned.select("id").distinct(), "id", "left_semi")), "id")
    cut = owned.join(body, "id")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    cell = ["bucket", "i", "j"]
    dealt = cut.select(*cell, "band", "block", "id", "component", "n", "sketch", "items").repartition(*cell).sortWithinPartitions(*cell)

    def compare(held):
        band = held[0][0]
        block, ids, comps, n = (np.array([r[k] for r in held]) for k in range(1, 5))
        regs = np.frombuffer(b"".join(r[5] for r in held), np.uint16).reshape(len(held), -1)
        lo, hi = block.min(), block.max()
        values, count = np.unique(comps, return_counts=True)
        if len(values) < 2:
            return None
        few = np.flatnonzero(comps != values[count.argmax()])
        a_s, b_s = [], []
        for r in few.tolist():
            may = (comps != comps[r]) & (np.minimum(n, n[r]) >= threshold * np.maximum(n, n[r])) & ((block != block[r]) if lo != hi else True)
            may = np.flatnonzero(may)
            may = may[(regs[may] == regs[r]).mean(axis=1) >= least]
            a_s.append(np.full(len(may), r))
            b_s.append(may)
        a, b = np.concatenate(a_s), np.concatenate(b_s)
        a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
        if not len(a):
            return None
        a, b = np.unique(np.stack((a, b)), axis=1)
        same = regs[a, : band * rows] == regs[b, : band * rows]
        new = ~same.reshape(len(a), band, rows).all(axis=2).any(axis=1) if band else np.ones(len(a), bool)
        new &= estimate(regs[a], regs[b], n[a], n[b]) >= least
        a, b = a[new], b[new]
        linked = np.zeros(len(a), bool)
        items = [np.frombuffer(r[6], np.uint32) for r in held]
        for r in np.unique(a).tolist():
            at = np.flatnonzero(a == r)
            others = [items[k] for k in b[at]]
            size = np.array([len(x) for x in others])
            common = np.add.reduceat(np.isin(np.concatenate(others), items[r]).astype(np.int64), np.cumsum(size) - size)
            linked[at] = common + 1e-9 >= threshold * (len(items[r]) + size - common)
        return ids[a[linked]], ids[b[linked]]

    def run(batches):
        held, now = [], None
        for batch in batches:
            at_s = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for at, row in zip(at_s, zip(*(batch.column(k).to_pylist() for k in range(3, 10)))):
                if at != now:
                    if len(held) > 1 and (got := compare(held)):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["a", "b"])
                    held, now = [], at
                held.append(row)
        if len(held) > 1 and (got := compare(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, slack: float = 4.0, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their
    sets of distinct ``size``-word shingles; ``component_id`` is the smallest
    doc_id reachable and ``kept`` tells whether it is the row's own. Documents
    without words have the empty set and link with nothing. Rows with a null
    doc_id take part in nothing and keep a null component (kept is true). Rows
    that share a doc_id are one node; each gets a row. Other columns are not read.
    """
    full = stash(signatures(docs, size, text))
    linked = full.where("n_shingles > 0 and doc_id is not null")
    reps = stash(linked.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    spread = _buckets(reps, bands, rows)
    busy = spread.groupBy("bucket").agg(F.count("*").alias("c"), F.min("id").alias("low")).where("c > 1")
    members = stash(spread.join(busy, "bucket"))
    weight = members.groupBy("id").agg(F.sum("c").alias("w"))
    pivot = members.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("w", (-F.col("id")).alias("m"))).alias("top")).select("bucket", (-F.col("top.m")).alias("pivot"))
    stars = members.join(pivot, "bucket").select("id", F.explode(F.array("pivot", "low")).alias("to")).where("id <> to")
    pairs = stars.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()
    pairs = stash(_alike(pairs, reps, percent / 100, slack))
    # full sets of all documents that share a bucket; the text is dealt out once
    need = members.select(F.col("id").alias("doc_id")).distinct().hint("merge")
    sets = stash(shingle_arrays(docs.select("doc_id", text).join(need, "doc_id", "left_semi"), size, text))
    edges = stash(_confirm(pairs, sets, percent))
    comp = stash(connected_components(edges))
    for n in range(ROUNDS):
        owned = _mixed(members, reps, comp)
        if owned.isEmpty():
            break
        # a component of the bucket by lot, and its first member: small components are drawn as often as large ones
        drawn = owned.groupBy("bucket").agg(F.max(F.struct(F.xxhash64("component", F.lit(n)).alias("lot"), "component", (-F.col("id")).alias("m"))).alias("d"))
        drawn = drawn.select("bucket", F.col("d.component").alias("own"), (-F.col("d.m")).alias("to"))
        tried = owned.join(drawn, "bucket").where("component <> own").select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()
        more = stash(_confirm(stash(_alike(tried, reps, percent / 100, slack)), sets, percent))
        comp = stash(_united(comp, more))
    owned = _mixed(members, reps, comp)
    more = stash(_across(owned, reps, sets, rows, percent / 100, slack))
    more = stash(_confirm(more, sets, percent))
    comp = stash(_united(comp, more))
    for done in (members, pairs, sets, edges, owned):
        forget(done)
    owner = reps.select("f1", "f2", "id").join(comp.withColumnRenamed("node", "id"), "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component"))
    found = full.select("doc_id", "n_shingles", "f1", "f2").join(owner, ["f1", "f2"], "left")
    cid = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    cid = F.when(F.col("doc_id").isNotNull(), cid)
    return found.select("doc_id", "n_shingles", cid.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Near-duplicate vectors by sorted projection passes.

Every vector gets a concatenation of random hyperplane signs, its hash. In a
pass the ids and hashes of a label, not the vectors, are put in the order of
the hash read from another place, and stand in windows where they share the
first bits there; a window that is too long is compared part against part, so
nothing is left out. Inside a window two ids are candidates if their hashes
differ in few bits and no earlier pass had both in a window. Ids that have a
candidate are then joined with their vectors, which go to the window they were
found in and are compared exactly. A pair is so counted once, and link counts
need no list of pairs: windows give counts and their components, which are
united across passes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stash

#: Rows of one window; two windows are compared in one task at once.
WINDOW = 2048
#: Chance, at most, that all passes miss a pair that lies just at the threshold, and that its hashes differ too much.
MISS = 1e-7
#: Bits of a hash at least, of which passes order by the first ones.
HASH_BITS = 128


def plan(largest: int, cosine: float, window: int = WINDOW, miss: float = MISS) -> tuple[int, int]:
    """Prefix bits and passes for labels of up to ``largest`` vectors."""
    bits = max(0, min(28, math.ceil(math.log2(max(largest, 1) / (window / 2)))))
    keep = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if keep >= 1 else math.ceil(math.log(miss) / math.log(1 - keep))


def reach(bits: int, cosine: float, miss: float = MISS) -> int:
    """Bits in which hashes of two vectors at the threshold may differ."""
    p = math.acos(max(-1.0, min(cosine, 1.0))) / math.pi
    left, far = 0.0, bits
    while far > 0 and 0 < p < 1:
        left += math.exp(math.lgamma(bits + 1) - math.lgamma(far + 1) - math.lgamma(bits - far + 1) + far * math.log(p) + (bits - far) * math.log(1 - p))
        if left > miss:
            break
        far -= 1
    return far if 0 < p < 1 else round(p) * bits


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _rows(v: list[bytes], dims: int) -> np.ndarray:
    """Stored vectors of one length, which are floats, or doubles where floats do not hold them."""
    if all(len(x) == 4 * dims for x in v):
        return np.frombuffer(b"".join(v), np.float32).reshape(-1, dims)
    return np.array([np.frombuffer(x, np.float32 if len(x) == 4 * dims else np.float64) for x in v], np.float64)


def _hash(folded: DataFrame, bits: int, passes: int) -> DataFrame:
    """One row per vector with its hash, and the hash's prefix in each pass."""
    size = max(HASH_BITS, bits * passes)

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors, keys, prefixes, dims = [], [], [], []
            for v in batch.column(3):
                v = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                n = len(v)
                if n not in planes:
                    planes[n] = np.random.default_rng(n).standard_normal((n, size))
                short = v.astype(np.float32)
                vectors.append((short if (short == v).all() else v).tobytes())
                sign = _unit(v[None])[0] @ planes[n] > 0
                keys.append(np.packbits(sign).tobytes())
                prefixes.append((sign[: bits * passes].reshape(passes, bits) << np.arange(bits)[::-1]).sum(axis=1).tolist())
                dims.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(dims, pa.int32()), pa.array(vectors, pa.binary()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.list_(pa.int32())), batch.column(4)],
                names=["label", "rep", "w", "dims", "v", "keys", "prefixes", "at"],
            )

    schema = "label long, rep long, w long, dims int, v binary, keys binary, prefixes array<int>, at long"
    return folded.select("label", "rep", "w", "embedding", "at").mapInArrow(run, schema)


def _numbers(keys: list[bytes], bits: int, passes: int) -> np.ndarray:
    """The prefixes of hashes, by pass."""
    k = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)
    k = np.unpackbits(k, axis=1, count=bits * passes).reshape(len(keys), passes, bits)
    return (k.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=2)


def _sides(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the lower and of the higher part that are compared; both are all rows of a single part."""
    return np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())


def _candidates(block: np.ndarray, keys: list[bytes], t: int, bits: int, passes: int, far: int) -> np.ndarray:
    """Which rows have a candidate that no earlier pass holds."""
    signs = np.unpackbits(np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1), axis=1)
    size = signs.shape[1]
    signs = 2 * signs.astype(np.float32) - 1
    prefix = _numbers(keys, bits, passes)
    one, two = _sides(block)
    same = len(one) == len(two) == len(block)
    found = np.zeros(len(block), bool)
    for k in range(0, len(one), 256):
        a, b = np.nonzero(signs[one[k : k + 256]] @ signs[two].T >= size - 2 * far)
        a, b = one[k + a], two[b]
        if same:
            a, b = a[a < b], b[a < b]
        if t:
            new = ~(prefix[a, :t] == prefix[b, :t]).any(axis=1)
            a, b = a[new], b[new]
        found[a] = found[b] = True
    return found


def _local_components(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        if (new == low).all():
            return low
        low = new


def _compare(rows: list[tuple], t: int, dims: int, bits: int, passes: int, cosine: float):
    """Links of one window (or of one pair of windows) that no earlier pass holds."""
    block = np.array([r[0] for r in rows])
    rep = np.array([r[1] for r in rows])
    w = np.array([r[2] for r in rows])
    x = _unit(_rows([r[3] for r in rows], dims))
    keys = _numbers([r[4] for r in rows], bits, passes)
    one, two = _sides(block)
    same = len(one) == len(two) == len(block)
    n, pairs = np.zeros(len(rows)), []
    for k in range(0, len(one), 256):  # a few rows at a time: all pairs of a dense window would not fit
        a, b = np.nonzero(x[one[k : k + 256]] @ x[two].T >= cosine)
        a, b = one[k + a], two[b]
        if same:
            a, b = a[a < b], b[a < b]
        if t:
            new = ~(keys[a, :t] == keys[b, :t]).any(axis=1)
            a, b = a[new], b[new]
        n += np.bincount(a, w[b], len(rows)) + np.bincount(b, w[a], len(rows))
        pairs.append((a.astype(np.int32), b.astype(np.int32)))
    hit = np.flatnonzero(n)
    if not len(hit):
        return None
    a, b = (np.concatenate(x) for x in zip(*pairs))
    return rep[hit], n[hit].astype(np.int64), _local_components(a, b, rep)[hit]


def near_vectors(df: DataFrame, cosine: float = 0.98, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vec_id, embedding, label``.

    Two vectors are linked when their labels are equal and not null, they have
    the same length and their cosine in double precision is at least ``cosine``.
    Null, empty or zero vectors and those with null or non-finite components
    link with nothing. ``n_links`` counts the other rows linked directly; equal
    vectors are folded first and counted by weight. Rows with a null vec_id link
    with nothing and have a null component. ``miss`` bounds the chance to
    overlook a pair just at the threshold, whatever the number of vectors: once
    for the passes and once for the bits that hashes may differ in.
    """
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = df.select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda c: c.cast("double")).alias("embedding"))
    valid = rows.where(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    folded = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    folded = stash(folded.withColumn("at", F.monotonically_increasing_id()))

    largest = folded.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, passes = plan(largest, cosine, window, miss)
    hashed = stash(_hash(folded, bits, passes))
    run_of = ["t", "label", "dims", "prefix"]
    in_pass = F.posexplode("prefixes").alias("t", "prefix")
    # runs of more than one window; a small table is known to be small by its files
    long = stash(hashed.select("label", "dims", in_pass).groupBy(*run_of).agg(F.ceil(F.count("*") / window).cast("int").alias("parts")).where("parts > 1"))
    cut = hashed.select("label", "dims", "at", "keys", in_pass).join(long, run_of, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("at"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    cell = [*run_of, "i", "j"]
    far = reach(max(HASH_BITS, bits * passes), cosine, miss)
    dealt = cut.select(*cell, "block", "at", "keys").repartition(*cell).sortWithinPartitions(*cell, "keys")

    def windows(batches):
        """Cells with the rest of their rows, each whole."""
        held, now = [], None
        for batch in batches:
            for at, row in zip(zip(*(c.to_pylist() for c in batch.columns[:6])), zip(*(c.to_pylist() for c in batch.columns[6:]))):
                if at != now:
                    if held:
                        yield now, held
                    held, now = [], at
                held.append(row)
        if held:
            yield now, held

    def needed(at, rows):
        """Whether a cell has anything to compare: two rows, of both of its parts."""
        return len(rows) > 1 and (at[4] == at[5] or len({r[0] for r in rows}) > 1)

    def near(batches):
        for at, rows in windows(batches):
            if needed(at, rows):
                block = np.array([r[0] for r in rows])
                hit = np.flatnonzero(_candidates(block, [r[2] for r in rows], at[0], bits, passes, far))
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x] * len(hit), k) for x, k in zip(at, types)] + [pa.array(block[hit], pa.int32()), pa.array([rows[h][1] for h in hit], pa.int64())],
                        names=[*cell, "block", "at"],
                    )

    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    found = dealt.mapInArrow(near, "t int, label long, dims int, prefix int, i int, j int, block int, at long")
    # only ids with a candidate take their vector along, to the windows where it has one
    found = stash(found).join(hashed.select("at", "rep", "w", "v", "keys"), "at")
    found = found.select(*cell, "block", "rep", "w", "v", "keys").repartition(*cell).sortWithinPartitions(*cell)

    def compare(batches):
        for at, rows in windows(batches):
            if needed(at, rows) and (got := _compare(rows, at[0], at[2], bits, passes, cosine)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["rep", "n", "low"])

    links = stash(found.mapInArrow(compare, "rep long, n long, low long"))
    n_links = links.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    per_rep = folded.join(n_links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    per_rep = per_rep.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    ok = valid.join(per_rep, ["label", "embedding"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    rest = rows.where(~F.coalesce(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ok.unionAll(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counting: each task folds the tokens and token pairs of its texts into sorted
(hash, count) blobs, one per bucket of the hash space, so that what is shuffled
of a frequent token is one entry per blob. The task that gets a bucket adds the
counts up and writes (a) the exact unigram counts of the bucket and (b) the
bucket's segment of the filter: an n-gram of count c is inserted once for each
level 1 .. 1 + floor(log_BASE c), and its quantised count is read back by
probing level after level until one is absent. A segment has ``BITS_EACH`` bits
or more for each of its insertions, so that every n-gram of the corpus is held.
While every segment fits its share of what the session lets Spark broadcast, the
filter is broadcast; when one does not, no segment is, and the n-grams of the
texts go to the bucket with their segment. Both ways read the same segments and
give the same scores. A bounded table of the most frequent tokens is always
broadcast.

Scoring: frequent tokens have exact counts in that table; the other tokens of a
text go, again as blobs, to the bucket with their exact counts, from where
partial sums return to the text. Where segments are not broadcast, the distinct
n-grams of each run of texts go to their buckets too, and their levels return to
the run's bytes, which are read again to put them together.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import chunks, mix, pair_hash, words
from .common import stash

_U = np.uint64
#: Bits of a filter that is broadcast, where the session sets no bound.
FILTER_LOG2 = 26
BITS_EACH = 8
PROBES = 4
BASE = 1.5
#: Most frequent tokens whose exact counts are broadcast (16 bytes each).
HEAD = 1 << 17
#: Pseudo-count of the unigram model behind each pair estimate.
MU = 400.0
_END, _START = (mix(np.array([x], np.uint64))[0] for x in (11, 12))
#: Tokens folded into one set of blobs.
_FOLD = 2_000_000
#: Texts whose partial sums travel as one row.
_BLOCK_LOG2 = 12
#: Bytes of texts whose distinct n-grams are asked together, where segments are not broadcast.
_RUN = 4 << 20
#: Bytes of a pair's key inside its bucket: a bucket of n pairs takes a share of n / 2**32 for others, a filter a fortieth.
_KEY = 4


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of integers, byte plane by byte plane (these compress well)."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    n = len(b) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def steps(x: np.ndarray, width: int) -> bytes:
    """Ascending integers as ``planes`` of their differences."""
    return planes(np.diff(x, prepend=_U(0)), width)


def unsteps(b: bytes, width: int) -> np.ndarray:
    return np.cumsum(unplanes(b, width), dtype=np.uint64)


def _bucket(h: np.ndarray, log2: int) -> np.ndarray:
    return (h >> _U(64 - log2)).astype(np.int64)


def tokens(data: np.ndarray, starts: np.ndarray):
    """Token hashes with their rows and the hashes before them: words, then one end, of each text."""
    h, row, _, _ = words(data, starts)
    n = len(starts) - 1
    count = np.bincount(row, minlength=n)
    end = np.cumsum(count + 1)
    out = np.empty(len(h) + n, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[end - 1] = True
    out[~is_end] = h
    out[is_end] = _END
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[end - count - 1] = _START
    return out, np.repeat(np.arange(n), count + 1), before


def run_tokens(data: np.ndarray, starts: np.ndarray):
    """``tokens`` of a run of texts, read about 1 MB at a time."""
    out, first = [], 0
    while first < len(starts) - 1:
        last = max(int(np.searchsorted(starts, starts[first] + (1 << 20), side="right")) - 1, first + 1)
        last = min(last, len(starts) - 1)
        h, row, before = tokens(data[starts[first] : starts[last]], starts[first : last + 1] - starts[first])
        out.append((h, row + first, before))
        first = last
    return tuple(np.concatenate(x) for x in zip(*out))


def _fold(h: np.ndarray, log2: int, kind: int):
    """Blobs of the distinct hashes and their counts, one per bucket."""
    keys, n = np.unique(h, return_counts=True)
    edge = np.searchsorted(_bucket(keys, log2), np.arange((1 << log2) + 1))
    keys, width = (short(keys, log2), _KEY) if kind else (keys, 8)
    for b in np.flatnonzero(np.diff(edge)).tolist():
        part = slice(edge[b], edge[b + 1])
        yield b, kind, steps(keys[part], width), planes(n[part], 4)


def _blobs(rows) -> pa.RecordBatch:
    b, k, keys, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())], names=["bucket", "kind", "keys", "counts"])


def short(h: np.ndarray, log2: int) -> np.ndarray:
    """The 32 bits below the bucket of a pair's hash: its key inside the bucket, in the order of the hashes."""
    return (h >> _U(64 - 8 * _KEY - log2)) & _U((1 << 8 * _KEY) - 1)


class Segment:
    """Log-frequency Bloom filter of one bucket."""

    @staticmethod
    def places(key: np.ndarray, level: np.ndarray | int, bits: int):
        x = mix(key * _U(0x9E3779B97F4A7C15) + np.asarray(level, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))
        step = (x >> _U(33)) | _U(1)
        for _ in range(PROBES):
            yield (x & _U(bits - 1)).astype(np.int64)
            x = x + step

    @staticmethod
    def level(n: np.ndarray) -> np.ndarray:
        """Insertions of an n-gram of count ``n``."""
        return 1 + np.floor(np.log(np.maximum(n, 1)) / math.log(BASE) + 1e-9).astype(np.int64)

    @classmethod
    def size(cls, parts: list[tuple[np.ndarray, np.ndarray]], least: int) -> int:
        """Bits, a power of two from ``least`` on, that hold all n-grams."""
        need = BITS_EACH * sum(int(cls.level(n).sum()) for _, n in parts)
        return max(least, 1 << max(need - 1, 0).bit_length())

    @classmethod
    def build(cls, parts: list[tuple[np.ndarray, np.ndarray]], bits: int) -> tuple[bytes, int]:
        """Bytes of a segment, and the least pair count it holds; earlier parts have priority."""
        seg = np.zeros(bits, bool)
        room, cut = bits // BITS_EACH, 1
        for key, n in parts:
            level = cls.level(n)
            need = np.bincount(level, level)[::-1].cumsum()[::-1]  # insertions of this level and above
            fit = np.flatnonzero(need <= room)
            least = int(fit[0]) if len(fit) else len(need)
            take = level >= least
            room -= int(level[take].sum())
            cut = max(cut, math.ceil(BASE ** (least - 1) - 1e-9))
            key, level = key[take], level[take]
            for lv in range(1, int(level.max(initial=0)) + 1):
                key, level = key[level >= lv], level[level >= lv]
                for at in cls.places(key, lv, bits):
                    seg[at] = True
        return np.packbits(seg, bitorder="little").tobytes(), cut


def levels(filter_bytes: np.ndarray, bucket: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """Count levels (0: absent) by repeated membership probes."""
    level = np.zeros(len(key), np.int64)
    left = np.arange(len(key))
    base = bucket * bits
    lv = 0
    while len(left):
        lv += 1
        k, b, live = key[left], base[left], None
        for at in Segment.places(k, lv, bits):
            p = at + b if live is None else at[live] + b[live]
            hit = (filter_bytes[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
            live = np.flatnonzero(hit) if live is None else live[hit]
            if not len(live):
                break
        left = left[live]
        level[left] = lv
    return level


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level."""
    low, high = np.ceil(BASE ** (level - 1.0) - 1e-9), np.ceil(BASE ** level.astype(float) - 1e-9) - 1
    return np.where(level > 0, (low + np.maximum(high, low)) / 2, 0.0)


def probe(filter_bytes: np.ndarray, bucket: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """Quantised counts (0: absent)."""
    return middle(levels(filter_bytes, bucket, key, bits))


def count_ngrams(train: DataFrame, log2: int, bits: int) -> DataFrame:
    """Exact unigram counts (kind 0) and filter segments (kind 2, ``bits`` or more each) of all training texts, by bucket."""

    def fold(batches):
        held, n = [], 0

        def flush():
            for kind in (1, 0):
                some = np.concatenate([x[kind] for x in held])
                held[:] = [(x[0], None) for x in held] if kind else []  # what is folded needs no room any more
                rows = list(_fold(some, log2, kind))
                for i in range(0, len(rows), 256):
                    yield _blobs(rows[i : i + 256])

        for batch in batches:
            for _, data, starts in chunks(batch.column(0)):
                h, _, before = tokens(data, starts)
                held.append((h, pair_hash(before, h)))
                n += len(h)
                if n >= _FOLD:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def add(parts):
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        return keys[head], np.add.reduceat(n, head) if len(keys) else n

    def gather(batches):
        got: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for b, k, keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                got.setdefault(b, ([], []))[k].append((unsteps(keys, _KEY if k else 8), unplanes(n, 4).astype(np.int64)))
        for b in sorted(got):
            one, two = got.pop(b)
            out, parts = [], []
            if one:
                keys, n = add(one)
                out.append((b, 0, steps(keys, 8), planes(n, 8)))
                parts.append((short(keys, log2), n))
            if two:
                parts.append(add(two))
            seg, _ = Segment.build(parts, Segment.size(parts, bits))  # holds all, so nothing is cut
            out.append((b, 2, seg, b""))
            yield _blobs(out)

    schema = "bucket int, kind int, keys binary, counts binary"
    return train.select("text").mapInArrow(fold, schema).repartition("bucket").mapInArrow(gather, schema)


def _broadcast_log2(spark) -> int:
    """Bits, as a power of two, of a filter within the session's bound for broadcast tables; 16 at least."""
    said = spark.conf.get("spark.sql.autoBroadcastJoinThreshold") or ""
    got = re.fullmatch(r"\s*(-?\d+)\s*([kmgt]?)i?b?\s*", said.lower())
    if not got:
        return FILTER_LOG2
    size = max(int(got[1]), 0) << 10 * " kmgt".index(got[2] or " ")
    return min(max((8 * size).bit_length() - 1, 16), 32)


def score_texts(docs: DataFrame, held_out, filter_log2: int | None = None, mu: float = MU, head: int = HEAD, spread: bool | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    ``held_out`` is a column; rows where it is not true are learned from. Tokens
    are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end.
    ``base_score`` is the sum of log10((c + 1) / (N + V + 1)) with exact counts;
    ``score`` the log10 probability under pair counts from the filter smoothed
    by the unigram model. Null texts are empty (one token). Rows with a null
    doc_id count as training rows; repeated rows are scored each. An empty
    table gives an empty result. Other columns are not read. ``spread`` says
    whether segments stay in their buckets (by default, when one outgrows its
    share of ``2**filter_log2`` bits, which are as many as the session's bound
    for broadcast tables allows); scores do not depend on it.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    log2 = max(6, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    log2 = min(log2, 16)
    filter_log2 = _broadcast_log2(spark) if filter_log2 is None else filter_log2
    bits = 1 << (filter_log2 - log2)
    grams = stash(count_ngrams(rows.where(~F.col("held_out")), log2, bits))
    unigrams = grams.where("kind = 0")

    def totals(batches):
        for batch in batches:
            n = [unplanes(x, 8).astype(np.int64) for x in batch.column(1).to_pylist()]
            ends = sum(int(c[unsteps(k, 8) == _END].sum()) for k, c in zip(batch.column(0).to_pylist(), n))
            # how many tokens have each count level, to find the head's least count
            level = np.bincount(np.log2(np.concatenate([*n, np.ones(0, int)])).astype(np.int64) if n else [], minlength=63)
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(x.sum()) for x in n)], pa.int64()), pa.array([sum(map(len, n))], pa.int64()), pa.array([ends], pa.int64()), pa.array([level.tolist()], pa.list_(pa.int64()))], names=["n", "v", "ends", "level"])

    t = unigrams.select("keys", "counts").mapInArrow(totals, "n long, v long, ends long, level array<long>")
    total = t.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "ends")], *[F.sum(F.get("level", F.lit(k))).alias(f"l{k}") for k in range(63)]).first()
    n_all, n_types, n_texts = int(total.n), int(total.v), float(total.ends)
    least, have = 63, 0
    while least and have + (total[f"l{least - 1}"] or 0) <= head:
        least -= 1
        have += total[f"l{least}"] or 0

    def frequent(batches):
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, n = unsteps(keys, 8), unplanes(n, 8)
                top = n >= _U(1 << least)
                yield pa.RecordBatch.from_arrays([pa.array([steps(keys[top], 8)], pa.binary()), pa.array([planes(n[top], 8)], pa.binary())], names=["keys", "counts"])

    largest = grams.where("kind = 2").agg(F.coalesce(F.max(F.length("keys")), F.lit(0))).first()[0]
    if spread is None or largest > bits // 8:
        spread = largest > bits // 8
    # bounded: at most ``head`` tokens, and 2**filter_log2 bits or none
    got = unigrams.select("keys", "counts").mapInArrow(frequent, "keys binary, counts binary").collect()
    keys = np.concatenate([unsteps(r.keys, 8) for r in got] + [np.zeros(0, np.uint64)])
    counts = np.concatenate([unplanes(r.counts, 8) for r in got] + [np.zeros(0, np.uint64)]).astype(np.int64)
    order = np.argsort(keys)
    whole = np.zeros(0 if spread else (1 << filter_log2) // 8, np.uint8)
    for r in [] if spread else grams.where("kind = 2").select("bucket", "keys").toLocalIterator():
        whole[r.bucket * (bits // 8) : (r.bucket + 1) * (bits // 8)] = np.frombuffer(r["keys"], np.uint8)
    shared = spark.sparkContext.broadcast((whole, keys[order], counts[order]))
    del whole
    norm = float(n_all + n_types + 1)

    def exact_counts(u):
        """Whether tokens are in the broadcast table, and their counts there."""
        _, hkeys, hcounts = shared.value
        at = np.minimum(np.searchsorted(hkeys, u), max(len(hkeys) - 1, 0))
        known = hkeys[at] == u if len(hkeys) else np.zeros(len(u), bool)
        c = np.zeros(len(u))
        c[known] = hcounts[at[known]]
        return known, c

    def joined(h, row, before, own, pair, n):
        """Log probabilities of the texts from the counts of their tokens and pairs."""
        prior = np.empty(len(h))
        prior[1:] = own[:-1]
        prior[before == _START] = n_texts  # a text begins as often as one ends
        pair = np.minimum(pair, np.minimum(prior, np.maximum(own, 0)))
        return np.bincount(row, np.log10((pair + mu * (own + 1) / norm) / (prior + mu)), n)

    def score(batches):
        filt = shared.value[0]
        uid = TaskContext.get().partitionId() << 40
        names = ["kind", "bucket", "uid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "keys", "rows", "counts"]
        run = []

        def text_run(run):
            """A row with the bytes of a run of texts, whose uids follow each other."""
            size = np.cumsum([0, *(len(d) for _, d, _ in run)])
            data = np.concatenate([d for _, d, _ in run]).tobytes()
            starts = np.concatenate([np.zeros(1, np.int64), *(x[1:] + o for (_, _, x), o in zip(run, size))])
            null = [pa.nulls(1, x) for x in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays(
                [pa.array([3], pa.int32()), pa.nulls(1, pa.int32()), pa.array([run[0][0]], pa.int64()), *null, pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary()), pa.array([starts.astype("<i8").tobytes()], pa.binary()), pa.nulls(1, pa.binary())],
                names=names,
            )

        for batch in batches:
            for first, data, starts in chunks(batch.column(1)):
                h, row, before = tokens(data, starts)
                n = len(starts) - 1
                u, inv = np.unique(h, return_inverse=True)
                known, c = exact_counts(u)
                two = pair_hash(before, h)
                if spread:
                    logp = np.zeros(n)
                else:
                    est = c.copy()
                    est[~known] = probe(filt, _bucket(u[~known], log2), short(u[~known], log2), bits)
                    logp = joined(h, row, before, est[inv], probe(filt, _bucket(two, log2), short(two, log2), bits), n)
                exact = known[inv]
                base = np.bincount(row[exact], np.log10((c[inv[exact]] + 1) / norm), n)
                ids = np.arange(uid, uid + n)
                uid += n
                z = n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(z, np.int32)), pa.nulls(z, pa.int32()), pa.array(ids), batch.column(0).slice(first, n), batch.column(2).slice(first, n),
                     pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row[exact], minlength=n)), pa.array(base), pa.array(logp), pa.nulls(z, pa.binary()), pa.nulls(z, pa.binary()), pa.nulls(z, pa.binary())],
                    names=names,
                )
                if spread:
                    run.append((ids[0], data, starts))
                    if sum(len(d) for _, d, _ in run) >= _RUN:
                        yield text_run(run)
                        run = []
                # the rest: distinct (token, text) with multiplicity, to where exact counts are
                token, text = inv[~exact], row[~exact]
                if not len(token):
                    continue
                code, mult = np.unique(token * n + text, return_counts=True)
                k, r = u[code // n], ids[code % n]
                edge = np.searchsorted(_bucket(k, log2), np.arange((1 << log2) + 1))
                full = np.flatnonzero(np.diff(edge)).tolist()
                cut = [slice(edge[b], edge[b + 1]) for b in full]
                z = len(full)
                null = [pa.nulls(z, x) for x in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(z, np.int32)), pa.array(full, pa.int32()), *null, pa.array([steps(k[s], 8) for s in cut], pa.binary()), pa.array([planes(r[s], 8) for s in cut], pa.binary()), pa.array([planes(mult[s], 4) for s in cut], pa.binary())],
                    names=names,
                )
        if run:
            yield text_run(run)

    schema = "kind int, bucket int, uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, keys binary, rows binary, counts binary"
    scored = stash(rows.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(score, schema))
    asked = scored.where("kind = 1").select("bucket", "kind", "keys", "rows", "counts")
    both = unigrams.select("bucket", F.lit(0).alias("kind"), "keys", F.lit(None).cast("binary").alias("rows"), "counts").unionAll(asked)

    def answer(batches):
        have, ask, sums = [], [], []
        for batch in batches:
            for _, kind, keys, r, n in zip(*(c.to_pylist() for c in batch.columns)):
                (ask if kind else have).append((keys, r, n))
        keys = np.concatenate([unsteps(k, 8) for k, _, _ in have] + [np.zeros(0, np.uint64)])
        counts = np.concatenate([unplanes(n, 8) for _, _, n in have] + [np.zeros(0, np.uint64)]).astype(np.float64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        for i in range(0, len(ask), 4096):
            part = ask[i : i + 4096]
            k = np.concatenate([unsteps(x, 8) for x, _, _ in part])
            r = np.concatenate([unplanes(x, 8) for _, x, _ in part]).astype(np.int64)
            m = np.concatenate([unplanes(x, 4) for _, _, x in part]).astype(np.float64)
            at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
            c = np.where(keys[at] == k, counts[at], 0.0) if len(keys) else np.zeros(len(k))
            ids, inv = np.unique(r, return_inverse=True)
            sums.append((ids, np.bincount(inv, m * np.log10((c + 1) / norm), len(ids)), np.bincount(inv, m * (c > 0), len(ids))))
        # one row of partial sums for each block of texts
        ids, inv = np.unique(np.concatenate([x[0] for x in sums] + [np.zeros(0, np.int64)]), return_inverse=True)
        more, also = (np.bincount(inv, np.concatenate([x[k] for x in sums] + [np.zeros(0)]), len(ids)) for k in (1, 2))
        blocks, at = np.unique(ids >> _BLOCK_LOG2, return_index=True)
        cut = list(zip(at.tolist(), [*at[1:].tolist(), len(ids)]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), *[pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in (ids, more, also)]],
            names=["block", "uids", "more", "also"],
        )

    def unite(batches):
        got: dict[int, np.ndarray] = {}
        size = 1 << _BLOCK_LOG2
        for batch in batches:
            for block, u, m, k in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(u, np.int64) - (block << _BLOCK_LOG2)
                held = got.setdefault(block, np.zeros((2, size)))
                held[0, at] += np.frombuffer(m)
                held[1, at] += np.frombuffer(k)
        for block, held in got.items():
            at = np.flatnonzero(held[0])
            yield pa.RecordBatch.from_arrays([pa.array((block << _BLOCK_LOG2) + at), pa.array(held[0, at]), pa.array(held[1, at].astype(np.int64))], names=["uid", "more", "also"])

    def read(data, starts):
        """Tokens of a run, and the distinct n-grams that segments are asked for."""
        starts = np.frombuffer(starts, "<i8").astype(np.int64)
        data = np.frombuffer(pa.decompress(data, int(starts[-1]), "zstd", asbytes=True) if starts[-1] else b"", np.uint8)
        h, row, before = run_tokens(data, starts)
        u, inv = np.unique(h, return_inverse=True)
        known, own = exact_counts(u)
        two = pair_hash(before, h)
        return len(starts) - 1, h, row, before, u, inv, known, own, two, np.unique(np.concatenate((u[~known], two)))

    def ask(batches):
        for batch in batches:
            for uid, data, starts in zip(*(c.to_pylist() for c in batch.columns)):
                k = read(data, starts)[-1]
                edge = np.searchsorted(_bucket(k, log2), np.arange((1 << log2) + 1))
                full = np.flatnonzero(np.diff(edge)).tolist()
                keys = [steps(short(k[edge[b] : edge[b + 1]], log2), _KEY) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), uid)), pa.array(np.ones(len(full), np.int32)), pa.array(keys, pa.binary())], names=["bucket", "uid", "part", "keys"])

    def look(batches):
        """Levels of what is asked of each segment, which comes before its questions."""
        own, seg = None, None
        for batch in batches:
            bucket, uid, part, keys = (c.to_pylist() for c in batch.columns)
            i = 0
            while i < len(bucket):
                if not part[i]:
                    own, seg = bucket[i], np.frombuffer(keys[i], np.uint8)
                    i += 1
                    continue
                j = i
                while j < len(bucket) and bucket[j] == bucket[i] and part[j]:
                    j += 1
                k = [unsteps(x, _KEY) for x in keys[i:j]]
                edge = np.cumsum([0, *map(len, k)])
                k = np.concatenate(k)
                # a bucket without a segment has no n-gram of the training texts
                got = levels(seg, np.zeros(len(k), np.int64), k, 8 * len(seg)) if own == bucket[i] else np.zeros(len(k), np.int64)
                got = got.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[i:j], pa.int64()), pa.array(bucket[i:j], pa.int32()), pa.array([pa.compress(got[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(edge[:-1], edge[1:])], pa.binary()), pa.array(np.diff(edge), pa.int64())],
                    names=["uid", "bucket", "keys", "size"],
                )
                i = j

    def finish(batches):
        """Scores of runs of texts, whose bytes come before the levels, bucket by bucket."""

        def one(uid, data, starts, got):
            n, h, row, before, u, inv, known, own, two, k = read(data, starts)
            count = middle(np.frombuffer(b"".join(got), np.uint8).astype(np.int64))
            own[~known] = count[np.searchsorted(k, u[~known])]
            logp = joined(h, row, before, own[inv], count[np.searchsorted(k, two)], n)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + n)), pa.array(logp)], names=["uid", "spread"])

        held = None
        for batch in batches:
            for uid, bucket, keys, starts, size in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket < 0:
                    if held:
                        yield one(*held)
                    held = (uid, keys, starts, [])
                else:
                    held[3].append(pa.decompress(keys, size, "zstd", asbytes=True))
        if held:
            yield one(*held)

    partial = both.repartition("bucket").mapInArrow(answer, "block long, uids binary, more binary, also binary")
    rest = partial.repartition("block").mapInArrow(unite, "uid long, more double, also long")
    out = scored.where("kind = 0").select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "score").join(rest, "uid", "left")
    if spread:
        texts = scored.where("kind = 3")
        none = F.lit(None).cast("binary").alias("rows")
        probes = grams.where("kind = 2").select("bucket", F.lit(0).cast("long").alias("uid"), F.lit(0).alias("part"), "keys")
        probes = probes.unionAll(texts.select("uid", "keys", "rows").mapInArrow(ask, "bucket int, uid long, part int, keys binary"))
        found = probes.repartition("bucket").sortWithinPartitions("bucket", "part").mapInArrow(look, "uid long, bucket int, keys binary, size long")
        runs = texts.select("uid", F.lit(-1).alias("bucket"), "keys", "rows", F.lit(0).cast("long").alias("size")).unionAll(found.select("uid", "bucket", "keys", none, "size"))
        ends = runs.repartition("uid").sortWithinPartitions("uid", "bucket").mapInArrow(finish, "uid long, spread double")
        out = out.drop("score").join(ends.withColumnRenamed("spread", "score"), "uid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def by_seventh(doc_id: str = "doc_id"):
    """Held out: crc32(doc_id as text) mod 7 is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2

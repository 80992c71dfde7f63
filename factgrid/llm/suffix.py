"""Removal of bytes covered by strings that start in an earlier document.

Every 50-byte window of a text has a least 20-byte hash, its anchor; equal
windows have equal anchors, so windows need to be compared only where anchors
are equal. A text is cut into segments, runs of windows with one anchor.

1. Segments go to the bucket of their anchor as (anchor, segment, document)
   hashes, folded per task. A segment whose whole content stands in an earlier
   document is removed at once. Where one anchor has different segments, the
   first carrier of each content is noted.
2. The noted segments' bytes go to their bucket. They are found in the documents by
   Bloom filters of fixed size, each for the documents of as many notes as it has
   room for; so what is moved in vain does not grow with their number. Those that share 40 bytes
   around the anchor with another document enter a multi-document suffix order,
   built column by column: each round inserts one symbol of every segment from
   its end, which turns the collection's Burrows-Wheeler transform and common
   prefixes of one round, read from files, into those of the next.
   Neighbours with a common prefix of 50 bytes are equal windows.
3. Anchors with very many contents do not meet in one task: their windows are
   grouped by hash, with partial aggregation, instead.
4. What is to be removed returns to the document, packed by parts of the documents,
   and is united there.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytehash import chunks, mix, prefix, span_hash
from .common import stash
from .lm import planes, steps, unplanes, unsteps

_U = np.uint64
WINDOW, GRAM = 50, 20
#: Windows of one segment at most: as many as can hold one place (periodic texts have endless runs of one anchor).
RUN = WINDOW - GRAM + 1
#: Bits of a filter of noted segments (the only thing broadcast, one at a time), of it for each segment, and pieces in which it is made.
NOTED_LOG2, BITS_EACH, PIECES_LOG2 = 27, 16, 6
#: Segments a bucket, and noted ones, that a task gathers before it hands them on: rows have a size besides what they hold.
GATHERED, GATHERED_NOTED = 64, 16
#: Contents of one anchor that may meet in one task.
CROWD = 20_000


def segments(data: np.ndarray, starts: np.ndarray):
    """``anchor, content, row, start, end`` of the segments of all texts (bytes of their text's run)."""
    n = len(data)
    if n < WINDOW:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z
    c = prefix(data)
    at = np.arange(n - GRAM + 1)
    low, width = span_hash(c, at, at + GRAM), WINDOW - GRAM + 1
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    room = np.diff(starts) - WINDOW + 1
    rows = np.flatnonzero(room > 0)
    room = room[rows]
    row = np.repeat(rows, room)
    pos = np.arange(len(row)) + np.repeat(starts[rows] - (np.cumsum(room) - room), room)
    low = low[pos]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    new[:] = False
    since = np.arange(len(low)) - np.repeat(head, np.diff(np.append(head, len(low))))
    new[since % RUN == 0] = True
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(low)) - 1
    s, e = pos[head], pos[last] + WINDOW
    return mix(low[head]), span_hash(c, s, e), row[head], s, e  # least hashes crowd near zero: spread them


def _slot(key: np.ndarray, bits: int):
    x = mix(key)
    step = (x >> _U(35)) | _U(1)
    for _ in range(3):
        yield (x & _U(bits - 1)).astype(np.int64)
        x = x + step


def _noted(filt: np.ndarray, key: np.ndarray) -> np.ndarray:
    piece, bits = (key >> _U(64 - PIECES_LOG2)).astype(np.int64), len(filt) * 8 >> PIECES_LOG2
    ok = np.ones(len(key), bool)
    for at in _slot(key, bits):
        p = piece * bits + at
        ok &= (filt[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
    return ok


def _filter(keys: DataFrame, log2: int) -> np.ndarray:
    """A filter of ``2**log2`` bits of the hashes ``key``, made piece by piece."""
    bits = 1 << (log2 - PIECES_LOG2)

    def run(batches):
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            piece = key >> _U(64 - PIECES_LOG2)
            for p in np.unique(piece).tolist():
                seg = made.setdefault(p, np.zeros(bits // 8, np.uint8))
                for at in _slot(key[piece == p], bits):
                    np.bitwise_or.at(seg, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for p, seg in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([seg.tobytes()], pa.binary())], names=["piece", "bits"])

    piece = F.shiftrightunsigned("key", 64 - PIECES_LOG2).cast("int")
    out = np.zeros((1 << log2) // 8, np.uint8)
    for r in keys.select("key").repartition(piece).mapInArrow(run, "piece int, bits binary").toLocalIterator():  # 2**log2 bits in all
        out[r.piece * (bits // 8) : (r.piece + 1) * (bits // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def _carrier(content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix((content & _U((1 << 40) - 1)) * _U(0x9E3779B97F4A7C15) + doc.astype(np.uint64))


def _crowded(anchor: np.ndarray, log2: int) -> np.ndarray:
    """The key of a crowded anchor: of its bits those of the bucket and 32 more."""
    return mix((anchor >> _U(32 - log2)) ^ _U(0x5DEECE66D))


_LOW, _SPREAD = (1 << 31) - 1, 1327217885


def _part(doc: np.ndarray, log2: int) -> np.ndarray:
    x = doc.view(np.uint64)
    x = (x ^ (x >> _U(31))) & _U(_LOW)
    return ((x * _U(_SPREAD)) & _U(_LOW)).astype(np.int64) >> (31 - log2)


def _part_of(doc_id: str, log2: int) -> Column:
    """``_part`` of a column."""
    x = F.col(doc_id).bitwiseXOR(F.shiftrightunsigned(doc_id, 31)).bitwiseAND(F.lit(_LOW).cast("long"))
    return F.shiftright((x * F.lit(_SPREAD).cast("long")).bitwiseAND(F.lit(_LOW).cast("long")), 31 - log2).cast("int")


def _packed(log2: int, doc: np.ndarray, **cols: np.ndarray) -> pa.RecordBatch:
    """``part, docs`` and five low bytes of the columns: what belongs to documents, a row for each part of them."""
    part = _part(doc, log2)
    order = np.lexsort((doc, part))
    doc, part = doc[order], part[order]
    edge = np.flatnonzero(np.diff(part, prepend=-1, append=1 << log2))
    cuts = [slice(a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    out = [pa.array([int(part[c.start]) for c in cuts], pa.int32()), pa.array([steps(doc[c].view(np.uint64), 8) for c in cuts], pa.binary())]
    out += [pa.array([planes(x[order[c]], 5) for c in cuts], pa.binary()) for x in cols.values()]
    return pa.RecordBatch.from_arrays(out, names=["part", "docs", *cols])


def _shared_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Equal bytes from places ``a`` and ``b`` on, eight at a time; ``depth`` or more are not told apart."""
    common = np.full(len(a), depth, np.int64)
    on = np.arange(len(a))
    for k in range(0, depth, 8):
        x = words[a[on] + k] ^ words[b[on] + k]
        differs = x != 0
        end = on[differs]
        common[end] = k + (x[differs].view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        on = on[~differs]
        if not len(on):
            break
    return common


def column_order(text: np.ndarray, starts: np.ndarray, depth: int = WINDOW):
    """Suffix order of a collection of short strings, column by column.

    Returns ``(string, offset, common)`` of all suffixes in order; ``common``
    is the length, up to ``depth``, of the prefix shared with the suffix before.
    Equal suffixes stand in the order of their strings. ``text`` is UTF-8, in
    which byte 255 does not occur; it marks that nothing stands to the left.

    Each round inserts one suffix of every string, one symbol longer than its
    last. The Burrows-Wheeler transform tells its place (the smaller symbols
    and the equal ones before), and only the common prefixes on both sides of
    it change. Transform, places and common prefixes lie in files that each
    round reads and writes from front to back.
    """
    m, size = len(starts) - 1, np.diff(starts)
    place = np.int32 if len(text) < 2**31 else np.int64
    left = np.full(len(text) + 1, 255, np.uint8)
    left[1:] = text
    left[starts[:-1]] = 255
    rest = np.repeat(starts[1:], size) - np.arange(len(text))
    padded = np.concatenate((text, np.zeros(depth + 16, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8").ravel()
    with contextlib.ExitStack() as on_exit:
        folder = on_exit.enter_context(tempfile.TemporaryDirectory())
        kinds = {"symbol": np.uint8, "place": place, "common": np.uint8}
        files = [(on_exit.enter_context(open(os.path.join(folder, k), "w+b", buffering=0)), kind) for k, kind in kinds.items()]

        def put(*cols):
            for (f, kind), c in zip(files, cols):
                f.seek(0)
                c.astype(kind, copy=False).tofile(f)

        def get():
            for f, kind in files:
                f.seek(0)
                yield np.fromfile(f, kind)

        # round 0: the empty suffix of every string, before it the string's last symbol
        last = np.full(m, 255, np.uint8)
        last[size > 0] = text[starts[1:][size > 0] - 1]
        put(last, starts[1:], np.zeros(m, np.uint8))
        fresh = np.flatnonzero(last != 255)
        while len(fresh):
            symbol, at, common = get()
            order = np.argsort(symbol, kind="stable")
            new = np.zeros(len(symbol), bool)
            new[fresh] = True
            rank = np.flatnonzero(new[order])
            begins = at[order[rank]] - 1
            to = rank + m  # the empty suffixes stay in front
            keep = np.ones(len(symbol) + len(to), bool)
            keep[to] = False
            cols = []
            for old, add in ((symbol, left[begins]), (at, begins), (common, np.zeros(len(to), np.uint8))):
                col = np.empty(len(keep), old.dtype)
                col[keep] = old
                col[to] = add
                cols.append(col)
            symbol, at, common = cols
            beside = np.zeros(len(keep) + 1, bool)
            beside[to] = beside[to + 1] = True
            beside = np.flatnonzero(beside[:-1])
            common[beside] = 0
            beside = beside[beside > m]
            a, b = at[beside - 1].astype(np.int64), at[beside].astype(np.int64)
            common[beside] = np.minimum(_shared_prefix(words, a, b, depth), np.minimum(rest[a], rest[b]))
            put(symbol, at, common)
            fresh = to[symbol[to] != 255]
        _, at, common = get()
    string = np.concatenate((np.arange(m), np.searchsorted(starts, at[m:], side="right") - 1))
    return string, at - starts[string], common


def _seeded(text: np.ndarray, starts: np.ndarray, doc: np.ndarray):
    """``string, start, end``: the parts of segments that may share a window with another document.

    A window holds its anchor's 20 bytes and 30 more on both sides together, so
    it also holds one of three 40-byte strings around the anchor: from 20 or 10
    bytes before it or from its first byte. A segment none of whose three
    stands in another document has no window in common with one; otherwise
    only the windows with such a string are kept. A segment in which the anchor
    stands twice is kept whole, and has three strings around each of its places.
    """
    size, m = np.diff(starts), len(starts) - 1
    c = prefix(text)
    room = size - GRAM + 1
    own = np.repeat(np.arange(m), room)
    at = np.arange(len(own)) + np.repeat(starts[:-1] - (np.cumsum(room) - room), room)
    h = span_hash(c, at, at + GRAM)
    edge = np.cumsum(room) - room
    # the anchor is least in every window of the segment, and so in the segment
    least = np.minimum.reduceat(h, edge)
    is_least = h == least[own]
    whole = np.add.reduceat(is_least.astype(np.int64), edge) > 1
    p, own = at[is_least], own[is_least]
    start, end = np.where(whole, starts[:-1], starts[1:]), np.where(whole, starts[1:], starts[:-1])
    part = (WINDOW - GRAM) // 3
    for k in range(3):
        s = p - part * k
        e = s + GRAM + 2 * part
        inside = np.flatnonzero((s >= starts[own]) & (e <= starts[own + 1]))
        key = span_hash(c, s[inside], e[inside])
        order = np.argsort(key, kind="stable")
        key, who = key[order], inside[order]
        if not len(key):
            continue
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        owner = doc[own[who]]
        shared = np.minimum.reduceat(owner, head) < np.maximum.reduceat(owner, head)
        who = who[np.repeat(shared, np.diff(np.append(head, len(key))))]
        to, who = p[who], own[who]
        start[who] = np.minimum(start[who], np.maximum(to - part * (k + 1), starts[who]))
        end[who] = np.maximum(end[who], np.minimum(to + WINDOW - part * k, starts[who + 1]))
    found = np.flatnonzero(end - start >= WINDOW)
    return found, start[found] - starts[found], end[found] - starts[found]


def _repeats(text: np.ndarray, starts: np.ndarray, doc: np.ndarray, depth: int = WINDOW):
    """Byte ranges ``(string, start, end)`` covered by windows that also start in a smaller document."""
    string, offset, common = column_order(text, starts, depth)
    size = np.diff(starts)
    whole = size[string] - offset >= depth
    group = np.cumsum(common < depth)[whole]
    string, offset = string[whole], offset[whole]
    if not len(string):
        return string, string, string
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.repeat(np.minimum.reduceat(doc[string], head), np.diff(np.append(head, len(group))))
    gone = doc[string] > least
    return _ranges(string[gone], offset[gone], depth)


def _bucket_repeats(text: np.ndarray, starts: np.ndarray, doc: np.ndarray):
    """``_repeats`` of a bucket's segments, of which only the seeded parts are put in order."""
    string, s, e = _seeded(text, starts, doc)
    size = e - s
    edge = np.concatenate(([0], np.cumsum(size)))
    body = text[np.arange(edge[-1]) + np.repeat(starts[string] + s - edge[:-1], size)]
    own, a, b = _repeats(body, edge, doc[string])
    return string[own], a + s[own], b + s[own]


def _ranges(owner: np.ndarray, at: np.ndarray, depth: int):
    """Unite windows at neighbouring places of one owner."""
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + depth)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    return owner[head], at[head], (at[last] + depth if len(at) else at)


def _log2_buckets(spark) -> int:
    return min(14, max(6, math.ceil(math.log2(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def _deal(docs: DataFrame, log2: int) -> DataFrame:
    """Per run of documents and bucket: hashes of the distinct segments with their first document of the run."""
    most = max(1 << 17, GATHERED << log2)

    def dealt(a, g, doc):
        order = np.lexsort((doc, g, a))
        a, g, doc = a[order], g[order], doc[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (g[1:] != g[:-1])
        least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = doc > least
        a1, g1, d1 = a[new], g[new], doc[new]
        edge = np.searchsorted(a1 >> _U(64 - log2), np.arange((1 << log2) + 1, dtype=np.uint64))
        out = []
        for b in np.flatnonzero(np.diff(edge)).tolist():
            s = slice(edge[b], edge[b + 1])
            out.append((b, planes(a1[s] >> _U(32 - log2), 4), planes(g1[s], 5), planes(d1[s], 8)))
        # repeats inside the run need no answer
        g2, d2 = g[later], doc[later]
        if len(g2):
            out.append((int(mix(g2[:1])[0]) % (1 << log2), b"", planes(g2, 5), planes(d2, 8)))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "a", "g", "d"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, data, starts in chunks(batch.column(1)):
                a, g, row, _, _ = segments(data, starts)
                if len(a):
                    held.append((a, g, ids[first + row]))
                    n += len(a)
                if n >= most:
                    yield dealt(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if held:
            yield dealt(*map(np.concatenate, zip(*held)))

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, a binary, g binary, d binary")


def _resolve(dealt: DataFrame, log2: int, parts: int, crowd: int) -> DataFrame:
    """Removed segments (``part, docs, g``), noted carriers (``doc_id, key``) and crowded anchors (``key`` alone)."""
    names, most = ["part", "docs", "g", "doc_id", "key"], GATHERED << parts

    def rows(doc, key):
        n = len(key)
        doc = pa.nulls(n, pa.int64()) if doc is None else pa.array(doc)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), doc, pa.array(key.view(np.int64))], names=names)

    def packed(held):
        doc, g = map(np.concatenate, zip(*held))
        out = _packed(parts, doc, g=g)
        none = pa.nulls(out.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([*out.columns, none, none], names=names)

    def run(batches):
        got: dict[int, list] = {}
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for b, a, g, d in zip(*(c.to_pylist() for c in batch.columns)):
                if a:
                    got.setdefault(b, []).append((a, g, d))
                    continue
                held.append((unplanes(d, 8).astype(np.int64), unplanes(g, 5)))
                n += len(held[-1][0])
                if n >= most:
                    yield packed(held)
                    held, n = [], 0
        for b in sorted(got):
            found = got.pop(b)
            a = np.concatenate([unplanes(x, 4) for x, _, _ in found])
            g = np.concatenate([unplanes(x, 5) for _, x, _ in found])
            d = np.concatenate([unplanes(x, 8) for _, _, x in found]).astype(np.int64)
            order = np.lexsort((d, g, a))
            a, g, d = a[order], g[order], d[order]
            new_a = np.ones(len(a), bool)
            new_a[1:] = a[1:] != a[:-1]
            new_g = new_a.copy()
            new_g[1:] |= g[1:] != g[:-1]
            head_a, group_a, group_g = np.flatnonzero(new_a), np.cumsum(new_a) - 1, np.cumsum(new_g) - 1
            gone = d > d[np.flatnonzero(new_g)][group_g]
            held.append((d[gone], g[gone]))
            n += len(held[-1][0])
            if n >= most:
                yield packed(held)
                held, n = [], 0
            kinds = np.add.reduceat(new_g.astype(np.int64), head_a)
            several = (kinds > 1) & (np.minimum.reduceat(d, head_a) < np.maximum.reduceat(d, head_a))
            note = new_g & several[group_a]
            yield rows(d[note], _carrier(g[note], d[note]))
            many = head_a[several & (kinds > crowd)]
            if len(many):
                yield rows(None, _crowded((_U(b) << _U(64 - log2)) | (a[many] << _U(32 - log2)), log2))
        if n:
            yield packed(held)

    return dealt.repartition("bucket").mapInArrow(run, "part int, docs binary, g binary, doc_id long, key long")


def _noted_segments(docs: DataFrame, shared, log2: int) -> DataFrame:
    """Bytes of the noted segments by bucket, and windows of those with crowded anchors."""
    names, most = ["bucket", "window", "doc_id", "start", "docs", "starts", "sizes", "bytes"], max(1 << 14, GATHERED_NOTED << log2)

    def windows(data, starts, doc, row, s, e):
        n = e - s - WINDOW + 1
        at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        own = np.repeat(np.arange(len(s)), n)
        h = span_hash(prefix(data), at, at + WINDOW)
        z = len(at)
        return pa.RecordBatch.from_arrays([pa.nulls(z, pa.int32()), pa.array(h.view(np.int64)), pa.array(doc[own]), pa.array(at - starts[row[own]]), *[pa.nulls(z, pa.binary())] * 4], names=names)

    def packed(held):
        bucket, doc, start, size = (np.concatenate(x) for x in list(zip(*held))[:4])
        body = np.concatenate([x[4] for x in held])
        order = np.argsort(bucket, kind="stable")
        bucket, doc, start, size, at = bucket[order], doc[order], start[order], size[order], (np.cumsum(size) - size)[order]
        body = body[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(body))]
        ends = np.concatenate(([0], np.cumsum(size)))
        edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << log2))
        cuts = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        cols = [[planes(x[a:b], w) for a, b in cuts] for x, w in ((doc, 8), (start, 5), (size, 2))]
        cols.append([body[ends[a] : ends[b]].tobytes() for a, b in cuts])
        null = pa.nulls(len(cuts), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in cuts], pa.int32()), null, null, null, *[pa.array(c, pa.binary()) for c in cols]], names=names)

    def run(batches):
        filt, many = shared.value
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, data, starts in chunks(batch.column(1)):
                a, g, row, s, e = segments(data, starts)
                doc = ids[first + row]
                keep = np.flatnonzero(_noted(filt, _carrier(g, doc)))
                hot = _noted(many, _crowded(a[keep], log2))
                far, keep = keep[hot], keep[~hot]
                if len(far):
                    yield windows(data, starts, doc[far], row[far], s[far], e[far])
                if len(keep):
                    size = e[keep] - s[keep]
                    at = np.repeat(s[keep] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    held.append(((a[keep] >> _U(64 - log2)).astype(np.int64), doc[keep], s[keep] - starts[row[keep]], size, data[at]))
                    n += len(keep)
                if n >= most:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, window long, doc_id long, start long, docs binary, starts binary, sizes binary, bytes binary")


def _ordered(noted: DataFrame, parts: int) -> DataFrame:
    """``part, docs, starts, sizes``: ranges to remove, from the suffix order of each bucket."""

    def run(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for b, *x in zip(*(c.to_pylist() for c in batch.columns)):
                got.setdefault(b, []).append(x)
        held, n = [], 0
        for b in sorted(got):
            found = got.pop(b)
            doc = np.concatenate([unplanes(x[0], 8) for x in found]).astype(np.int64)
            at = np.concatenate([unplanes(x[1], 5) for x in found]).astype(np.int64)
            size = np.concatenate([unplanes(x[2], 2) for x in found]).astype(np.int64)
            text = np.frombuffer(b"".join(x[3] for x in found), np.uint8)
            own, s, e = _bucket_repeats(text, np.concatenate(([0], np.cumsum(size))), doc)
            held.append((doc[own], at[own] + s, e - s))
            n += len(own)
            if n >= GATHERED << parts:
                yield _ranges_of(parts, held)
                held, n = [], 0
        if n:
            yield _ranges_of(parts, held)

    packed = noted.where("bucket is not null").select("bucket", "docs", "starts", "sizes", "bytes")
    return packed.repartition("bucket").mapInArrow(run, "part int, docs binary, starts binary, sizes binary")


def _ranges_of(parts: int, held: list[tuple]) -> pa.RecordBatch:
    doc, start, size = map(np.concatenate, zip(*held))
    return _packed(parts, doc, starts=start, sizes=size)


def _windows_packed(late: DataFrame, parts: int) -> DataFrame:
    """As ``_ordered`` has them: ranges of the windows ``doc_id, start``."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            doc, s, e = _ranges(*(c.to_numpy() for c in batch.columns), WINDOW)
            held.append((doc, s, e - s))
            n += len(doc)
            if n >= GATHERED << parts:
                yield _ranges_of(parts, held)
                held, n = [], 0
        if n:
            yield _ranges_of(parts, held)

    return late.mapInArrow(run, "part int, docs binary, starts binary, sizes binary")


class _Answers:
    """What is to be removed from the documents of one part."""

    def __init__(self, rows: list[list]):
        gone = [(unsteps(d, 8), unplanes(g, 5)) for d, g, _, _ in rows if g is not None]
        cut = [(unsteps(d, 8), unplanes(s, 5), unplanes(n, 5)) for d, g, s, n in rows if g is None]
        none = np.zeros(0, np.uint64)
        self.gone, self.cut = (self._ordered(x or [(none, none, none)]) for x in (gone, cut))

    @staticmethod
    def _ordered(rows: list[tuple]) -> list[np.ndarray]:
        doc, *cols = (np.concatenate(x).astype(np.int64) for x in zip(*rows))
        order = np.argsort(doc, kind="stable")
        return [doc[order], *[c[order] for c in cols]]

    @staticmethod
    def of(held: list[np.ndarray], ids: np.ndarray, valid: np.ndarray):
        """The columns' runs of each document."""
        a, b = np.searchsorted(held[0], ids, "left"), np.searchsorted(held[0], ids, "right")
        return [[x[p:q] for x in held[1:]] if ok else None for p, q, ok in zip(a.tolist(), b.tolist(), (valid & (b > a)).tolist())]


def _cut(docs: DataFrame, answers: DataFrame, parts: int, keep_text: bool) -> DataFrame:
    """Unite what is to be removed from each text and remove it: the packed ``answers`` of a part go before its documents."""
    kept = list(docs.columns)
    added = "text string" if keep_text else "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema = docs.select(*[c for c in kept if c != "text"]).schema
    for part in added.split(", "):
        schema = schema.add(*part.split(" "))
    i_text = kept.index("text")
    others = [i for i in range(len(kept)) if i != i_text]
    docs = docs.withColumn("__id", F.col("doc_id").cast("long"))
    docs = docs.withColumn("__part", F.coalesce(_part_of("__id", parts), F.pmod(F.xxhash64("text"), F.lit(1 << parts)).cast("int"))).withColumn("__first", F.lit(False))
    answers = answers.select(F.col("part").alias("__part"), F.lit(True).alias("__first"), *[F.col(c).alias(f"__{c}") for c in ("docs", "g", "starts", "sizes")])
    met = docs.unionByName(answers, allowMissingColumns=True).repartition("__part").sortWithinPartitions("__part", F.desc("__first"))
    packed = ["__docs", "__g", "__starts", "__sizes"]

    def cut(batch, known):
        """The rows of documents in a batch of one part."""
        valid = batch["__id"].is_valid().to_numpy(zero_copy_only=False)
        ids = batch["__id"].fill_null(0).to_numpy()
        present = batch.column(i_text).is_valid().to_pylist()
        for first, data, starts in chunks(batch.column(i_text)):
            n = len(starts) - 1
            own = slice(first, first + n)
            change = np.zeros(len(data) + 1, np.int64)
            want = known.of(known.gone, ids[own], valid[own])
            if any(x is not None for x in want):
                _, g, row, s, e = segments(data, starts)
                g = (g & _U((1 << 40) - 1)).astype(np.int64)
                edge = np.searchsorted(row, np.arange(n + 1))
                for r, x in enumerate(want):
                    if x is not None:
                        part = slice(edge[r], edge[r + 1])
                        hit = np.isin(g[part], x[0])
                        np.add.at(change, s[part][hit], 1)
                        np.add.at(change, e[part][hit], -1)
            for r, x in enumerate(known.of(known.cut, ids[own], valid[own])):
                if x is not None:
                    np.add.at(change, x[0] + starts[r], 1)
                    np.add.at(change, x[0] + x[1] + starts[r], -1)
            gone = np.cumsum(change[:-1]) > 0
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            begin[starts[:-1][np.diff(starts) > 0]] |= gone[starts[:-1][np.diff(starts) > 0]]
            total = np.concatenate(([0], np.cumsum(gone)))
            spans = np.concatenate(([0], np.cumsum(begin)))
            edge = starts.tolist()
            out, left = [], data[~gone].tobytes()
            left_at = (starts - total[starts]).tolist()
            for r in range(n):
                out.append(left[left_at[r] : left_at[r + 1]])
            base = [batch.column(i).slice(first, n) for i in others]
            if keep_text:
                more = [pa.array([t.decode("utf-8", "ignore") if present[first + r] else None for r, t in enumerate(out)], pa.string())]
            else:
                more = [pa.array(np.diff(starts)), pa.array(total[starts[1:]] - total[starts[:-1]]), pa.array(spans[starts[1:]] - spans[starts[:-1]]), pa.array([hashlib.sha256(t).hexdigest() for t in out])]
            yield pa.RecordBatch.from_arrays([*base, *more], names=schema.names)

    def run(batches):
        now, rows, known = None, [], None
        for batch in batches:
            part, first = batch["__part"].to_numpy(), batch["__first"].to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate(([True], (np.diff(part) != 0) | (first[1:] != first[:-1]), [True])))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if part[a] != now:
                    now, rows, known = part[a], [], None
                some = batch.slice(a, b - a)
                if first[a]:
                    rows += zip(*(some[c].to_pylist() for c in packed))
                    continue
                if known is None:
                    known, rows = _Answers(rows), []
                yield from cut(some, known)

    return met.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, keep_text: bool = False, noted_log2: int = NOTED_LOG2, crowd: int = CROWD) -> DataFrame:
    """Remove each byte covered by a 50-byte string that also starts in a smaller doc_id.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, or with
    ``keep_text`` all columns of ``docs`` with ``text`` cut (a character that
    loses some of its bytes goes whole). Strings are judged on the input.
    Null texts are empty (and stay null with ``keep_text``). Rows with a null
    doc_id are neither compared nor cut; rows that share a doc_id do not remove
    from each other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs if keep_text else docs.select("doc_id", "text")
    log2 = _log2_buckets(spark)
    parts = log2 - 1
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    answers = stash(_resolve(_deal(named, log2), log2, parts, crowd))
    notes = answers.where("doc_id is not null").select("doc_id", "key")
    many = _filter(answers.where("doc_id is null and key is not null"), max(noted_log2 - 4, PIECES_LOG2 + 3))
    segs = None
    for some in _passes(notes, 1 << noted_log2):
        shared = spark.sparkContext.broadcast((_filter(notes.where(some), noted_log2), many))
        found = stash(_noted_segments(named.where(some), shared, log2))
        shared.destroy()
        segs = segs.unionAll(found) if segs else found
    windows = segs.where("window is not null").select("window", "doc_id", "start")
    least = windows.groupBy("window").agg(F.min("doc_id").alias("first"))
    late = windows.join(least, "window").where("doc_id > first").select("doc_id", "start")
    ranges = _ordered(segs, parts).unionAll(_windows_packed(late, parts))
    gone = answers.where("part is not null").select("part", "docs", "g")
    return _cut(docs, gone.unionByName(ranges, allowMissingColumns=True), parts, keep_text)


def _passes(notes: DataFrame, bits: int) -> list[Column]:
    """Conditions on ``doc_id`` that each hold for about as many ``notes`` as a filter of so many bits has room for, and for each document one of them."""
    n = -(-notes.count() * BITS_EACH // bits)
    if n < 2:
        return [F.lit(True)]
    at = {min(int(x), (1 << 63) - 1) for x in notes.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n)}
    edge = [None, *sorted(at), None]
    doc = F.col("doc_id")
    return [(F.lit(True) if a is None else doc >= a) & (F.lit(True) if b is None else doc < b) for a, b in zip(edge, edge[1:])]
